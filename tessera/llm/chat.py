"""Chat formatting with a grammar round trip.

The rendered conversation is a sequence of turns

    turn   = "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

Inside a role or text a control string may stand with backslashes after its
"<": reading takes one of them away.  Rendering first writes a turn as it is,
reparses it with the deterministic parser and compares the recovered role and
text with the source; where they differ the conflicting control strings get
one more backslash, until the recovered turn is identical.  (Role names also
keep their turn on one header line: a line feed or backslash in a role is
written as ``\\n`` or ``\\\\``.)

Turns are rendered and checked row by row in parallel.  A conversation is then
read back from its rendered turns, in order, as a stream: a conversation of
any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import store

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
_ROLE = re.compile(r"\\(.)")


class GrammarError(ValueError):
    pass


def _escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def _unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def _role_line(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _role_name(line: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], line)


def parse_turn(rendered: str, at: int = 0) -> tuple[str, str, int]:
    """(role, text, place after the turn) of the turn at ``at``; raises ``GrammarError``."""
    if not rendered.startswith(START, at):
        raise GrammarError(f"no turn at {at}")
    line = rendered.find("\n", at)
    if line < 0:
        raise GrammarError(f"no header line at {at}")
    end = rendered.find(END, line)
    if end < 0 or not rendered.startswith("\n", end + len(END)):
        raise GrammarError(f"the turn at {at} has no end")
    head, body = rendered[at + len(START):line], rendered[line + 1:end]
    if START in head or END in head or START in body:
        raise GrammarError(f"a control string inside the turn at {at}")
    return _role_name(_unescape(head)), _unescape(body), end + len(END) + 1


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a whole rendered conversation."""
    at, turns = 0, []
    while at < len(rendered):
        role, text, at = parse_turn(rendered, at)
        turns.append((role, text))
    return turns


def render_turn(role: str, text: str) -> str:
    """The turn, escaped until reading it gives back exactly (role, text)."""
    head, body = _role_line(role), text
    while True:
        rendered = f"{START}{head}\n{body}{END}\n"
        try:
            got_role, got_text, after = parse_turn(rendered)
            whole = after == len(rendered)
        except GrammarError:
            got_role, got_text, whole = None, None, False
        if whole and (got_role, got_text) == (role, text):
            return rendered
        # The text is escaped first; if that was not the conflict, the role is.
        if body == text and _CONTROL.search(text):
            body = _escape(text)
        else:
            head = _escape(_role_line(role))


def _render(batches):
    for b in batches:
        roles, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
        turns = [render_turn(r or "", t or "") for r, t in zip(roles, texts)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(turns, pa.string())],
                                         ["conv_id", "turn", "rendered"])


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, turn, rendered) of every row; a conversation is its rows' ``rendered`` one after the other.

    Rows go by turn, nulls first, and rows of one turn by their rendered text.
    A null role or text counts as empty; empty turns and repeated rows stay.
    """
    store.prepare(turns.sparkSession)
    schema = T.StructType([T.StructField("conv_id", turns.schema[conv_col].dataType),
                           T.StructField("turn", turns.schema[turn_col].dataType),
                           T.StructField("rendered", T.StringType())])
    return turns.select(F.col(conv_col), F.col(turn_col), F.col(role_col).cast("string"),
                        F.col(text_col).cast("string")).mapInArrow(_render, schema)


class _Reader:
    """Digests of one conversation, fed with its rendered turns."""

    def __init__(self):
        self.n = self.loss = self.chars = 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def feed(self, rendered: str, trained: str) -> None:
        self.chars += len(rendered)
        for role, text in parse(rendered):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == trained:
                self.loss += len(text)
                self.masked.update(text.encode())

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def _read_back(trained: str):
    def emit(batches):
        ids, rows, reader, open_id, kind = [], [], None, None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch():
            columns = zip(*rows) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *map(pa.array, columns, types)], names)

        for b in batches:
            kind = b.schema.field(0).type
            for conv, rendered in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if reader is None or conv != open_id:
                    if reader is not None:
                        ids.append(open_id)
                        rows.append(reader.row())
                    reader, open_id = _Reader(), conv
                reader.feed(rendered, trained)
            if ids:
                yield batch()
                ids, rows = [], []
        if reader is not None:
            ids.append(open_id)
            rows.append(reader.row())
            yield batch()
    return emit


def conversations(formatted: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation, read back from ``format_turns`` by the parser.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of every
    turn), loss_chars and loss_sha256 (the texts of ``trained_role``, which the
    loss covers), formatted_chars.  Rows without a conversation id form one
    conversation.  Conversations are shuffled by id and stream through their
    task in order; a digest is sequential, so one conversation is one stream,
    but what its turns cost to render and check was done row by row before.
    """
    store.prepare(formatted.sparkSession)
    schema = T.StructType([
        T.StructField("conv_id", formatted.schema["conv_id"].dataType), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return ordered.select("conv_id", "rendered").mapInArrow(_read_back(trained_role), schema)
