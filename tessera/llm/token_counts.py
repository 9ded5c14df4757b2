"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A byte-pair tokenizer splits a text into pre-tokens by a pattern and encodes
each on its own, so a document's count is a sum over pre-tokens.  The tree's
leaves are runs of up to ``LEAF`` pre-tokens with their code points and
tokens; inner nodes hold the sums of their subtrees.

An edit re-encodes only from the start of the leaf that holds the place a few
code points before it (the pattern looks at most ``LOOKAHEAD`` code points
past the end of a match) to the first old leaf start behind it where a new
pre-token starts as well.  From a common pre-token start on, equal text splits
equally, so everything behind keeps its counts.  The sums on the paths from
the changed leaves to the root are updated.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import store
from tessera.llm.blocks import documents

LEAF = 32
LOOKAHEAD = 4
CACHE = 1 << 18  # pre-tokens whose counts a worker remembers

#: Fixed value: the public split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """Counts of pre-tokens under a rank file (base64 of the bytes, a blank, the rank, by line)."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        table = {base64.b64decode(t): int(r) for t, r in (x.split() for x in ranks.splitlines() if x)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known, out = self.known, []
        for p in pieces:
            n = known.get(p)
            if n is None:
                if len(known) >= CACHE:
                    known.clear()
                n = len(self.encoding.encode_ordinary(p))
                if len(p) <= 64:
                    known[p] = n
            out.append(n)
        return out


class Tree:
    """Sums of code points and tokens over the leaves of one text, as two heaps of ``2 * width`` numbers."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.leaves = len(chars)
        self.width = 1 << max(0, self.leaves - 1).bit_length()
        self.chars, self.tokens = self._heap(chars), self._heap(tokens)

    def _heap(self, leaf: np.ndarray) -> array:
        levels = [np.zeros(self.width, dtype=np.int64)]
        levels[0][:len(leaf)] = leaf
        while len(levels[-1]) > 1:
            levels.append(levels[-1][0::2] + levels[-1][1::2])
        return array("q", np.concatenate([np.zeros(1, dtype=np.int64), *levels[::-1]]).tolist())

    @classmethod
    def build(cls, text: str, tokenizer: Tokenizer) -> Tree:
        pieces = tokenizer.split.findall(text)
        if not pieces:
            return cls(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
        at = np.arange(0, len(pieces), LEAF)
        return cls(np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), at),
                   np.add.reduceat(np.array(tokenizer.counts(pieces), dtype=np.int64), at))

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a code point, and the leaf's start; the last leaf for a place at the end."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        for heap, value in ((self.chars, chars), (self.tokens, tokens)):
            node = leaf + self.width
            heap[node] = value
            while node > 1:
                node //= 2
                heap[node] = heap[2 * node] + heap[2 * node + 1]

    def edit(self, text: str, start: int, end: int, new: str, tokenizer: Tokenizer) -> tuple[str, int]:
        """Replace ``text[start:end]``; returns the new text and how many code points were re-encoded."""
        after = text[:start] + new + text[end:]
        moved = len(new) - (end - start)
        first, at = self.find(max(0, start - LOOKAHEAD))
        # Old leaf starts from the edit's end on, where splitting may fall into step again.
        last, bound = self.find(end)
        if last <= first:
            last, bound = first + 1, at + self.chars[first + self.width]
        while bound < end and last < self.leaves:
            bound += self.chars[last + self.width]
            last += 1
        pieces, place = [], at
        for m in tokenizer.split.finditer(after, at):
            while bound + moved < place and last < self.leaves:
                bound += self.chars[last + self.width]
                last += 1
            if place == bound + moved and last < self.leaves:
                break
            pieces.append(m[0])
            place = m.end()
        else:
            last = self.leaves
        self.set(first, place - at, sum(tokenizer.counts(pieces)))
        for leaf in range(first + 1, last):
            if self.chars[leaf + self.width]:
                self.set(leaf, 0, 0)
        return after, place - at

    def leaf_arrays(self) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.width, self.width + self.leaves)
        return np.array(self.chars[part], dtype=np.int32), np.array(self.tokens[part], dtype=np.int32)


_tokenizers: dict[str, Tokenizer] = {}


def _tokenizer(sent) -> Tokenizer:
    """Built once per worker."""
    name, ranks = sent
    if name not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[name] = Tokenizer(ranks.value)
    return _tokenizers[name]


def _send(spark, vocabulary: str):
    """The rank file (under 1 MB for the public vocabularies), read by the driver."""
    with open(vocabulary, "rb") as f:
        return vocabulary, spark.sparkContext.broadcast(f.read())


def _trees(sent, at: int):
    def emit(batches):
        tokenizer = _tokenizer(sent)
        for b in batches:
            n, chars, tokens = [], [], []
            for raw in documents(b.column(at)):
                tree = Tree.build(raw.decode(errors="replace"), tokenizer)
                c, t = tree.leaf_arrays()
                n.append(tree.n_tokens)
                chars.append(c.tobytes())
                tokens.append(t.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(n, pa.int64()), pa.array(chars, pa.binary()), pa.array(tokens, pa.binary())],
                [*b.schema.names, "n_tokens", "leaf_chars", "leaf_tokens"])
    return emit


def with_trees(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, leaf_chars and leaf_tokens: the count and the tree's leaves (32-bit integers).

    ``docs`` must not have columns of these names.  A null or empty text has
    one empty leaf and no tokens.
    """
    store.prepare(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()),
                           T.StructField("leaf_chars", T.BinaryType()), T.StructField("leaf_tokens", T.BinaryType())])
    return docs.mapInArrow(_trees(_send(docs.sparkSession, vocabulary), docs.columns.index(text_col)), schema)


def _in_order(edits: list[dict] | None, length: int) -> list[tuple[int, int, str]]:
    """Edits by start, inside the text, none before the end of the one before it."""
    out, done = [], 0
    for e in sorted((e for e in edits or [] if e), key=lambda e: (e["start"] or 0, e["end"] or 0, e["new"] or "")):
        a = min(max(e["start"] or 0, done), length)
        b = min(max(e["end"] or 0, a), length)
        out.append((a, b, e["new"] or ""))
        done = b
    return out


def _edited(sent):
    def emit(batches):
        tokenizer = _tokenizer(sent)
        for b in batches:
            n, size, count, again = [], [], [], []
            rows = zip(documents(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())
            for raw, edits, chars, tokens in rows:
                text = raw.decode(errors="replace")
                tree = Tree(np.frombuffer(chars, np.int32), np.frombuffer(tokens, np.int32))
                todo, work = _in_order(edits, len(text)), 0
                for a, e, new in reversed(todo):  # from the back: places in front keep their meaning
                    text, seen = tree.edit(text, a, e, new, tokenizer)
                    work += seen
                n.append(tree.n_tokens)
                size.append(tree.n_chars)
                count.append(len(todo))
                again.append(work)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(5), *(pa.array(x, pa.int64()) for x in (n, size, count, again))],
                ["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_edits", "n_chars_encoded"])
    return emit


def edited_counts(trees: DataFrame, edits_col: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
                  ) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_chars_after, n_edits, n_chars_encoded; one row per input row.

    ``trees`` comes from ``with_trees``; ``edits_col`` is an array of (start,
    end, new) in code points of the kept text.  Places outside the text mean
    its ends, an edit that starts inside the one before it starts at its end,
    null edits are ignored, null ``new`` deletes.
    """
    store.prepare(trees.sparkSession)
    schema = T.StructType([T.StructField("doc_id", trees.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in (
        "n_tokens", "n_tokens_after", "n_chars_after", "n_edits", "n_chars_encoded"))])
    rows = trees.select(F.col(id_col), F.col(text_col).cast("string"), F.col(edits_col), "leaf_chars", "leaf_tokens",
                        F.col("n_tokens"))
    return rows.mapInArrow(_edited(_send(trees.sparkSession, vocabulary)), schema)


def spread_edits(text_col: str, id_col: str) -> Column:
    """Three edits a document at a quarter, half and three quarters of it: replace, insert, delete."""
    n = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    tag = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    edit = lambda a, b, new: F.struct(F.floor(a).alias("start"), F.floor(b).alias("end"), new.alias("new"))
    return F.array(edit(n / 4, n / 4 + 7, F.concat(F.lit(" revised "), tag)),
                   edit(n / 2, n / 2, F.concat(F.lit("\n\n(see note "), tag, F.lit(")  "))),
                   edit(n * 0.75, n * 0.75 + 3, F.lit("")))
