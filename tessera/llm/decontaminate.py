"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

An item of m characters may occur with up to k = floor(m * rate) edits.  Cut
into k + 1 pieces, at least one piece of any such occurrence is unharmed: an
Aho-Corasick automaton finds all exact piece hits of all items in one pass
over a text, and each hit names the window in which the whole item would lie.
Overlapping windows of an item are joined, and Myers' bit-parallel algorithm
decides whether some part of the window is within k edits of the item.

Texts and items are compared lower-cased and with runs of white space as one
space.  The items are a query set: they are read in blocks of bounded size.
One block needs one scan of the documents; with more, each block is a job of
its own that writes its hits, so a worker never holds two automata.

Every item counts, however short: one of fewer than ``1 / rate`` characters
must occur exactly, so an item of one letter marks each text with that letter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm import store
from tessera.llm.blocks import documents

MOST_BITS = 1 << 30  # of the Bloom filter of dropped rows


@dataclass(frozen=True)
class Settings:
    rate: float = 0.05  # edits allowed per character of an item
    block_chars: int = 4_000_000  # characters of items that are broadcast at once


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal length and their places."""
    n = edits + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' bit vectors of one item: the smallest distance of the item to any part of a text."""

    def __init__(self, item: str, edits: int):
        self.m, self.edits = len(item), edits
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> int | None:
        """The smallest distance, None if it is above ``edits``."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        up, down, score, best = full, 0, self.m, self.m
        masks = self.masks
        for c in text:
            eq = masks.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | (full & ~(xh | up))
            mh = up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
                    if not best:
                        break
            ph <<= 1  # a match may start anywhere: nothing enters at the bottom
            mh <<= 1
            up = full & (mh | ~(xv | ph))
            down = ph & xv & full
        return best if best <= self.edits else None


class Matcher:
    """All items of a block: which of them occur in a text."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items, self.patterns = [], []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            edits = min(int(len(text) * rate), len(text) - 1)
            k = len(self.items)
            self.items.append((item_id, len(text), edits))
            self.patterns.append(Pattern(text, edits))
            for place, piece in pieces(text, edits):
                found.setdefault(piece, []).append((k, place))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int]]:
        """(item id, distance) of the items in a text, in the items' order."""
        if not self.items:
            return []
        text = normal(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for k, place in owners:
                _, m, edits = self.items[k]
                at = end + 1 - size - place
                a, b = max(0, at - edits), min(len(text), at + m + edits)
                own = windows.setdefault(k, [])
                if own and a <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], a), max(own[-1][1], b)
                else:
                    own.append([a, b])
        out = []
        for k in sorted(windows):
            near = [d for a, b in windows[k] if (d := self.patterns[k].distance(text[a:b])) is not None]
            if near:
                out.append((self.items[k][0], min(near)))
        return out


_matchers: dict[str, Matcher] = {}


def _matcher(block, rate: float) -> Matcher:
    """Built once per worker and block; a worker keeps the last one."""
    name, items = block
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(items.value, rate)
    return _matchers[name]


def _blocks(items: DataFrame, settings: Settings, id_col: str, text_col: str) -> tuple[int, Iterator]:
    """How many blocks of about ``block_chars`` characters the items make, and the blocks.

    Each is a broadcast with a name of its own; the driver holds one at a time.
    """
    spark = items.sparkSession
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // settings.block_chars))

    def blocks():
        for i in range(n):
            block = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).distinct()
            yield uuid.uuid4().hex, spark.sparkContext.broadcast([(r.id, r.text) for r in block.collect()])
    return n, blocks()


def _find(block, rate: float, hits_type: pa.DataType):
    """Every column but the last, which is the text, and the text's hits."""
    def emit(batches):
        m = _matcher(block, rate)
        for b in batches:
            hits = [[{"item_id": k, "distance": d} for k, d in m.find(text.decode(errors="replace"))]
                    for text in documents(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hits, hits_type)], [*b.schema.names[:-1], "hits"])
    return emit


def _hits(rows: DataFrame, block, rate: float, item_id: T.DataType) -> DataFrame:
    """``rows`` (its last column is the text) with the hits of one block in place of the text."""
    hit = T.ArrayType(T.StructType([T.StructField("item_id", item_id), T.StructField("distance", T.IntegerType())]))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("hits", hit)])
    return rows.mapInArrow(_find(block, rate, to_arrow_type(hit)), schema)


def _written_hits(docs: DataFrame, blocks: Iterator, rate: float, item_id: T.DataType, id_col: str, text_col: str
                  ) -> DataFrame:
    """(id, row_key, hits) of the rows that any block hits, one job a block; equal rows have equal hits and give one."""
    rows = docs.select(F.col(id_col).alias("id"), store.row_key(id_col, text_col).alias("row_key"),
                       F.col(text_col).cast("string").alias("text"))
    parts = []
    for block in blocks:
        parts.append(store.written(_hits(rows, block, rate, item_id).where(F.size("hits") > 0), "leak-hits"))
        block[1].unpersist()
    return reduce(DataFrame.union, parts).distinct()


def contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
                 text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, item_ids (sorted), distances (of those items).

    A null or empty text holds no item; null and blank items are ignored;
    items with equal ids or equal texts are all reported.  Item ids are of any
    type that can be ordered and keep it.  Texts are not shuffled; with several
    blocks of items, ids meet the written hits in one join.
    """
    store.prepare(docs.sparkSession)
    item_id = items.schema[item_id_col].dataType
    n, blocks = _blocks(items, settings, item_id_col, item_text_col)
    if n == 1:
        rows = _hits(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), next(blocks),
                     settings.rate, item_id)
    else:
        found = store.written(_written_hits(docs, blocks, settings.rate, item_id, id_col, text_col).groupBy(
            F.col("id").alias("__id"), F.col("row_key").alias("__key")).agg(
            F.flatten(F.collect_list("hits")).alias("hits")), "leaks")  # at most one entry an item
        rows = docs.select(F.col(id_col).alias("id"), store.row_key(id_col, text_col).alias("row_key"))
        rows = rows.join(found, (F.col("row_key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id")), "left").select(
            "id", F.coalesce("hits", F.array()).alias("hits"))
    rows = rows.select("id", F.array_sort("hits").alias("hits"))
    return rows.select(F.col("id").alias("doc_id"), (F.size("hits") > 0).alias("contaminated"),
                       F.size("hits").cast("long").alias("n_items"), F.col("hits.item_id").alias("item_ids"),
                       F.col("hits.distance").alias("distances"))


def _keep(block, rate: float, at: int):
    def emit(batches):
        m = _matcher(block, rate)
        for b in batches:
            yield b.filter(pa.array([not m.find(x.decode(errors="replace")) for x in documents(b.column(at))], pa.bool_()))
    return emit


def drop_contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
                      text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows whose text holds no item, with all their columns.

    With one block of items nothing is shuffled; with several, only rows that
    a Bloom filter of the written hits marks.
    """
    store.prepare(docs.sparkSession)
    n, blocks = _blocks(items, settings, item_id_col, item_text_col)
    if n == 1:
        return docs.mapInArrow(_keep(next(blocks), settings.rate, docs.columns.index(text_col)), docs.schema)
    item_id = items.schema[item_id_col].dataType
    dropped = store.written(_written_hits(docs, blocks, settings.rate, item_id, id_col, text_col).select("id", "row_key"),
                            "leaky-rows")
    return store.without(docs, dropped, id_col, text_col, MOST_BITS)
