"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark, merged into removal intervals.

A window is ``width`` consecutive words of one document.  A word goes when a
window that covers it also starts in a document with a smaller id; windows are
judged on the input, not on what is left.

* Documents with the same word sequence form one class: the smallest id stands
  for it, the other members lose every word (if they have a whole window).
* A window whose words occur in one class only can be told without moving it:
  the smallest Rabin-Karp hash of the ``gram``-word pieces inside a window is
  its anchor, and equal windows have equal anchors.  About two anchors in
  ``width - gram + 2`` words are counted; windows whose anchor is found in a
  single class are proven unrepeated.  This loses nothing.
* The 128-bit Rabin-Karp hash of every other window is counted: the smallest
  and the largest id in which it starts, in partial aggregates, so that a
  passage of very many documents costs one row per task.
* The starts of repeated windows merge into maximal intervals, document by
  document.

Words are told apart by 64-bit hashes, windows by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import store
from tessera.llm.blocks import documents, mix64, runs, text_buffers, word_pieces

MOST_BITS = 1 << 30
KNOWN_WORDS = 1 << 18  # hashed words that a task remembers
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
INTERVALS = "array<struct<start:int,end:int>>"

_BASES = (0x9E3779B97F4A7C55, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass(frozen=True)
class Settings:
    """Words in a window; words in the pieces that anchors are chosen from."""

    width: int = 50
    gram: int = 25

    def __post_init__(self):
        if not 1 <= self.gram <= self.width:
            raise ValueError("gram must lie between 1 and width")


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, raw: bytes) -> np.ndarray:
        """The hashes of a text's words: eight bytes a word, whatever its length."""
        parts = [np.fromiter(map(self.__getitem__, words), np.uint64, len(words)) for words in word_pieces(raw)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        have = _powers[base] = tuple(out)
    return have[0][:n], have[1][:n]


def window_hashes(words: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """The Rabin-Karp hash of every window: a polynomial in the word hashes, rolled by prefix sums, then mixed."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(_BASES[family], len(words))
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum((mix64(words + np.uint64(1)) if family else words) * down, out=prefix[1:])
    return mix64((prefix[width:] - prefix[:-width]) * up[:n])


def _least_of(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n neighbours."""
    out, k = x, 1
    while 2 * k <= n:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    m = len(x) - n + 1
    return np.minimum(out[:m], out[n - k:n - k + m])


def anchors(words: np.ndarray, settings: Settings) -> np.ndarray:
    """The anchor of every window."""
    if len(words) < settings.width:
        return np.zeros(0, dtype=np.uint64)
    return _least_of(window_hashes(words, settings.gram), settings.width - settings.gram + 1)


def intervals(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal intervals [start, end) that windows at the sorted ``starts`` cover; touching ones are one."""
    if not len(starts):
        return starts, starts
    first = np.flatnonzero(np.diff(starts, prepend=starts[0] - width - 1) > width)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last] + width


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of documents (about 1 MB each)."""
    data, off = text_buffers(texts)
    for i, j in runs(off):
        yield i, j, [bytes(data[a:b]) for a, b in zip(off[i:j].tolist(), off[i + 1:j + 1].tolist())]


def kept_words(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The words outside the sorted intervals, joined by one space, in pieces that follow each other."""
    at, k, first = 0, 0, True
    for words in word_pieces(raw):
        kept, here = [], 0
        while here < len(words):
            while k < len(ends) and ends[k] <= at + here:
                k += 1
            if k < len(starts) and starts[k] <= at + here:
                here = min(int(ends[k]) - at, len(words))
                continue
            stop = min(int(starts[k]) - at, len(words)) if k < len(starts) else len(words)
            kept += words[here:stop]
            here = stop
        at += len(words)
        if kept:
            yield (b"" if first else b" ") + b" ".join(kept)
            first = False


def _sha(pieces: Iterator[bytes]):
    h = hashlib.sha256()
    for x in pieces:
        h.update(x)
    return h


_NONE = np.zeros(0, dtype=np.int64)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def _profile(settings: Settings):
    def emit(batches):
        known = WordHashes()
        for b in batches:
            for i, j, docs in _parts(b.column(1)):
                found, number = [], []
                for raw in docs:
                    h = known.of(raw)
                    number.append(len(h))
                    a = anchors(h, settings)
                    new = np.ones(len(a), dtype=bool)
                    new[1:] = a[1:] != a[:-1]
                    found.append(a[new].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i),
                     pa.array(number, pa.int64()),
                     pa.array([_sha(kept_words(x, _NONE, _NONE)).digest() for x in docs], pa.binary()),
                     _lists(found, pa.int64())], ["id", "row_key", "n", "digest", "anchors"])
    return emit


def _windows(settings: Settings):
    def emit(batches):
        known = WordHashes()
        for b in batches:
            wanted, ends = b.column(2).flatten().to_numpy().view(np.uint64), b.column(2).offsets.to_numpy()
            ends = ends - ends[0]
            for i, j, docs in _parts(b.column(3)):
                for d, raw in zip(range(i, j), docs):
                    h = known.of(raw)
                    own = np.sort(wanted[ends[d]:ends[d + 1]])
                    if len(h) < settings.width or not len(own):
                        continue
                    a = anchors(h, settings)
                    at = np.flatnonzero(own[np.minimum(np.searchsorted(own, a), len(own) - 1)] == a)
                    one = window_hashes(h, settings.width)[at].view(np.int64)
                    two = window_hashes(h, settings.width, 1)[at].view(np.int64)
                    place = pa.array(np.full(len(at), d), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one), pa.array(two), b.column(0).take(place), b.column(1).take(place),
                         pa.array(at, pa.int32())], ["h1", "h2", "cid", "id", "start"])
    return emit


def _cut(width: int):
    def emit(batches):
        for b in batches:
            starts, ends = b.column(1).flatten().to_numpy(), b.column(1).offsets.to_numpy()
            ends = ends - ends[0]
            for d, raw in enumerate(documents(b.column(2))):
                s, e = intervals(np.sort(starts[ends[d]:ends[d + 1]]).astype(np.int64), width)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(d, 1), pa.array([int((e - s).sum())], pa.int64()),
                     pa.array([_sha(kept_words(raw, s, e)).hexdigest()]),
                     pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.StructArray.from_arrays(
                         [pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["start", "end"]))],
                    ["cid", "n_removed", "kept_sha256", "removed"])
    return emit


def _whole(n: str) -> F.Column:
    """The one interval of a text that goes whole."""
    return F.array(F.struct(F.lit(0).cast("int").alias("start"), F.col(n).cast("int").alias("end")))


def repeats(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, removed (intervals of word places), row_key.

    A null text has no words.  A null id is neither smaller nor larger than
    any other: such a row keeps all its words and takes none from others.
    Rows that share an id do not take words from each other; repeated rows
    have equal results.  Texts shorter than a window stay whole.  Other
    columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    store.prepare(spark)
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                        store.row_key(id_col, text_col).alias("row_key"))
    rows = store.written(texts.mapInArrow(_profile(settings), T.StructType([
        T.StructField("id", kind), T.StructField("row_key", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("digest", T.BinaryType()), T.StructField("anchors", T.ArrayType(T.LongType()))])), "word-profiles")
    judged = rows.where((F.col("n") >= settings.width) & F.col("id").isNotNull())
    classes = store.written(
        judged.groupBy("digest").agg(F.min(F.struct("id", "row_key")).alias("first"), F.max("id").alias("last"),
                                     F.any_value("anchors").alias("anchors"))
        .select(F.monotonically_increasing_id().alias("cid"), "digest", F.col("first.id").alias("id"),
                F.col("first.row_key").alias("row_key"), "last", "anchors"), "word-classes")

    # Classes that share an anchor with another one.
    anchored = classes.select("cid", F.explode("anchors").alias("anchor"))
    shared = store.written(anchored.groupBy("anchor").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"))
                           .where("lo < hi").select("anchor"), "shared-anchors")
    meeting = anchored.join(shared, "anchor").groupBy("cid").agg(F.collect_set("anchor").alias("anchors"))
    candidates = store.written(classes.select("cid", "id", "row_key").join(meeting, "cid"), "candidates")

    # Their texts, each once, and the windows that have a shared anchor.
    bitmap = store.bloom(candidates.select("row_key"), store.filter_bits(candidates.count(), MOST_BITS))
    found = (store.marked(texts.select("row_key", "text"), "row_key", bitmap, "maybe").where("maybe")
             .groupBy("row_key").agg(F.any_value("text").alias("text")))
    found = store.written(candidates.join(found, "row_key").select("cid", "id", "anchors", "text"), "candidate-texts")
    windows = store.written(found.mapInArrow(_windows(settings), T.StructType([
        T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("cid", T.LongType()),
        T.StructField("id", kind), T.StructField("start", T.IntegerType())])), "windows")
    counted = store.written(windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
                            .where("lo < hi").select("h1", "h2", "lo"), "repeated-windows")
    starts = (windows.join(counted, ["h1", "h2"]).where("id > lo").groupBy("cid")
              .agg(F.collect_list("start").alias("starts")))
    cut = (found.select("cid", "text").join(starts, "cid").select("cid", "starts", "text")
           .mapInArrow(_cut(settings.width), f"cid long, n_removed long, kept_sha256 string, removed {INTERVALS}"))

    known = store.written(classes.select("cid", "digest", F.col("id").alias("least"), "last").join(cut, "cid", "left")
                          .where("least < last or n_removed is not null").drop("cid", "last"), "removals")
    judge = (F.col("n") >= settings.width) & F.col("id").isNotNull() & F.col("least").isNotNull()
    copy = judge & (F.col("id") > F.col("least"))
    cut_here = judge & F.col("n_removed").isNotNull()
    sha = F.lower(F.hex("digest"))
    return rows.drop("anchors").join(known, "digest", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).when(cut_here, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).when(cut_here, F.col("kept_sha256")).otherwise(sha).alias("kept_sha256"),
        F.when(copy, _whole("n")).when(cut_here, F.col("removed")).otherwise(F.array().cast(INTERVALS)).alias("removed"),
        "row_key")


def _rewrite(batches):
    for b in batches:
        out = []
        for raw, gone in zip(documents(b.column(0)), b.column(1).to_pylist()):
            spans = np.array([(x["start"], x["end"]) for x in gone or []], dtype=np.int64).reshape(-1, 2)
            out.append(b"".join(kept_words(raw, spans[:, 0], spans[:, 1])))
        text = pa.array(out, pa.binary()).cast(pa.string(), safe=False)
        yield pa.RecordBatch.from_arrays([text, *b.columns[2:]], [str(i) for i in range(b.num_columns - 1)])


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words cut out of the texts (what stays is joined by one space).

    Texts that lose nothing stay as they are, null ones included, and their
    rows are not shuffled; a text that loses all its words becomes empty.
    """
    gone = store.written(repeats(docs, settings, id_col, text_col).where("n_removed > 0")
                         .groupBy("row_key").agg(F.any_value("removed").alias("__removed")), "removed-words")
    bitmap = store.bloom(gone.select("row_key"), store.filter_bits(gone.count(), MOST_BITS))
    key, maybe = store.fresh(docs, "row_key"), store.fresh(docs, "maybe")
    rows = store.marked(docs.withColumn(key, store.row_key(id_col, text_col)), key, bitmap, maybe)
    hit = rows.where(F.col(maybe)).join(gone.withColumnRenamed("row_key", "__key"), F.col(key) == F.col("__key"), "left")
    same = hit.where(F.col("__removed").isNull()).select(*docs.columns)
    others = [c for c in docs.columns if c != text_col]
    cut = hit.where(F.col("__removed").isNotNull()).select(
        F.col(text_col).cast("string"), "__removed", *others).mapInArrow(_rewrite, T.StructType(
            [T.StructField(text_col, T.StringType()), *[docs.schema[c] for c in others]])).select(*docs.columns)
    return rows.where(~F.col(maybe)).select(*docs.columns).union(same).union(cut)
