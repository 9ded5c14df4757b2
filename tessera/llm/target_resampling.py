"""Importance resampling towards a target distribution, over hashed word n-grams.

* Every document is separator-normalised (A-Z lower-cased, its words joined by
  one space) and scanned once; the running CRC-32 after each word and the
  words' lengths are stored.
* The CRC of any n-gram follows from two stored prefixes: appending bytes is
  linear over GF(2), so the prefix before the n-gram, shifted by the n-gram's
  length, cancels out of the prefix at its end.  No text is read again,
  whatever sizes of n-grams are asked for.
* Bucket counts of the documents and of the target texts give each bucket a
  gain, a document's weight is the sum over its n-grams, and the highest of
  weight plus seeded Gumbel noise are drawn without replacement.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import store
from tessera.llm.blocks import runs, text_buffers, word_pieces
from tessera.sources.delimited import with_row_index

#: Bytes of words: 0-9, a-z and all of non-ASCII characters, after A-Z became a-z; all others separate.
_NORMAL = bytes(c if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 0x20 for c in range(256))
_POLYNOMIAL = 0xEDB88320


@dataclass(frozen=True)
class Settings:
    """Buckets; n-gram sizes; least words of a document that may be drawn; percentage drawn; seed of the noise."""

    buckets: int = 10_000
    min_n: int = 1
    max_n: int = 1
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map over GF(2), given as its values on each of the four bytes."""
    return op[0][x & 0xFF] ^ op[1][x >> 8 & 0xFF] ^ op[2][x >> 16 & 0xFF] ^ op[3][x >> 24]


_TABLE = _byte_table()
_shifts: list[np.ndarray] = []


def _shift_map(k: int) -> np.ndarray:
    """What appending 2^k zero bytes does to a CRC."""
    if not _shifts:
        one = np.arange(256, dtype=np.uint32)
        _shifts.append(np.stack([_TABLE, one, one << 8, one << 16]))  # x -> table[x & 255] ^ (x >> 8)
    while len(_shifts) <= k:
        _shifts.append(np.stack([_apply(_shifts[-1], row) for row in _shifts[-1]]))
    return _shifts[k]


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each CRC after ``size`` zero bytes were appended, bit by bit of the sizes."""
    out = crc.astype(np.uint32)
    for k in range(int(size.max()).bit_length() if len(size) else 0):
        at = np.flatnonzero(size >> k & 1)
        out[at] = _apply(_shift_map(k), out[at])
    return out


def prefixes(raw: bytes) -> tuple[array, array]:
    """The running CRC-32 of a text's words joined by one space, after each word, and the words' lengths."""
    ends, sizes = array("I"), array("I")
    crc, step, put = 0, zlib.crc32, ends.append
    for words in word_pieces(raw.lower().translate(_NORMAL)):
        for w in words:
            crc = step(w, crc)
            put(crc)
            crc = step(b" ", crc)
        sizes.extend(map(len, words))
    return ends, sizes


def ngram_crcs(ends: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of every run of n consecutive words inside each document, and the n-grams' number by document.

    ``ends`` and ``sizes`` hold all documents' words one after the other,
    ``bounds`` the n + 1 places where documents begin.
    """
    words = np.diff(bounds)
    count = np.maximum(words - n + 1, 0)
    doc = np.repeat(np.arange(len(words)), count)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][doc]
    # The prefix before a word: one more space byte, or nothing before the first word.
    spaced = np.zeros(len(ends), dtype=np.uint32)
    low = ~ends[:-1]
    spaced[1:] = ~(_TABLE[(low ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (low >> 8))
    spaced[bounds[:-1][words > 0]] = 0
    before = np.concatenate([[0], np.cumsum(sizes)])
    length = before[first + n] - before[first] + (n - 1)
    return ends[first + n - 1] ^ shifted(spaced[first], length), count


def _scan(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = text_buffers(b.column(1))
        for i, j in runs(off):
            ends, sizes, number = [], [], []
            for a, z in zip(off[i:j].tolist(), off[i + 1:j + 1].tolist()):
                crc, size = prefixes(bytes(data[a:z]))
                ends.append(crc.tobytes())
                sizes.append(size.tobytes())
                number.append(len(crc))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array(number, pa.int64()), pa.array(ends, pa.binary()),
                 pa.array(sizes, pa.binary())], ["id", "n_words", "ends", "sizes"])


def running_crcs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, ends, sizes, rid): a document's running CRCs and word lengths, four bytes a word each; written.

    A null text has no words; null and repeated ids keep their rows.
    """
    store.prepare(docs.sparkSession)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("ends", T.BinaryType()), T.StructField("sizes", T.BinaryType())])
    return store.written(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
                         .mapInArrow(_scan, schema).withColumn("rid", F.monotonically_increasing_id()), "running-crcs")


def _bucket_runs(ends: pa.Array, sizes: pa.Array, settings: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents [i, j), the buckets of their n-grams and the n-grams' documents, for each size and run of about 1 MB."""
    data, size = (x.cast(pa.large_binary()).buffers()[2] for x in (ends, sizes))
    off = np.frombuffer(ends.cast(pa.large_binary()).buffers()[1], dtype=np.int64)[ends.offset:ends.offset + len(ends) + 1]
    if data is None or size is None:
        data = size = b""
    for i, j in runs(off):
        bounds = (off[i:j + 1] - off[i]) // 4
        a, n = int(off[i]), int(bounds[-1])
        e = np.frombuffer(data, dtype=np.uint32, count=n, offset=a)
        s = np.frombuffer(size, dtype=np.uint32, count=n, offset=a).astype(np.int64)
        for k in range(settings.min_n, settings.max_n + 1):
            crc, count = ngram_crcs(e, s, bounds, k)
            yield i, j, (crc % np.uint32(settings.buckets)).astype(np.int64), np.repeat(np.arange(j - i), count)


def _compact(b: pa.RecordBatch, at: int) -> pa.Array:
    """A binary column whose offsets begin at 0."""
    return pa.concat_arrays([b.column(at)])


def _count(settings: Settings):
    def emit(batches):
        total = np.zeros(settings.buckets, dtype=np.int64)
        for b in batches:
            for _, _, bucket, _ in _bucket_runs(_compact(b, 0), _compact(b, 1), settings):
                total += np.bincount(bucket, minlength=settings.buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["bucket", "n"])
    return emit


def bucket_counts(crcs: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, n): one row a bucket; a task adds up its own documents first."""
    return (crcs.select("ends", "sizes").mapInArrow(_count(settings), "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(raw: DataFrame, target: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 * ln of the smoothed target share over the smoothed raw share)."""
    spark: SparkSession = raw.sparkSession
    both = (spark.range(settings.buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
            .select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")))
    both = store.written(both, "bucket-counts")
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = ((F.col("t") + 1) * F.lit(total["s"] + settings.buckets)) / ((F.col("s") + 1) * F.lit(total["t"] + settings.buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def _weigh(settings: Settings, gain):
    def emit(batches):
        for b in batches:
            weight, number = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for i, j, bucket, doc in _bucket_runs(_compact(b, 3), _compact(b, 4), settings):
                before = np.concatenate([[0], np.cumsum(gain.value[bucket])])
                ends = np.searchsorted(doc, np.arange(j - i + 1))
                weight[i:j] += before[ends[1:]] - before[ends[:-1]]
                number[i:j] += np.diff(ends)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(number), pa.array(weight)],
                                             ["id", "rid", "n_words", "n_features", "weight"])
    return emit


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
             text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (null: not drawn).

    Of the N rows with at least ``least_words`` words, floor(percent * N /
    100) are drawn by descending score; ties go to the smaller id, a null id
    last.  A row's noise depends on the seed and its id only (a null id counts
    as the empty string), so rows that share an id share it.  Other columns
    are not read.
    """
    spark = docs.sparkSession
    crcs = running_crcs(docs, id_col, text_col)
    wanted = running_crcs(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), "id", "text")
    table = gains(bucket_counts(crcs, settings), bucket_counts(wanted, settings), settings)
    gain = np.zeros(settings.buckets, dtype=np.int64)
    for bucket, value in table.collect():  # one number a bucket: bounded by the setting
        gain[bucket] = value
    kind = docs.schema[id_col].dataType
    rows = crcs.select("id", "rid", "n_words", "ends", "sizes").mapInArrow(
        _weigh(settings, spark.sparkContext.broadcast(gain)), T.StructType([
            T.StructField("id", kind), T.StructField("rid", T.LongType()), T.StructField("n_words", T.LongType()),
            T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())]))
    own = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(own.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = store.written(rows.withColumn("score", F.col("weight") + noise), "scores")
    may = F.col("n_words") >= settings.least_words
    # Range-sorted by (score, id, row): no key of the sort is held by many rows.
    placed = with_row_index(rows.where(may), [F.desc("score"), F.asc_nulls_last("id"), F.asc("rid")], "place")
    draws = rows.where(may).count() * settings.percent // 100
    rank = F.when(F.col("place") < draws, F.col("place") + 1)
    columns = [F.col("id").alias("doc_id"), "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).union(
        rows.where(~may).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
          text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, in full: those whose id is drawn; ids must be unique and not null."""
    picked = resample(docs, target, settings, id_col, text_col, target_text_col).where(F.col("rank").isNotNull())
    return docs.join(picked.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
