"""Exact dedup by two passes over a Bloom filter.

Texts are equal when they are identical after lower-casing A-Z (null counts
as empty).  The first pass fills a filter whose slots remember whether two
rows fell into them; the second passes every row whose slots are not full
straight through, and shuffles only the possibly repeated rows by their
SHA-256.  A false positive of the filter costs one shuffled row, never a
wrong result.  Of equal texts the row with the largest id stays; null ids are
smallest, and of rows with equal ids exactly one stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import store
from tessera.llm.blocks import documents

MOST_BITS = 1 << 30  # 128 MB: the most that the broadcast filter ever takes


def _sha256(col: pa.Array) -> tuple[pa.Array, pa.Array]:
    """SHA-256 of each normalised text, and its first 8 bytes as a bigint."""
    full = b"".join(hashlib.sha256(x.lower()).digest() for x in documents(col))
    key = np.frombuffer(full, dtype=np.int64).reshape(-1, 4)[:, 0] if full else np.zeros(0, np.int64)
    return (pa.Array.from_buffers(pa.binary(32), len(full) // 32, [None, pa.py_buffer(full)]).cast(pa.binary()),
            pa.array(np.ascontiguousarray(key)))


def _digest(batches):
    for b in batches:
        sha, key = _sha256(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), sha, key], ["id", "sha", "key"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other.  Repeated rows count in
    ``group_size`` and exactly one of a group has ``kept``.  A null id keeps a
    null ``doc_id``; ``keep_id`` is null only if the whole group has null ids.
    Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    store.prepare(spark)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("sha", T.BinaryType()),
                           T.StructField("key", T.LongType())])
    rows = store.written(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
                         .mapInArrow(_digest, schema)
                         .withColumn("rid", F.monotonically_increasing_id()), "digests")
    bitmap = store.bloom(rows.select("key"), store.filter_bits(rows.count(), MOST_BITS), least=2)
    marked = store.marked(rows, "key", bitmap, "maybe")
    alone = marked.where(~F.col("maybe")).select(
        F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    maybe = marked.where("maybe")
    # Written: the join below then has an exchange of its own on each side, whose hot partitions the runtime splits.
    groups = store.written(maybe.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"),
                                                    F.max(F.struct("id", "rid")).alias("top")), "sha-groups")
    together = maybe.join(groups, "sha").select(
        F.col("id").alias("doc_id"), F.col("top.id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return alone.union(together)


def _flag_rows(at: int, bitmap):
    def mark(batches):
        for b in batches:
            sha, key = _sha256(b.column(at))
            maybe = pa.array(store.passes(bitmap.value, key.to_numpy()), pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, sha, maybe], [str(i) for i in range(b.num_columns + 2)])
    return mark


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows that the filter clears are neither shuffled nor sorted.  Of the
    others one row per text stays: the largest (id, text); rows that agree in
    both are interchangeable and any one of them stays whole.
    """
    spark = docs.sparkSession
    store.prepare(spark)
    keys = docs.select(F.lit(None).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _digest, "id string, sha binary, key long").select("key")
    keys = store.written(keys, "digest-keys")
    bitmap = store.bloom(keys, store.filter_bits(keys.count(), MOST_BITS), least=2)
    sha, maybe = store.fresh(docs, "sha"), store.fresh(docs, "maybe")
    marked = docs.mapInArrow(_flag_rows(docs.columns.index(text_col), bitmap), T.StructType(
        [*docs.schema.fields, T.StructField(sha, T.BinaryType()), T.StructField(maybe, T.BooleanType())]))
    alone = marked.where(~F.col(maybe)).select(*docs.columns)
    best = (marked.where(F.col(maybe)).groupBy(sha)
            .agg(F.max_by(F.struct(*docs.columns), F.struct(F.col(id_col), F.col(text_col))).alias("row"))
            .select("row.*"))
    return alone.union(best)
