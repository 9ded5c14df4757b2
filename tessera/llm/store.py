"""Session-level helpers of this package: written tables, bounded Arrow batches, broadcast bitmaps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoint_dir, scratch_path, share_package

BATCH_BYTES = 16 << 20
SEGMENT = 1 << 16  # slots in one segment of a bitmap: a place fits 16 bits, a segment's bitmap 8 KB


def prepare(spark: SparkSession) -> None:
    """Importable package, shared folder, and Arrow batches bounded in bytes (texts differ in length by orders of magnitude).

    A tighter bound that the session already has stays.
    """
    share_package(spark)
    ensure_checkpoint_dir(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key))
    except (TypeError, ValueError):
        now = 0
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two slots for each 64-bit key; ``bits`` is a power of two."""
    a = keys & np.uint64(bits - 1)
    b = (keys >> np.uint64(32)) * np.uint64(0x9E3779B1) & np.uint64(bits - 1)
    return np.concatenate([a, b]).astype(np.int64)


def _packed(segment: np.ndarray, place: np.ndarray) -> dict[int, bytes]:
    at = np.flatnonzero(np.diff(segment, prepend=-1))
    return {int(segment[i]): place[i:j].astype(np.uint16).tobytes()
            for i, j in zip(at, [*at[1:], len(segment)])}


def _local_filter(bits: int) -> Callable:
    def emit(batches):
        found = [_slots(np.frombuffer(b.column(0).buffers()[1], dtype=np.int64)[
            b.column(0).offset:b.column(0).offset + len(b)].astype(np.uint64), bits) for b in batches if len(b)]
        if not found:
            return
        slot, n = np.unique(np.concatenate(found), return_counts=True)
        once = _packed(slot // SEGMENT, slot % SEGMENT)
        more = slot[n > 1]
        twice = _packed(more // SEGMENT, more % SEGMENT)
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array(list(once), pa.int32()), "once": pa.array(list(once.values()), pa.binary()),
            "twice": pa.array([twice.get(k, b"") for k in once], pa.binary())})
    return emit


def _merged(least: int) -> Callable:
    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(SEGMENT, dtype=np.uint8)
        for column in ("once", "twice"):
            for x in rows[column]:
                at = np.frombuffer(x, dtype=np.uint16)
                n[at] = np.minimum(n[at] + 1, 2)
        full = n >= least
        return pd.DataFrame({"segment": [key[0]], "bitmap": [np.packbits(full, bitorder="little").tobytes()]}
                            if full.any() else {"segment": [], "bitmap": []})
    return merge


def filter_bits(n: int, most: int) -> int:
    """About 16 bits for each of n keys, a power of two, never above ``most``."""
    return min(most, max(SEGMENT, 1 << (16 * max(n, 1) - 1).bit_length()))


def bloom(keys: DataFrame, bits: int, least: int = 1) -> Broadcast:
    """A Bloom filter (two slots a key) of the one non-null bigint column of ``keys``, broadcast as a bit array.

    With ``least=2`` it holds only slots that two or more rows fell into, so a
    key that passes is possibly repeated.  Each task sends its slots as 16-bit
    places by segment; the segments are merged on the executors.  The driver
    and each executor hold ``bits`` / 8 bytes, however many keys there are: a
    filter that is too small lets more keys pass, it never loses one.
    """
    spark = keys.sparkSession
    parts = (keys.mapInArrow(_local_filter(bits), "segment int, once binary, twice binary")
             .groupBy("segment").applyInPandas(_merged(least), "segment int, bitmap binary"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for segment, bitmap in parts.collect():
        out[segment * SEGMENT // 8:(segment + 1) * SEGMENT // 8] = np.frombuffer(bitmap, dtype=np.uint8)
    return spark.sparkContext.broadcast(out)


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys the filter may hold."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    slot = _slots(keys.astype(np.uint64), len(bitmap) * 8)
    hit = (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & np.uint8(1)
    return (hit[:len(keys)] & hit[len(keys):]).astype(bool)


def _mark(at: int, bitmap: Broadcast, name: str) -> Callable:
    def mark(batches):
        for b in batches:
            keys = b.column(at).to_numpy(zero_copy_only=False)
            yield b.append_column(name, pa.array(passes(bitmap.value, keys), pa.bool_()))
    return mark


def marked(df: DataFrame, key: str, bitmap: Broadcast, name: str) -> DataFrame:
    """``df`` with a boolean column: may the filter hold the row's bigint ``key``?"""
    return df.mapInArrow(_mark(df.columns.index(key), bitmap, name),
                         T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())]))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str, most_bits: int) -> DataFrame:
    """``docs`` without the rows that ``dropped`` (id, row_key) names; the other rows keep their place.

    Rows that a Bloom filter of the dropped keys clears are not shuffled;
    the rest meet ``dropped`` in a null-safe anti join on id and key.
    """
    bitmap = bloom(dropped.select("row_key"), filter_bits(dropped.count(), most_bits))
    key, maybe = fresh(docs, "row_key"), fresh(docs, "maybe")
    rows = marked(docs.withColumn(key, row_key(id_col, text_col)), key, bitmap, maybe)
    d = dropped.select(F.col("id").alias("__id"), F.col("row_key").alias("__key")).distinct()
    hit = rows.where(F.col(maybe))
    left = hit.join(d, (hit[key] == d["__key"]) & hit[id_col].eqNullSafe(d["__id"]), "left_anti")
    return rows.where(~F.col(maybe)).select(*docs.columns).union(left.select(*docs.columns))
