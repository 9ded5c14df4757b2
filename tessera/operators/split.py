"""Deterministic train/test splits.

Membership is a pure function of (seed, row id), so the split needs no
shuffle, is stable under repartitioning and survives task retries (unlike
``randomSplit``, whose result depends on partitioning and ordering).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def split_hash(id_col: Column, seed: int) -> Column:
    """32-bit hash in [0, 2^32): first 8 hex digits of md5('<seed>:<id>')."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def assign_split(df: DataFrame, test_size: float = 0.2, seed: int = 200,
                 id_col: str = "sentence_id", out_col: str = "is_test") -> DataFrame:
    """Add ``is_test``: hash / 2^32 < test_size (E1).  Expected share, not exact."""
    h = split_hash(F.col(id_col), seed)
    return df.withColumn(out_col, (h / F.lit(TWO_POW_32)) < F.lit(float(test_size)))


def _locate(counts, key: str, k: int) -> tuple[int, int]:
    """The key holding the k-th row (1-based) in key order, and how many of its rows precede it."""
    before = 0
    for r in sorted(counts, key=lambda r: r[key]):
        if before + r["n"] >= k:
            return r[key], k - before
        before += r["n"]
    raise ValueError("k exceeds the row count")


def assign_split_exact(df: DataFrame, test_size: float = 0.2, seed: int = 200,
                       id_col: str = "sentence_id", out_col: str = "is_test") -> DataFrame:
    """Add ``is_test`` with ceil(test_size * n) test rows.

    Rows are ordered by (hash, id); test is every row up to the pair that
    holds the k-th row, so rows of one id stay together: repeated ids at the
    boundary are all test, and the count is exact when ids are unique.  A
    NULL id hashes as the empty text.  Counts per 16-bit hash bucket, then
    per 32-bit hash in one bucket (each at most 65,536 rows on the driver),
    then per id with that one hash (~n / 2^32 ids) find the pair; the rows
    themselves are decided by one comparison each, in one scan, and are never
    sorted or shuffled.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    tagged = df.withColumn("_h", split_hash(key, seed))
    bucket_of = F.shiftright(F.col("_h"), 16)
    counts = tagged.groupBy(bucket_of.alias("_b")).agg(F.count(F.lit(1)).alias("n")).collect()
    n = sum(r["n"] for r in counts)
    k = math.ceil(test_size * n)
    if k == 0:
        return df.withColumn(out_col, F.lit(False))
    bucket, need = _locate(counts, "_b", k)
    inner = tagged.where(bucket_of == bucket).groupBy("_h").agg(F.count(F.lit(1)).alias("n")).collect()
    edge, need = _locate(inner, "_h", need)
    # NULL ids sort first, as in ORDER BY.
    at_edge = [r for r in tagged.where(F.col("_h") == edge).groupBy(F.col(id_col).alias("id"))
               .agg(F.count(F.lit(1)).alias("n")).orderBy("id").collect()]
    for r in at_edge:
        last = r["id"]
        need -= r["n"]
        if need <= 0:
            break
    up_to_last = F.col(id_col).isNull() if last is None else (F.col(id_col).isNull() | (F.col(id_col) <= F.lit(last)))
    return tagged.withColumn(out_col, (F.col("_h") < edge) | ((F.col("_h") == edge) & up_to_last)).drop("_h")


def assign_split_groups(df: DataFrame, group_cols: tuple[str, ...] = ("group_id", "tweet_id"), test_size: float = 0.2,
                        seed: int = 200, out_col: str = "is_test") -> DataFrame:
    """Add ``is_test`` so that rows of one group (a tweet's sentences) are on one side.

    Groups are ordered by the hash of their key; test are the groups up to
    the one that holds the ceil(test_size * n)-th row, so the test side
    exceeds that number by less than its last group.  The key joins the
    columns by ``/``, which is escaped inside them; NULL parts are told from
    empty ones.
    """
    part = lambda c: F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("%"), F.lit("%25")),
                                          F.lit("/"), F.lit("%2F")), F.lit("%"))
    keyed = df.withColumn("_group", F.concat_ws("/", *[part(c) for c in group_cols]))
    return assign_split_exact(keyed, test_size, seed, "_group", out_col).drop("_group")


def split(df: DataFrame, test_size: float = 0.2, seed: int = 200, id_col: str = "sentence_id",
          exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Return (train, test) DataFrames."""
    fn = assign_split_exact if exact else assign_split
    tagged = fn(df, test_size, seed, id_col, "_is_test")
    return (tagged.where(~F.col("_is_test")).drop("_is_test"),
            tagged.where(F.col("_is_test")).drop("_is_test"))
