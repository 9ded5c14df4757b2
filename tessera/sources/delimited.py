"""Split files (TSV) and error files (CSV).

Both are written as a folder of part files by the executors; nothing passes
through the driver.  Readers take an explicit schema (no inference) and
``multiLine`` so quoted newlines survive the round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT_SCHEMA = T.StructType([T.StructField("text", T.StringType()),
                             T.StructField("labels", T.StringType())])
SPLIT_SCHEMA_WITH_ID = T.StructType([T.StructField("sentence_id", T.StringType()),
                                     T.StructField("text", T.StringType()),
                                     T.StructField("labels", T.StringType())])
ERROR_SCHEMA = T.StructType([T.StructField("row_id", T.LongType()),
                             T.StructField("Text", T.StringType()),
                             T.StructField("True Label", T.StringType()),
                             T.StructField("Prediction", T.StringType())])

# Quote with '"' and escape a quote by doubling it; keep surrounding blanks.
_QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
            "ignoreTrailingWhiteSpace": False, "encoding": "UTF-8"}


def write_tsv(df: DataFrame, path: str, columns=("text", "labels"), mode: str = "overwrite") -> None:
    """Write a split as tab-separated text with a header and no index (A4)."""
    (df.select(*columns).write.mode(mode).options(sep="\t", header=True, **_QUOTING).csv(path))


def read_tsv(spark: SparkSession, path: str, with_id: bool = False) -> DataFrame:
    """Read a split written by ``write_tsv`` (A5)."""
    schema = SPLIT_SCHEMA_WITH_ID if with_id else SPLIT_SCHEMA
    return (spark.read.schema(schema)
            .options(sep="\t", header=True, multiLine=True, mode="FAILFAST", **_QUOTING).csv(path))


def with_row_index(df: DataFrame, order_col: str, out_col: str = "row_id") -> DataFrame:
    """Dense 0..n-1 index in ``order_col`` order, without a single-task window.

    The rows are range-sorted and checkpointed to the shared checkpoint folder
    (fixed partitions, survives executor loss); each partition then adds its
    offset, taken from per-partition counts (one small row per partition).
    """
    sorted_df = df.orderBy(order_col).checkpoint(eager=True)
    pid = F.spark_partition_id()
    counts = {r["p"]: r["n"] for r in
              sorted_df.groupBy(pid.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, run = [], 0
    for p in range(sorted_df.rdd.getNumPartitions()):
        offsets.append(run)
        run += counts.get(p, 0)
    off = F.element_at(F.array(*[F.lit(o) for o in offsets] or [F.lit(0)]), pid + 1)
    local = F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), 33)
    return sorted_df.select((off + local).cast("bigint").alias(out_col), *df.columns)


def write_errors(errors_df: DataFrame, path: str, order_col: str = "sentence_id",
                 mode: str = "overwrite") -> None:
    """Write ``Text, True Label, Prediction`` with a leading unnamed index."""
    indexed = with_row_index(errors_df, order_col)
    out = indexed.select(F.col("row_id").alias(""), "Text", "True Label", "Prediction")
    # emptyValue '' writes the unnamed index header cell bare: ",Text,...".
    out.write.mode(mode).options(sep=",", header=True, emptyValue="", **_QUOTING).csv(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """Read an error CSV; the unnamed index column becomes ``row_id``."""
    return (spark.read.schema(ERROR_SCHEMA)
            .options(sep=",", header=True, multiLine=True, mode="FAILFAST", **_QUOTING).csv(path))
