"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cluster_by_id(df: DataFrame, id_col: str = "sentence_id") -> DataFrame:
    """Hash-partition on the id; the runtime sizes the partitions from what it measures.

    Later aggregations and windows keyed by the id (or by the id plus more
    columns) reuse this partitioning without another exchange; Spark also
    collapses a repeated request for the same partitioning into one.
    """
    return df.repartition(id_col)


#: Below so many splits a core a scan is spread, into so many partitions a split and a core.
_FEW, _SPREAD = 16, 4


def spread_if_few(df: DataFrame, id_col: str = "sentence_id") -> DataFrame:
    """For CPU-heavy text work: spread a scan of few splits over the cores.

    A row group is read by one task, however many splits its bytes are planned
    as: four splits of a file with a single row group are one busy task and
    three empty ones.  The partitions grow in number with the splits, that is
    with the bytes, so the longest task does not grow with the input.  Inputs of
    many splits a core are left as they are.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(_SPREAD * max(cores, splits), id_col) if splits < _FEW * cores else df


#: At most so many times ``rows_per_task`` rows a partition, and no more partitions than so many a core before that.
_MOST, _WAVES = 5, 3


def dealt(df: DataFrame, n_rows: int, rows_per_task: int, id_col: str = "sentence_id") -> DataFrame:
    """About ``rows_per_task`` of the ``n_rows`` rows a partition, for rows that grow when they are worked on.

    With more partitions than a few a core, up to five times as many rows each.
    A scan of many small files packs them by their bytes; fewer partitions than
    wanted are dealt anew by the id, more are joined without a shuffle.
    """
    busy = -(-n_rows // (_WAVES * df.sparkSession.sparkContext.defaultParallelism))
    rows = min(_MOST * rows_per_task, max(rows_per_task, busy))
    want, have = max(1, -(-n_rows // rows)), df.rdd.getNumPartitions()
    return df.repartition(want, id_col) if have < want else df.coalesce(want) if have > want else df
