"""Join helpers: broadcast only behind a measured size bound."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_arrow_batches

# Largest side (in rows) we are willing to ship to every executor.  Label
# vocabularies are tens of rows; an n-gram IDF table is at most a few million.
DEFAULT_BROADCAST_ROWS = 2_000_000


def is_bounded(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows+1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left",
               max_rows: int = DEFAULT_BROADCAST_ROWS, known_rows: int | None = None) -> DataFrame:
    """Join ``big`` to ``small``, broadcasting ``small`` only if its size is checked.

    ``known_rows`` is the exact row count when the caller built ``small``
    from a list it holds (a materialised vocabulary); otherwise a bounded
    count job measures it.  Beyond the bound the plain join is kept: a
    shuffle join on the key, where AQE's skew-join splitting handles hot keys.
    """
    bounded = known_rows <= max_rows if known_rows is not None else is_bounded(small, max_rows)
    if bounded:
        small = F.broadcast(small)
    return big.join(small, on, how)


def token_lookup(small: DataFrame, key: str, value: str, kind: str, default: int | None = None,
                 max_rows: int = DEFAULT_BROADCAST_ROWS) -> Callable[[Column], Column] | None:
    """A function of an array<string> column: every token's ``value`` of ``small``, in its place, or none beyond ``max_rows``.

    ``small`` (unique keys; read twice) is handed to the tasks once its size is
    checked, so no row per token is made, shuffled or put together again.  A
    token that it does not hold gives ``default``, or itself; NULL arrays are empty.
    """
    if not is_bounded(small, max_rows):
        return None
    table = small.where(F.col(key).isNotNull()).select(key, value).toArrow()
    spark = small.sparkSession
    bound_arrow_batches(spark)
    columns = [table.column(c).combine_chunks() if table.num_rows else pa.array([], table.schema.field(c).type) for c in (key, value)]
    shared = spark.sparkContext.broadcast(columns)

    def found(tokens: pa.Array) -> pa.Array:
        keys, values = shared.value
        flat = tokens.flatten().dictionary_encode()
        at = pc.index_in(flat.dictionary, value_set=keys.cast(flat.dictionary.type))
        each = values.take(at)
        each = pc.fill_null(each, default) if default is not None else pc.coalesce(each, flat.dictionary.cast(values.type))
        length = pc.fill_null(pc.list_value_length(tokens), 0)
        ends = pc.cumulative_sum(length).cast(pa.int32())
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), each.take(flat.indices))

    return F.arrow_udf(found, f"array<{kind}>")


def merged_by_place(lists: str) -> Column:
    """The tokens of several arrays (an array of arrays) by place in their array, then by value."""
    placed = F.transform(F.col(lists), lambda a: F.transform(a, lambda x, i: F.struct(i.alias("_pos"), x.alias("w"))))
    return F.when(F.size(lists) == 1, F.col(lists)[0]).otherwise(F.array_sort(F.flatten(placed))["w"])
