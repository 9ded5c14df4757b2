"""Sequence encoding and the batched user-function surface (K1-K3).

Token ids come from a word vocabulary fitted on train (pad 0, unknown 1,
known words 2.. in sorted order).  Encoding is a join of exploded tokens to
the vocabulary (the runtime broadcasts it by its measured bytes; otherwise it
is a shuffle join where AQE splits hot words), then one regroup per sentence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.delimited import with_row_index
from .joins import DEFAULT_BROADCAST_ROWS, merged_by_place, token_lookup
from .partitioning import cluster_by_id

PAD_ID, UNK_ID, FIRST_ID = 0, 1, 2


def _tokens(text_col: str, lowercase: bool):
    t = F.col(text_col)
    return T.tokenize(F.lower(t) if lowercase else t)


def fit_token_vocab(train: DataFrame, text_col: str = "text", lowercase: bool = False) -> DataFrame:
    """``(token, token_id)`` over the distinct train tokens, ids from 2 in token order."""
    toks = train.select(F.explode(_tokens(text_col, lowercase)).alias("token")).distinct()
    idx = with_row_index(toks, "token", "_i")
    return idx.select("token", (F.col("_i") + FIRST_ID).cast("int").alias("token_id"))


def encode_tokens(df: DataFrame, vocab: DataFrame, max_len: int = 512, text_col: str = "text",
                  id_col: str = "sentence_id", lowercase: bool = False, pad_to: str = "max_length",
                  batch_col: str | None = None, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Token ids truncated to ``max_len`` and padded, with an attention mask (K1, K2).

    The result has every column of ``df`` but the text (B7).  ``pad_to=
    'max_length'`` pads every row to ``max_len``; ``pad_to='batch'`` pads to
    the longest row of its ``batch_col`` group (never beyond ``max_len``).
    Truncation is the operator's semantics, so tokens past ``max_len`` are
    dropped before the vocabulary join; a text without tokens keeps its row.

    The ids are looked up where the text lies while the vocabulary is within
    ``max_broadcast_rows``; what is shuffled are a sentence's ids as one array.
    Beyond it the tokens are exploded and joined.
    """
    keep = [c for c in df.columns if c != text_col]
    tokens = F.slice(_tokens(text_col, lowercase), 1, max_len)
    lookup = token_lookup(vocab, "token", "token_id", "int", UNK_ID, max_broadcast_rows)
    if lookup is not None:
        rows = df.select(*keep, lookup(tokens).alias("_one")).groupBy(*keep).agg(F.collect_list("_one").alias("_all"))
        rows = rows.select(*keep, merged_by_place("_all").alias("_ids"))
    else:
        ex = cluster_by_id(df, id_col).select(*keep, F.posexplode_outer(tokens).alias("_pos", "token"))
        mapped = ex.join(vocab.select("token", "token_id"), "token", "left")
        piece = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("token_id", F.lit(UNK_ID)).alias("i")))
        rows = (mapped.groupBy(*keep).agg(F.array_sort(F.collect_list(piece)).alias("_s"))
                .select(*keep, F.col("_s.i").alias("_ids")))
    n = F.size("_ids")
    if pad_to == "max_length":
        target = F.lit(max_len)
    elif pad_to == "batch":
        if batch_col is None:
            raise ValueError("pad_to='batch' needs batch_col")
        rows = rows.withColumn("_target", F.max(F.size("_ids")).over(Window.partitionBy(batch_col)))
        target = F.col("_target")
    else:
        raise ValueError(f"unknown pad_to {pad_to!r}")
    pad = F.greatest(target - n, F.lit(0))
    return rows.select(*keep, F.concat(F.col("_ids"), F.array_repeat(F.lit(PAD_ID), pad)).alias("input_ids"),
                       F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad)).alias("attention_mask"))


def map_batches(df: DataFrame, fn: Callable, schema, drop: tuple[str, ...] = (),
                setup: Callable[[], object] | None = None) -> DataFrame:
    """Apply a pandas function to Arrow batches of each partition (K3).

    ``fn(batch)`` runs once per batch inside the executors.  With ``setup``,
    that factory runs once per task (to load a foreign model or tokenizer)
    and ``fn(batch, state)`` gets what it returned (J7).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = () if setup is None else (setup(),)
        for pdf in batches:
            yield fn(pdf, *state)
    src = df.drop(*drop) if drop else df
    return src.mapInPandas(run, schema)
