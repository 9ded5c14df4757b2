"""Table-level text features.

``text_features`` tokenises once and counts the 11 feature columns in Arrow
batches; ``normalize_text`` lowercases, drops punctuation tokens and
optionally maps forms to lemmas through a user table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import classes, featurizer
from ..session import bound_arrow_batches
from .joins import DEFAULT_BROADCAST_ROWS, merged_by_place, token_lookup
from .partitioning import cluster_by_id

# Names and order of the feature block.
FEATURE_COLUMNS = ["punct_count", "contains_exclamation", "contains_punct_mark", "contains_question_mark",
                   "contains_hashtag", "contains_mention", "capital_char_count", "token_count",
                   "char_length", "emoji_count", "contains_emoji"]


def text_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append the 11 integer features computed on the original-case text.

    Counted in Arrow batches: a word that a batch has many times is tokenised
    once (``functions.tokens``).
    """
    spark = df.sparkSession
    bound_arrow_batches(spark)
    found = F.arrow_udf(featurizer(classes(spark), FEATURE_COLUMNS), ", ".join(f"{n} int" for n in FEATURE_COLUMNS))
    with_all = df.withColumn("_features", found(F.col(text_col)))
    return with_all.select(*df.columns, *[F.col(f"_features.{n}").alias(n) for n in FEATURE_COLUMNS])


def feature_columns(df: DataFrame, exclude=("sentence_id", "text", "labels")) -> list[str]:
    """Every column except the id, text and label."""
    return [c for c in df.columns if c not in exclude]


def normalize_text(df: DataFrame, lemmas: DataFrame | None = None, text_col: str = "text",
                   out_col: str = "norm_text", id_col: str = "sentence_id",
                   max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Lowercase, tokenise, drop punctuation tokens, map to lemmas, join by one space.

    Without a lemma table this is one projection.  With a table
    ``(form, lemma)`` the tokens are looked up where the text lies (the table
    is written once and handed to the tasks behind a size check); one shuffle
    brings the rows of an id together, whose tokens are merged by position.
    Beyond the bound the tokens are exploded, joined to the table and put back
    together.
    """
    if lemmas is None:
        return df.withColumn(out_col, T.join_without_punct(T.tokenize(T.lowercase(F.col(text_col)))))
    toks = T.drop_punct_tokens(T.tokenize(T.lowercase(F.col(text_col))))
    lem = lemmas.select(F.col("form").alias("_form"), F.col("lemma").alias("_lemma")).dropDuplicates(["_form"])
    lem = lem.checkpoint(eager=True)
    lookup = token_lookup(lem, "_form", "_lemma", "string", max_rows=max_broadcast_rows)
    if lookup is not None:
        # A row without an id has no tokens of its id.
        own = F.when(F.col(id_col).isNotNull(), F.col("_w"))
        rows = df.withColumn("_w", lookup(toks)).withColumn("_all", F.collect_list(own).over(Window.partitionBy(id_col)))
        joined = F.array_join(merged_by_place("_all"), " ")
        return rows.withColumn(out_col, F.coalesce(joined, F.lit(""))).drop("_w", "_all")
    df = cluster_by_id(df, id_col)
    ex = df.select(id_col, F.posexplode(toks).alias("_pos", "_form"))
    mapped = ex.join(lem, "_form", "left")
    back = (mapped.groupBy(id_col)
            .agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_lemma", "_form").alias("w"))))
                 .alias("_ws")))
    joined = df.join(back, id_col, "left")
    return joined.withColumn(out_col, F.coalesce(F.array_join(F.col("_ws.w"), " "), F.lit(""))).drop("_ws")
