"""Label schemes, vocabularies and label look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.delimited import with_row_index
from .joins import join_small

# ---------------------------------------------------------------------------
# Fixed values of the annotation scheme (must equal the source corpus rules).
# Coarse classes merged into one class in the 'coarse_merged' scheme:
MERGED_COARSE = ["COMMISSIVE", "OTHER"]
# All coarse classes, in id order:
COARSE_CLASSES = ["ASSERTIVE", "COMMISSIVE", "DIRECTIVE", "EXPRESSIVE", "OTHER", "UNSURE"]
MERGED_NAME = "COMOTH"
# Fine labels folded into one class in the 'fine' scheme (rare in the corpus):
EXCLUDED_FINE = ["DISAGREE", "APOLOGIZE", "THANK", "GREET"]
EXCLUDED_NAME = "EXCLUDED"
# Coarse class that has no fine sub-classes:
COMMISSIVE = "COMMISSIVE"
# ---------------------------------------------------------------------------

SCHEMES = ("coarse", "coarse_merged", "fine")

# Largest vocabulary materialised on the driver; larger ones stay distributed.
MAX_LABELS = 100_000


def scheme_label(version: str, coarse: Column, fine: Column) -> Column:
    """The label expression of one scheme (B1-B3), as a Column."""
    if version == "coarse":
        return coarse
    if version == "coarse_merged":
        return F.when(coarse.isin(MERGED_COARSE), F.lit(MERGED_NAME)).otherwise(coarse)
    if version == "fine":
        # Order matters: the exclusion test comes first.
        return (F.when(fine.isin(EXCLUDED_FINE), F.lit(EXCLUDED_NAME))
                .when(coarse == F.lit(COMMISSIVE), F.lit(COMMISSIVE))
                .otherwise(fine))
    raise ValueError(f"unknown label scheme {version!r}; expected one of {SCHEMES}")


def label_scheme(sentences: DataFrame, version: str, keep: tuple[str, ...] = ("sentence_id",)) -> DataFrame:
    """Project a flattened sentence table to ``keep + (text, labels)``."""
    lab = scheme_label(version, F.col("coarse"), F.col("fine"))
    cols = [c for c in keep if c in sentences.columns]
    return sentences.select(*cols, "text", lab.alias("labels"))


def scheme_vocab(spark, version: str, train: DataFrame | None = None) -> DataFrame:
    """The vocabulary of a scheme with its ids: fixed for the coarse schemes (a class may be absent from train),
    taken from ``train`` for the fine one."""
    if version == "coarse":
        return vocab_from_list(spark, COARSE_CLASSES)
    if version == "coarse_merged":
        return vocab_from_list(spark, sorted({MERGED_NAME if c in MERGED_COARSE else c for c in COARSE_CLASSES}))
    if version == "fine" and train is not None:
        return label_vocab(train)
    raise ValueError(f"no vocabulary for scheme {version!r}; the fine scheme needs its train rows")


# Largest rare-label set applied as a literal IN list (no join).
INLINE_RARE = 1_000


def fold_rare_labels(df: DataFrame, min_count: int = 10, label_col: str = "labels",
                     into: str = EXCLUDED_NAME) -> DataFrame:
    """Replace labels seen fewer than ``min_count`` times in ``df`` by ``into``.

    Counting is a partial + final hash aggregate, so a hot label costs no more
    than one row per map task.  The rare labels (a subset of the vocabulary)
    are collected under a bound and applied as an IN list, so ``df`` is
    aggregated once and not joined; a larger rare set is joined back, that
    side broadcast only after its size is checked.
    """
    rare = (df.groupBy(label_col).count()
            .where(F.col("count") < min_count)
            .select(F.col(label_col).alias("_rare_label"), F.lit(True).alias("_is_rare")))
    found = rare.limit(INLINE_RARE + 1).collect()
    if len(found) <= INLINE_RARE:
        names = [r["_rare_label"] for r in found if r["_rare_label"] is not None]
        is_rare = F.col(label_col).isin(names) if names else F.lit(False)
        return df.withColumn(label_col, F.when(is_rare, F.lit(into)).otherwise(F.col(label_col)))
    joined = join_small(df, rare, df[label_col] == rare["_rare_label"], "left")
    return (joined
            .withColumn(label_col, F.when(F.col("_is_rare"), F.lit(into)).otherwise(F.col(label_col)))
            .drop("_rare_label", "_is_rare"))


def label_vocab(train: DataFrame, label_col: str = "labels", max_labels: int = MAX_LABELS) -> DataFrame:
    """Sorted distinct train labels with dense ids from 0.

    The distinct set is computed by the cluster.  Up to ``max_labels``
    labels the vocabulary is materialised on the driver, so later joins can
    broadcast it and metrics can inline it.  Beyond that it stays
    distributed: a range-sorted, checkpointed table with a dense index, and
    later joins are shuffle joins.
    """
    spark = train.sparkSession
    distinct = train.select(F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct()
    labels = distinct.limit(max_labels + 1).collect()
    if len(labels) > max_labels:
        return with_row_index(distinct, "label", "label_id").select(
            "label", F.col("label_id").cast("int").alias("label_id"))
    names = sorted(r["label"] for r in labels)
    return vocab_from_list(spark, names)


def vocab_from_list(spark, names: list[str]) -> DataFrame:
    """A vocabulary DataFrame for the given labels, ids in list order."""
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "label string, label_id int")
    df._tessera_labels = list(names)  # memo: the labels are known without a job
    return df


def _known_size(vocab: DataFrame) -> int | None:
    """Row count of a vocabulary built from a driver-side list, else None."""
    memo = getattr(vocab, "_tessera_labels", None)
    return None if memo is None else len(memo)


def vocab_list(vocab: DataFrame) -> list[str]:
    """Labels of a materialised vocabulary in id order (a few rows)."""
    memo = getattr(vocab, "_tessera_labels", None)
    if memo is not None:
        return list(memo)
    return [r["label"] for r in vocab.orderBy("label_id").collect()]


def encode_labels(df: DataFrame, vocab: DataFrame, label_col: str = "labels",
                  out_col: str = "label_id", strict: bool = True) -> DataFrame:
    """Label -> id through the vocabulary (C2).  Unseen labels raise when ``strict``."""
    v = vocab.select(F.col("label").alias("_enc_label"), F.col("label_id").alias(out_col))
    joined = join_small(df, v, df[label_col] == v["_enc_label"], "left",
                        known_rows=_known_size(vocab)).drop("_enc_label")
    if strict:
        joined = joined.withColumn(
            out_col,
            F.when(F.col(out_col).isNull() & F.col(label_col).isNotNull(),
                   F.raise_error(F.concat(F.lit("label not in vocabulary: "), F.col(label_col))))
            .otherwise(F.col(out_col)).cast("int"))
    return joined


def decode_labels(df: DataFrame, vocab: DataFrame, id_col: str = "prediction_id",
                  out_col: str = "prediction") -> DataFrame:
    """Id -> label through the vocabulary."""
    v = vocab.select(F.col("label").alias(out_col), F.col("label_id").alias("_dec_id"))
    return join_small(df, v, df[id_col] == v["_dec_id"], "left", known_rows=_known_size(vocab)).drop("_dec_id")


def unseen_labels(train: DataFrame, test: DataFrame, label_col: str = "labels") -> DataFrame:
    """Labels present in ``test`` but absent from ``train``, with their counts."""
    test_counts = test.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n_test"))
    train_labels = train.select(F.col(label_col).alias("label")).distinct()
    return test_counts.join(train_labels, "label", "left_anti")


def label_counts(train: DataFrame, test: DataFrame, label_col: str = "labels") -> DataFrame:
    """Per train label: count in train and in test, sorted by label.

    One aggregate over the union replaces a count per label and a left join:
    labels seen only in test have ``n_train = 0`` and are dropped, which is
    exactly the left join of the train vocabulary to the test counts.
    """
    both = (train.select(F.col(label_col).alias("label"), F.lit(False).alias("_t"))
            .unionByName(test.select(F.col(label_col).alias("label"), F.lit(True).alias("_t"))))
    return (both.where(F.col("label").isNotNull())
            .groupBy("label")
            .agg(F.count_if(~F.col("_t")).alias("train"), F.count_if(F.col("_t")).alias("test"))
            .where(F.col("train") > 0)
            .orderBy("label"))


def num_classes(df: DataFrame, label_col: str = "labels") -> DataFrame:
    """Number of distinct non-null labels (D3)."""
    return df.agg(F.count_distinct(F.col(label_col)).alias("num_classes"))
