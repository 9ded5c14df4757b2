"""Evaluation: errors, confusion counts, per-class report, scores.

Every metric starts from one partial + final count per (group, true label,
predicted label); from there on only that table is read, at most (#labels)^2
rows a group, so a hot class never reaches a task as raw rows.  Zeros are
added as rows of the grid (groups x vocabulary) before a second, small sum:
group keys and labels meet in aggregates, never in joins, so NULL groups stay
and empty input still gives the whole grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labels import vocab_from_list, vocab_list

TRUE, PRED = "labels", "prediction"
REPORT_ORDER = {"accuracy": 1, "macro avg": 2, "weighted avg": 3}


def attach_predictions(sentences: DataFrame, predictions: DataFrame, id_col: str = "sentence_id",
                       pred_col: str = PRED) -> DataFrame:
    """Pair each sentence with its prediction by id (C4); replaces a positional zip.

    A sentence without a prediction stays, with a NULL prediction (an error).
    """
    return sentences.join(predictions.select(id_col, pred_col), id_col, "left")


def errors(pred: DataFrame, true_col: str = TRUE, pred_col: str = PRED) -> DataFrame:
    """Keep misclassified rows (B5).  A missing label or prediction counts as an error."""
    return pred.where(F.coalesce(F.col(true_col) != F.col(pred_col), F.lit(True)))


def error_table(pred: DataFrame, text_col: str = "text", true_col: str = TRUE,
                pred_col: str = PRED, id_col: str = "sentence_id") -> DataFrame:
    """Errors renamed to the export names ``Text, True Label, Prediction``."""
    return errors(pred, true_col, pred_col).select(
        F.col(id_col), F.col(text_col).alias("Text"), F.col(true_col).alias("True Label"),
        F.col(pred_col).alias("Prediction"))


def _vocabulary(vocab, spark) -> tuple[DataFrame, int]:
    """The vocabulary ``(label, label_id)`` and its size."""
    if isinstance(vocab, (list, tuple)):
        return vocab_from_list(spark, list(vocab)), len(vocab)
    memo = getattr(vocab, "_tessera_labels", None)
    return vocab.select("label", F.col("label_id").cast("int").alias("label_id")), (
        len(memo) if memo is not None else vocab.count())


def _cells(pred: DataFrame, true_col: str, pred_col: str, by: tuple[str, ...], weights: str | None) -> DataFrame:
    """Rows counted per (by..., t, p); the only read of ``pred``.  With ``weights`` a row stands for that many."""
    return (pred.groupBy(*by, F.col(true_col).alias("t"), F.col(pred_col).alias("p"))
            .agg((F.sum(weights) if weights else F.count(F.lit(1))).cast("bigint").alias("n")))


def _groups(cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The distinct groups; without group columns the one group exists even if there are no rows."""
    return cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()


def _each_label(rows: DataFrame, v: DataFrame, k: int, name: str) -> DataFrame:
    """Every row once per vocabulary label, as ``name`` and ``name_id``: ids are generated, then looked up."""
    ids = rows.withColumn(f"{name}_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) if k else rows.select(
        "*", F.lit(0).alias(f"{name}_id")).where(F.lit(False))
    return ids.join(v.select(F.col("label_id").alias(f"{name}_id"), F.col("label").alias(name)), f"{name}_id")


def confusion(pred: DataFrame, vocab, true_col: str = TRUE, pred_col: str = PRED,
              by: tuple[str, ...] = (), dense: bool = True, weights: str | None = None) -> DataFrame:
    """Long confusion counts ``(true_label, pred_label, n)`` over vocab x vocab.

    Pairs with a label outside the vocabulary are dropped.  ``dense``: cells
    without rows are 0, also on empty input (the definition of the report;
    K^2 rows a group); otherwise only the observed cells are returned, which
    is the form for vocabularies of many thousand labels.
    """
    by = tuple(by)
    v, k = _vocabulary(vocab, pred.sparkSession)
    cells = _cells(pred, true_col, pred_col, by, weights).select(
        *by, F.col("t").alias("true_label"), F.col("p").alias("pred_label"), "n")
    if not dense:
        return (cells.join(v.select(F.col("label").alias("true_label")), "true_label", "left_semi")
                .join(v.select(F.col("label").alias("pred_label")), "pred_label", "left_semi")
                .select(*by, "true_label", "pred_label", "n"))
    grid = _each_label(_each_label(_groups(cells, by), v, k, "true_label"), v, k, "pred_label")
    cell = [*by, "true_label", "pred_label"]
    return (cells.withColumn("known", F.lit(False))
            .unionByName(grid.select(*cell, F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("known")))
            .groupBy(*cell).agg(F.sum("n").alias("n"), F.max("known").alias("known"))
            .where("known").select(*cell, "n"))


def confusion_matrix(pred: DataFrame, vocab, true_col: str = TRUE, pred_col: str = PRED) -> DataFrame:
    """Wide confusion matrix: one row per true label, one column per predicted label."""
    labels = list(vocab) if isinstance(vocab, (list, tuple)) else vocab_list(vocab)  # the result's column names
    long = confusion(pred, vocab, true_col, pred_col)
    return (long.groupBy("true_label").pivot("pred_label", labels).agg(F.sum("n"))
            .na.fill(0).orderBy("true_label"))


_COUNTS = ("support", "predicted", "tp", "n_rows", "n_hits")


def class_counts(pred: DataFrame, vocab, true_col: str = TRUE, pred_col: str = PRED,
                 by: tuple[str, ...] = (), weights: str | None = None) -> tuple[DataFrame, int]:
    """Per (by..., label): support, predicted and true-positive counts; and the vocabulary size.

    Each group also has a totals row (label NULL) with its row and hit
    counts, which include rows whose labels are NULL or unknown.  Labels of
    the vocabulary without rows have zeros; other labels have no row.
    """
    v, k = _vocabulary(vocab, pred.sparkSession)
    cells = _cells(pred, true_col, pred_col, by, weights)
    zero, none = F.lit(0).cast("bigint"), F.lit(None)
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero)

    def entry(label, support=zero, predicted=zero, tp=zero, n_rows=zero, n_hits=zero):
        return F.struct(label.cast("string").alias("label"), *[
            c.alias(name) for name, c in zip(_COUNTS, (support, predicted, tp, n_rows, n_hits))])

    sides = F.array(F.when(F.col("t").isNotNull(), entry(F.col("t"), support=F.col("n"), tp=hit)),
                    F.when(F.col("p").isNotNull(), entry(F.col("p"), predicted=F.col("n"))),
                    entry(none, n_rows=F.col("n"), n_hits=hit))
    seen = (cells.select(*by, F.explode(sides).alias("e")).where(F.col("e").isNotNull())
            .select(*by, "e.*", none.cast("int").alias("label_id"), F.lit(False).alias("known")))
    groups = _groups(cells, by)
    zeros = [zero.alias(c) for c in _COUNTS]
    grid = _each_label(groups, v, k, "label").select(*by, "label", *zeros, "label_id", F.lit(True).alias("known"))
    totals = groups.select(*by, none.cast("string").alias("label"), *zeros, none.cast("int").alias("label_id"),
                           F.lit(True).alias("known"))
    out = (seen.unionByName(grid).unionByName(totals).groupBy(*by, "label")
           .agg(*[F.sum(c).alias(c) for c in _COUNTS], F.max("label_id").alias("label_id"), F.max("known").alias("known"))
           .where("known").drop("known"))
    return out, k


def _metric_rows(pred: DataFrame, vocab, true_col: str, pred_col: str, by: tuple[str, ...], weights: str | None):
    """Per-label metrics plus each group's totals row (label NULL), and K."""
    counts, k = class_counts(pred, vocab, true_col, pred_col, by, weights)
    tp, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    is_label = F.col("label").isNotNull()
    safe = lambda num, den: F.when(den > 0, num / den).otherwise(F.lit(0.0))
    m = counts.select(
        *by, "label", "label_id",
        F.when(is_label, safe(tp.cast("double"), prd)).alias("precision"),
        F.when(is_label, safe(tp.cast("double"), sup)).alias("recall"),
        F.when(is_label, safe(2.0 * tp, prd + sup)).alias("f1_score"),
        "support", "n_rows", "n_hits")
    return m, k


def per_class(pred: DataFrame, vocab, true_col: str = TRUE, pred_col: str = PRED,
              by: tuple[str, ...] = (), weights: str | None = None) -> DataFrame:
    """Per-class precision, recall, F1 and support over the vocabulary; 0/0 -> 0."""
    by = tuple(by)
    m, _ = _metric_rows(pred, vocab, true_col, pred_col, by, weights)
    return m.where(F.col("label").isNotNull()).select(*by, "label", "label_id", "precision", "recall",
                                                      "f1_score", "support")


def classification_report(pred: DataFrame, vocab, true_col: str = TRUE, pred_col: str = PRED,
                          by: tuple[str, ...] = (), weights: str | None = None) -> DataFrame:
    """Label rows, then accuracy, macro avg and weighted avg.

    Columns: ``by..., label, precision, recall, f1_score, support, row_order``.
    The accuracy row carries the accuracy in all three metric columns and the
    row count as support.  The averages are window sums over the K + 1 rows
    of each group, and each totals row turns into the three summary rows.
    """
    by = tuple(by)
    m, k = _metric_rows(pred, vocab, true_col, pred_col, by, weights)

    def out(label, p, r, f, sup, order):
        return F.struct(label.alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
                        sup.cast("bigint").alias("support"), F.lit(order).cast("int").alias("row_order")
                        if isinstance(order, int) else order.cast("int").alias("row_order"))

    wavg = lambda c: F.when(F.col("s") > 0, F.col(c) / F.col("s")).otherwise(F.lit(0.0))
    acc = F.when(F.col("n_rows") > 0, F.col("n_hits") / F.col("n_rows")).otherwise(F.lit(0.0))
    summary = F.array(
        out(F.lit("accuracy"), acc, acc, acc, F.col("n_rows"), k + REPORT_ORDER["accuracy"]),
        out(F.lit("macro avg"), F.coalesce("mp", F.lit(0.0)), F.coalesce("mr", F.lit(0.0)),
            F.coalesce("mf", F.lit(0.0)), F.col("s"), k + REPORT_ORDER["macro avg"]),
        out(F.lit("weighted avg"), wavg("wp"), wavg("wr"), wavg("wf"), F.col("s"),
            k + REPORT_ORDER["weighted avg"]))
    own = out(F.col("label"), F.col("precision"), F.col("recall"), F.col("f1_score"), F.col("support"),
              F.col("label_id"))
    sums = dict(mp=F.avg("precision"), mr=F.avg("recall"), mf=F.avg("f1_score"), s=F.sum("support"),
                wp=F.sum(F.col("precision") * F.col("support")), wr=F.sum(F.col("recall") * F.col("support")),
                wf=F.sum(F.col("f1_score") * F.col("support")))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    m = m.select("*", *[e.over(w).alias(n) for n, e in sums.items()])
    rows = F.when(F.col("label").isNull(), summary).otherwise(F.array(own))
    return m.select(*by, F.explode(rows).alias("o")).select(*by, "o.*")


def score(pred: DataFrame, vocab, true_col: str = TRUE, pred_col: str = PRED,
          by: tuple[str, ...] = (), weights: str | None = None) -> DataFrame:
    """Scalar ``macro_f1`` and ``weighted_f1`` (plus accuracy) per ``by`` group."""
    by = tuple(by)
    rep = classification_report(pred, vocab, true_col, pred_col, by, weights)
    return rep.groupBy(*by).agg(
        F.max(F.when(F.col("label") == "macro avg", F.col("f1_score"))).alias("macro_f1"),
        F.max(F.when(F.col("label") == "weighted avg", F.col("f1_score"))).alias("weighted_f1"),
        F.max(F.when(F.col("label") == "accuracy", F.col("f1_score"))).alias("accuracy"))


def best_run(metrics: DataFrame, metric: str = "macro_f1", run_cols: tuple[str, ...] = ("run_id",),
             by: tuple[str, ...] = ()) -> DataFrame:
    """The run with the largest ``metric``; ties go to the smallest run key.

    One aggregate, no sort; run keys may be of any orderable type.  A NULL or
    NaN metric is worse than any number.
    """
    bad = F.col(metric).isNull() | F.isnan(metric)
    rank = F.struct(bad.alias("bad"), F.when(~bad, -F.col(metric)).alias("down"), *run_cols)
    best = F.min_by(F.struct(*run_cols, metric), rank).alias("_best")
    out = metrics.groupBy(*by).agg(best)
    return out.select(*by, *[F.col(f"_best.{c}").alias(c) for c in run_cols], F.col(f"_best.{metric}").alias(metric))
