"""Training by epochs on the long feature table, with its state in written tables.

A multinomial logistic regression (softmax, one weight per term and class) is
trained from ``(id, label_id, term, value)`` rows, or from the same as lists,
``(id, label_id, terms, values)``, so there is no vocabulary on the driver and
no bound on the number of terms.  After every epoch the weights and the scores
on the validation rows are written; a run that was interrupted goes on behind
its last whole epoch, and the best epoch is loaded at the end.

One step is one pass over the documents, kept as lists, partitioned and sorted
by id: in each Arrow batch they meet the (size-checked) shared weights, their
margins are summed and the gradients of all classes leave the batch as one row
a term, which one aggregate sums.  No row per term of a document is moved.
Beyond the size bound the weights stay a table: the rows meet them in a shuffle
join and a window over the document sums its margins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import labels as L
from . import metrics as M
from ..session import bound_arrow_batches
from .joins import DEFAULT_BROADCAST_ROWS, is_bounded
from .tfidf import packed, starts

#: The term of the intercept: every document holds it once, with value 1; no n-gram is empty.
INTERCEPT = ""


@dataclass(frozen=True)
class Schedule:
    """Epochs of ``batches`` steps; the step size rises linearly over ``warmup`` of the steps, then falls to zero.

    ``decay`` shrinks the weights (not the intercept) by ``rate * decay`` a
    step.  With several batches a document's batch follows from a hash of the
    seed, the epoch and its id.
    """

    epochs: int = 10
    batches: int = 1
    rate: float = 2.0
    warmup: float = 0.1
    decay: float = 0.01
    seed: int = 123

    def step_size(self, step: int) -> float:
        total = self.epochs * self.batches
        warm = min(-(-int(total * self.warmup * 1000) // 1000) or 1, total)
        return self.rate * ((step + 1) / warm if step < warm else (total - step) / (total - warm + 1))


def long_rows(labelled: DataFrame, weights: DataFrame, id_col: str = "sentence_id") -> DataFrame:
    """``(id, label_id, term, value)`` of documents ``(id, label_id)`` and their term weights, with the intercept.

    A document without terms has its intercept row only.
    """
    terms = weights.select(id_col, "term", F.col("weight").alias("value")).join(
        labelled.select(id_col, "label_id"), id_col)
    own = labelled.select(id_col, F.lit(INTERCEPT).alias("term"), F.lit(1.0).alias("value"), "label_id")
    return terms.unionByName(own).select(id_col, "label_id", "term", "value")


def list_rows(labelled: DataFrame, weights: DataFrame, id_col: str = "sentence_id") -> DataFrame:
    """``long_rows`` as lists, from weights ``(id, terms, values)``: ``(id, label_id, terms, values)``.

    A document may have several rows; the intercept is one of them.
    """
    terms = weights.select(id_col, "terms", "values").join(labelled.select(id_col, "label_id"), id_col)
    own = labelled.select(id_col, F.array(F.lit(INTERCEPT)).alias("terms"), F.array(F.lit(1.0)).alias("values"), "label_id")
    return terms.unionByName(own).select(id_col, "label_id", "terms", "values")


def _as_lists(rows: DataFrame, id_col: str) -> DataFrame:
    return rows if "terms" in rows.columns else packed(rows, (id_col, "label_id"), "value")


def as_long(rows: DataFrame, id_col: str = "sentence_id") -> DataFrame:
    """``(id, label_id, term, value)`` of rows that hold lists."""
    pairs = rows.select(id_col, "label_id", F.explode(F.arrays_zip("terms", "values")).alias("p"))
    return pairs.select(id_col, "label_id", F.col("p.terms").alias("term"), F.col("p.values").alias("value"))


def by_document(rows: DataFrame, id_col: str = "sentence_id") -> DataFrame:
    """The rows kept in memory (then on disk), partitioned and sorted by document; recomputed if an executor is lost."""
    keys = [id_col, "label_id"]
    return rows.repartition(id_col).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)


def _margins(rows: DataFrame, weights: DataFrame, k: int, n_terms: int, id_col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with its document's margins ``z0..``, beside every weight row of its term."""
    small = F.broadcast(weights) if n_terms <= DEFAULT_BROADCAST_ROWS else weights
    doc = Window.partitionBy(id_col, *keys)
    met = rows.join(small, "term", "left")
    return met.select(*rows.columns, *keys, *[
        F.coalesce(F.sum(F.col("value") * F.col("w")[c]).over(doc), F.lit(0.0)).alias(f"z{c}") for c in range(k)])


def _total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def gradient_step(rows: DataFrame, weights: DataFrame, k: int, n_docs: int, rate: float, decay: float,
                  n_terms: int, id_col: str = "sentence_id") -> DataFrame:
    """``(term, w)`` after one step on all of ``rows``: w * (1 - rate * decay) - rate * gradient / n_docs."""
    z = _margins(rows, weights, k, n_terms, id_col)
    top = F.greatest(*[F.col(f"z{c}") for c in range(k)]) if k > 1 else F.col("z0")
    z = z.select("*", *[F.exp(F.col(f"z{c}") - top).alias(f"e{c}") for c in range(k)])
    total = _total([F.col(f"e{c}") for c in range(k)])
    push = z.groupBy("term").agg(*[
        F.sum(F.col("value") * (F.col(f"e{c}") / total - (F.col("label_id") == c).cast("double"))).alias(f"g{c}")
        for c in range(k)])
    return _moved(push, weights, k, n_docs, rate, decay)


def predict_long(rows: DataFrame, weights: DataFrame, k: int, n_terms: int, id_col: str = "sentence_id") -> DataFrame:
    """``(id, label_id, prediction_id)`` of every document: the class with the largest margin, the first of equal ones.

    Sums by document in partial aggregates; the rows need not be partitioned.
    """
    small = F.broadcast(weights) if n_terms <= DEFAULT_BROADCAST_ROWS else weights
    z = rows.join(small, "term", "left").groupBy(id_col, "label_id").agg(F.array(*[
        F.coalesce(F.sum(F.col("value") * F.col("w")[c]), F.lit(0.0)) for c in range(k)]).alias("z"))
    return z.select(id_col, "label_id", (F.array_position("z", F.array_max("z")) - 1).cast("int").alias("prediction_id"))


class SharedWeights:
    """``(term, w)`` handed to the tasks; its size was checked."""

    def __init__(self, weights: DataFrame, k: int):
        table = weights.toArrow().combine_chunks()
        lists = table.column("w").combine_chunks() if table.num_rows else None
        w = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, k) if table.num_rows else np.zeros((0, k))
        # The last row is that of the terms without a weight.
        w = np.concatenate([w, np.zeros((1, k))])
        terms = table.column("term").combine_chunks().cast(pa.string()) if table.num_rows else pa.array([], pa.string())
        self.n_terms = table.num_rows
        self.value = weights.sparkSession.sparkContext.broadcast((terms, w))


class _Batch:
    """Rows ``(id, label_id, terms, values)`` as flat arrays, and the margins of their documents (runs of equal keys)."""

    def __init__(self, b: pa.Table, shared, keys: int):
        terms, w = shared.value
        lists, self.values = b.column(2), b.column(3).flatten().to_numpy(zero_copy_only=False)
        flat = lists.flatten().cast(pa.string()).dictionary_encode()
        self.codes, self.terms = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        self.first = starts(b.columns[:keys], len(b))
        run = np.zeros(len(b), dtype=np.int64)
        run[self.first] = 1
        rows = np.repeat(np.arange(len(b)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        self.rows, self.run = rows, (np.cumsum(run) - 1)[rows]
        at = pc.index_in(self.terms, value_set=terms)
        met = w[pc.fill_null(at, len(terms)).to_numpy(zero_copy_only=False)]
        self.z = np.stack([np.bincount(self.run, self.values * met[self.codes, c], minlength=len(self.first))
                           for c in range(w.shape[1])], axis=1)


def _whole_documents(batches, keys: int):
    """Batches cut between documents: the rows of the last one (by its first ``keys`` columns) wait for the next batch."""
    held = []
    for b in batches:
        if not len(b):
            continue
        if held and any(held[-1].column(c)[len(held[-1]) - 1].as_py() != b.column(c)[0].as_py() for c in range(keys)):
            yield _joined(held)
            held = []
        cut = int(starts(b.columns[:keys], len(b))[-1])
        if cut:
            yield _joined([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _gradients(shared, k: int):
    def push(batches):
        for b in _whole_documents(batches, 1):
            x = _Batch(b, shared, 1)
            e = np.exp(x.z - x.z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            label = b.column(1).to_numpy(zero_copy_only=False)[x.rows]
            g = [pa.array(np.bincount(x.codes, x.values * (p[x.run, c] - (label == c)), minlength=len(x.terms)))
                 for c in range(k)]
            yield pa.RecordBatch.from_arrays([x.terms, *g], ["term", *[f"g{c}" for c in range(k)]])
    return push


def _predicted(shared):
    def predict(batches):
        for b in _whole_documents(batches, 2):
            x = _Batch(b, shared, 2)
            at = pa.array(x.first)
            yield pa.RecordBatch.from_arrays([b.column(1).take(at), pa.array(x.z.argmax(axis=1).astype(np.int32))],
                                             ["label_id", "prediction_id"])
    return predict


def _moved(push: DataFrame, weights: DataFrame, k: int, n_docs: int, rate: float, decay: float) -> DataFrame:
    """``(term, w)`` after one step, from sums ``(term, g0..)`` of gradients."""
    keep = F.when(F.col("term") == INTERCEPT, F.lit(1.0)).otherwise(F.lit(1.0 - rate * decay))
    moved = push.select("term", *[(F.lit(-rate) * (F.col(f"g{c}") / n_docs)).alias(f"g{c}") for c in range(k)])
    old = weights.select("term", *[(keep * F.col("w")[c]).alias(f"g{c}") for c in range(k)])
    both = old.unionByName(moved).groupBy("term").agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in range(k)])
    return both.select("term", F.array(*[F.col(f"g{c}") for c in range(k)]).alias("w"))


def list_step(rows: DataFrame, weights: DataFrame, shared: SharedWeights, k: int, n_docs: int, rate: float,
              decay: float) -> DataFrame:
    """``gradient_step`` on ``by_document`` rows that hold lists, with the weights handed to the tasks."""
    push = rows.mapInArrow(_gradients(shared.value, k), "term string, " + ", ".join(f"g{c} double" for c in range(k)))
    return _moved(push, weights, k, n_docs, rate, decay)


class EpochRun:
    """The written state of one run: ``epoch=<e>/weights`` and ``epoch=<e>/scores`` under its folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _whole(self, epoch: int) -> bool:
        """An epoch counts once its scores are committed, which are written after its weights."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch={epoch}/scores/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def done(self) -> int:
        """How many epochs are whole."""
        n = 0
        while self._whole(n + 1):
            n += 1
        return n

    def weights(self, epoch: int) -> DataFrame:
        """``(term, w)`` after an epoch; before the first one there are none."""
        if epoch == 0:
            return self.spark.createDataFrame([], "term string, w array<double>")
        return self.spark.read.schema("term string, w array<double>").parquet(f"{self.path}/epoch={epoch}/weights")

    def scores(self) -> DataFrame:
        """``(epoch, macro_f1, weighted_f1, accuracy)`` of the whole epochs."""
        parts = [self.spark.read.parquet(f"{self.path}/epoch={e}/scores").withColumn("epoch", F.lit(e))
                 for e in range(1, self.done() + 1)]
        return reduce(DataFrame.unionByName, parts).select("epoch", "macro_f1", "weighted_f1", "accuracy")

    def best(self, metric: str = "macro_f1") -> int:
        """The epoch with the largest metric, the earliest of equal ones."""
        return M.best_run(self.scores(), metric, ("epoch",)).first()["epoch"]


def _batch(rows: DataFrame, schedule: Schedule, epoch: int, batch: int, id_col: str) -> DataFrame:
    if schedule.batches == 1:
        return rows
    h = F.md5(F.concat(F.lit(f"{schedule.seed}:{epoch}:"), F.col(id_col).cast("string")).cast("binary"))
    return rows.where(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % schedule.batches == batch)


def train_epochs(train: DataFrame, valid: DataFrame, vocab: DataFrame, path: str, schedule: Schedule = Schedule(),
                 until: int | None = None, id_col: str = "sentence_id") -> EpochRun:
    """Train on ``train``, score every epoch on ``valid`` (both ``long_rows``), keep all state under ``path``.

    Goes on behind the last whole epoch that ``path`` holds, so a run that
    failed or was stopped (``until``: stop after that epoch) continues with
    equal results.  Rows without a label are not trained on.  No training
    rows, no steps: the weights stay empty and every class scores alike.
    """
    spark = train.sparkSession
    run = EpochRun(spark, path)
    k = vocab.count()
    last = min(until or schedule.epochs, schedule.epochs)
    first = run.done() + 1
    if first > last:
        return run
    bound_arrow_batches(spark)
    rows = by_document(_as_lists(train.where(F.col("label_id").isNotNull()), id_col), id_col)
    checked = by_document(_as_lists(valid, id_col), id_col)
    try:
        n_all = _documents(rows)
        weights = run.weights(first - 1)
        shared = _shared(weights, k)
        for epoch in range(first, last + 1):
            for b in range(schedule.batches):
                part = _batch(rows, schedule, epoch, b, id_col)
                n = n_all if schedule.batches == 1 else _documents(part)
                end = b == schedule.batches - 1
                where = f"{path}/epoch={epoch}/weights" if end else f"{path}/epoch={epoch}/step={b}"
                step = schedule.step_size((epoch - 1) * schedule.batches + b)
                if n == 0:
                    new = weights
                elif shared is not None:
                    new = list_step(part, weights, shared, k, n, step, schedule.decay)
                else:
                    new = gradient_step(as_long(part, id_col), weights, k, n, step, schedule.decay, weights.count(), id_col)
                new.write.mode("overwrite").parquet(where)
                weights = spark.read.schema("term string, w array<double>").parquet(where)
                shared = _shared(weights, k)
            if shared is not None:
                found = checked.mapInArrow(_predicted(shared.value), "label_id int, prediction_id int")
            else:
                found = predict_long(as_long(checked, id_col), weights, k, weights.count(), id_col)
            found = found.groupBy("label_id", "prediction_id").agg(F.count(F.lit(1)).alias("n"))
            found = L.decode_labels(L.decode_labels(found, vocab, "prediction_id", "prediction"), vocab, "label_id", "labels")
            M.score(found, vocab, weights="n").coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}/scores")
    finally:
        rows.unpersist()
        checked.unpersist()
    return run


def _documents(rows: DataFrame) -> int:
    """How many documents there are, by their intercepts."""
    return rows.agg(F.sum(F.size(F.filter("terms", lambda t: t == INTERCEPT)))).first()[0] or 0


def _shared(weights: DataFrame, k: int) -> SharedWeights | None:
    """The weights for the tasks, or none beyond the size bound."""
    return SharedWeights(weights, k) if is_bounded(weights, DEFAULT_BROADCAST_ROWS) else None


def predict_lists(rows: DataFrame, weights: DataFrame, k: int, id_col: str = "sentence_id") -> DataFrame:
    """``predict_long`` without the ids, on rows that hold lists: ``(label_id, prediction_id)`` of every document."""
    shared = _shared(weights, k)
    if shared is None:
        return predict_long(as_long(rows, id_col), weights, k, weights.count(), id_col).drop(id_col)
    bound_arrow_batches(rows.sparkSession)
    placed = rows.repartition(id_col).sortWithinPartitions(id_col, "label_id")
    return placed.mapInArrow(_predicted(shared.value), "label_id int, prediction_id int")
