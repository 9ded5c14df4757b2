"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Features of a text are its distinct words and the words' first 4, 5 and 6
bytes, hashed to ``SLOTS`` slots; words are runs of letters and digits (all
bytes above 127 count as letters), A-Z lower-cased.  One weight vector is
shared by all thresholds: P(grade <= k) = sigmoid(theta_k - w . x) with
theta_1 < theta_2.  Grades are given with the labels: 0 clean, 1 toxic, 2
severe.  Labels that are only 0/1 teach the first threshold; the second then
stays above all of them and the severity is close to P(toxic).  No grade is
made up from the features.

Every slot whose rate in toxic texts differs from that in all texts, in either
direction, by ``least_z`` standard errors has a weight; there is no other
limit but ``SLOTS``.

The model is fitted on at most ``max_rows`` labelled rows (those with the
smallest hash of their id); scoring covers every row and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import store
from tessera.llm.blocks import WordRun, mix64, runs, span_hashes, text_buffers

SLOTS = 1 << 20
PREFIXES = (4, 5, 6)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Settings:
    max_rows: int = 30_000  # labelled rows that the model is fitted on
    least_z: float = 4.0  # how telling a slot must be, for or against (normal score of the difference in rates)
    least_rows: int = 3  # rows that a slot must occur in
    ridge: float = 1e-4
    steps: int = 400
    reject_at: float = 0.5  # P(grade >= 1) from which a text counts as toxic


@dataclass
class Model:
    weights: np.ndarray  # float32, SLOTS long
    cuts: np.ndarray  # theta_1 < theta_2


def features(run: WordRun) -> tuple[np.ndarray, np.ndarray]:
    """Document in the run and slot of every word and prefix."""
    doc = np.repeat(np.arange(run.docs), np.diff(run.before))
    size = run.end - run.start
    docs, slots = [doc], [run.hash]
    for k in PREFIXES:
        long = np.flatnonzero(size > k)
        docs.append(doc[long])
        slots.append(mix64(span_hashes(run.raw, run.start[long], run.start[long] + k) + np.uint64(k)))
    return np.concatenate(docs), (np.concatenate(slots) & np.uint64(SLOTS - 1)).astype(np.int64)


def _runs(col: pa.Array):
    data, off = text_buffers(col)
    for i, j in runs(off):
        yield WordRun(data, off, i, j, _LETTER)


def _slot_counts(batches):
    """Rows and toxic rows of each slot, summed over the task."""
    total = np.zeros((2, SLOTS), dtype=np.int64)
    for b in batches:
        grade = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for run in _runs(b.column(1)):
            doc, slot = features(run)
            pair = np.unique(doc * SLOTS + slot)
            doc, slot = pair // SLOTS + run.first_doc, pair % SLOTS
            total[0] += np.bincount(slot, minlength=SLOTS)
            total[1] += np.bincount(slot[grade[doc] > 0], minlength=SLOTS)
    at = np.flatnonzero(total[0])
    if len(at):
        yield pa.RecordBatch.from_pydict({"slot": at, "n": total[0][at], "t": total[1][at]})


def _sparse_rows(chosen: np.ndarray):
    """The grade and the chosen slots that occur."""
    keep = np.zeros(SLOTS, dtype=bool)
    keep[chosen] = True

    def emit(batches):
        for b in batches:
            for run in _runs(b.column(1)):
                doc, slot = features(run)
                hit = keep[slot]
                pair = np.unique(doc[hit] * SLOTS + slot[hit])
                ends = np.searchsorted(pair, np.arange(run.docs + 1) * SLOTS).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(run.first_doc, run.docs),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array((pair % SLOTS).astype(np.int32)))],
                    ["grade", "slots"])
    return emit


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(row: np.ndarray, column: np.ndarray, n_columns: int, grade: np.ndarray, settings: Settings
                ) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model; features are 0/1, given by (row, column) pairs.

    Minimises the mean negative log-likelihood with a ridge on the weights by
    full-batch steps with per-parameter scaling; starts at the grades' rates.
    """
    n = len(grade)
    rate = lambda k: np.clip((grade <= k).mean(), 1e-3, 1 - 1e-3)
    logit = lambda p: np.log(p / (1 - p))
    theta = np.array([logit(rate(0)), np.log(max(logit(rate(1)) - logit(rate(0)), 1e-2))])
    x = np.concatenate([np.zeros(n_columns), theta])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, settings.steps + 1):
        w, first, gap = x[:-2], x[-2], np.exp(x[-1])
        eta = np.bincount(row, weights=w[column], minlength=n)
        a, b = _sigmoid(first - eta), _sigmoid(first + gap - eta)
        p = np.maximum(np.select([grade == 0, grade == 1], [a, b - a], 1 - b), 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        # derivative of -log p by the first and by the second threshold
        g1 = np.select([grade == 0, grade == 1], [-da, da], 0.0) / p
        g2 = np.select([grade == 0, grade == 1], [0.0, -db], db) / p
        g = np.concatenate([np.bincount(column, weights=-(g1 + g2)[row], minlength=n_columns) / n
                            + settings.ridge * w, [(g1 + g2).mean(), g2.mean() * gap]])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x = x - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return x[:-2], np.array([x[-2], x[-2] + np.exp(x[-1])])


def _sample(labels: DataFrame, grade_col: str, id_col: str, most: int) -> DataFrame:
    """The ``most`` labelled ids of smallest hash, each with its largest grade; no task sorts more than it must.

    Counts by the hash's upper 16 bits say which hashes can be in the sample,
    so only about that many rows reach the one task that picks them.
    """
    rated = (labels.select(F.col(id_col).alias("__id"), F.col(grade_col).cast("int").alias("grade"))
             .where("__id is not null and grade is not null").groupBy("__id").agg(F.max("grade").alias("grade"))
             .withColumn("__hash", F.xxhash64("__id")))
    rated = store.written(rated.withColumn("__top", F.shiftright("__hash", 48)), "toxicity-labels")
    got, last = 0, None
    for top, n in sorted(map(tuple, rated.groupBy("__top").count().collect())):  # 65,536 counts at most
        got, last = got + n, top
        if got >= most:
            break
    near = rated.where(F.col("__top") <= last) if last is not None else rated
    return near.orderBy("__hash", "__id").limit(most).select("__id", "grade")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
        text_col: str = "text", grade_col: str = "toxic") -> Model:
    """The model of at most ``max_rows`` labelled documents.

    ``grade_col`` of ``labels`` is 0, 1 or 2 (larger ones count as 2).
    Null grades and labels of unknown documents are ignored; of several labels
    of a document the largest counts.  With no label, or none of one kind, no
    slot has a weight and every text gets the same small severity.  The driver
    holds the sample's chosen slots, four bytes each.
    """
    spark = docs.sparkSession
    store.prepare(spark)
    sample = _sample(labels, grade_col, id_col, settings.max_rows)
    # The sample's size is bounded by max_rows, so broadcasting it is safe and no text is shuffled.
    rows = store.written(docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
                         .join(F.broadcast(sample), "__id").select(
        F.greatest(F.least("grade", F.lit(2)), F.lit(0)).alias("grade"), "text"), "toxicity-sample")
    n, n_toxic = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("grade") > 0, 1))).first()
    weights, cuts = np.zeros(SLOTS, dtype=np.float32), np.array([8.0, 9.0])
    if not n or not n_toxic or n == n_toxic:
        return Model(weights, cuts)
    base = n_toxic / n
    telling = (rows.mapInArrow(_slot_counts, "slot long, n long, t long").groupBy("slot")
               .agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= settings.least_rows)
               .where(F.abs(F.col("t") - base * F.col("n"))
                      >= settings.least_z * F.sqrt(base * (1 - base) * F.col("n"))))
    chosen = np.sort(np.array([r.slot for r in telling.select("slot").collect()], dtype=np.int64))
    if not len(chosen):
        return Model(weights, cuts)
    got = rows.mapInArrow(_sparse_rows(chosen), "grade int, slots array<int>").toArrow().combine_chunks()
    rated = got["grade"].to_numpy()
    slots = got["slots"].combine_chunks()
    row = np.repeat(np.arange(len(rated)), np.diff(slots.offsets.to_numpy()))
    column = np.searchsorted(chosen, slots.values.to_numpy())
    w, cuts = fit_ordinal(row, column, len(chosen), rated, settings)
    weights[chosen] = w
    return Model(weights, cuts)


def _score(model, settings: Settings):
    def emit(batches):
        weights, cuts = model.value
        for b in batches:
            eta = np.zeros(len(b))
            for run in _runs(b.column(1)):
                doc, slot = features(run)
                hit = weights[slot] != 0
                pair = np.unique(doc[hit] * SLOTS + slot[hit])
                eta[run.first_doc:run.first_doc + run.docs] = np.bincount(
                    pair // SLOTS, weights=weights[pair % SLOTS], minlength=run.docs)
            over = 1 - _sigmoid(cuts[None, :] - eta[:, None])
            grade = np.argmax(np.stack([1 - over[:, 0], over[:, 0] - over[:, 1], over[:, 1]]), axis=0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(over[:, 0]), pa.array(over[:, 1]), pa.array(over.sum(axis=1)),
                 pa.array(grade.astype(np.int32)), pa.array(over[:, 0] >= settings.reject_at)],
                ["doc_id", "p_toxic", "p_severe", "severity", "grade", "toxic"])
    return emit


def score(docs: DataFrame, model: Model, settings: Settings = Settings(), id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, p_toxic, p_severe, severity (the expected grade), grade (the likeliest), toxic; one row per input row.

    Null and empty texts have no features: their severity is that of the
    thresholds alone.  Nothing is shuffled; the model (4 MB) is broadcast.
    """
    store.prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("p_toxic", T.DoubleType()),
        T.StructField("p_severe", T.DoubleType()), T.StructField("severity", T.DoubleType()),
        T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _score(sent, settings), schema)


def _keep_clean(model, settings: Settings, at: int):
    rate = _score(model, settings)

    def emit(batches):
        for b in batches:
            part = pa.RecordBatch.from_arrays([b.column(at), b.column(at)], ["id", "text"])
            for scored in rate([part]):
                clean = pc.invert(scored.column("toxic"))
                yield b.filter(clean)
    return emit


def drop_toxic(docs: DataFrame, model: Model, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The rows that the model does not reject, with all their columns; nothing is shuffled."""
    store.prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))
    return docs.mapInArrow(_keep_clean(sent, settings, docs.columns.index(text_col)), docs.schema)
