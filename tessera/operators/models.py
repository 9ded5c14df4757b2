"""Models as Spark jobs.

J1 is a constant-class baseline; J2-J5 are linear SVMs (one binary
``LinearSVC`` per class pair, one-vs-one vote); J6 is a parameter-grid
model selection with ``LogisticRegression``; J7-J9 score and persist models.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from itertools import combinations
from threading import Condition

from pyspark import StorageLevel
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import argmax


def majority_label(train: DataFrame, label_col: str = "labels", weights: str | None = None) -> str:
    """Most frequent train label; ties go to the smallest label.

    A partial + final count per label, then the top row of at most K rows.
    With ``weights`` a row stands for that many rows.
    """
    n = F.sum(weights) if weights else F.count(F.lit(1))
    top = (train.where(F.col(label_col).isNotNull())
           .groupBy(label_col).agg(n.alias("n"))
           .orderBy(F.desc("n"), F.asc(label_col)).limit(1).collect())
    if not top:
        raise ValueError("empty training set")
    return top[0][label_col]


def majority_predict(train: DataFrame, test: DataFrame, label: str | None = None,
                     label_col: str = "labels", out_col: str = "prediction") -> DataFrame:
    """Every test row gets the majority train label, or ``label`` when given."""
    chosen = label if label is not None else majority_label(train, label_col)
    return test.withColumn(out_col, F.lit(chosen))


# --------------------------------------------------------------------------- J2-J5: one-vs-one linear SVM


class OneVsOneModel:
    """Pairwise linear SVMs and their vote.

    Scoring is one projection: every pair model adds its 0/1 decision as a
    column (JVM-side), the winners form an array and the per-class vote
    counts and their first maximum are array expressions.  No shuffle, no
    Python per row.  ``fits`` tells of every pair how many iterations its fit
    took and whether it stopped at the limit (an unconverged fit); it is
    saved with the model.
    """

    def __init__(self, classes: list[int], pairs: list[tuple[int, int]], models: list[LinearSVCModel],
                 features_col: str = "features", fits: list[dict] | None = None):
        self.classes, self.pairs, self.models, self.features_col = classes, pairs, models, features_col
        self.fits = fits or []

    @property
    def unconverged(self) -> list[tuple[int, int]]:
        """Pairs whose fit stopped at the iteration limit; raise ``max_iter`` if there are any."""
        return [tuple(f["pair"]) for f in self.fits if f["at_limit"]]

    def transform(self, df: DataFrame, out_col: str = "prediction_id") -> DataFrame:
        cols = df.columns
        tmp = []
        for k, ((i, j), m) in enumerate(zip(self.pairs, self.models)):
            p, r = f"_ovo_p{k}", f"_ovo_r{k}"
            m = m.copy()
            m.setFeaturesCol(self.features_col).setPredictionCol(p).setRawPredictionCol(r)
            df = m.transform(df)
            tmp.append(F.when(F.col(p) > 0.5, F.lit(j)).otherwise(F.lit(i)))
        # A projection of its own: the vote reads the winners once per class.
        df = df.select(*cols, F.array(*tmp).alias("_ovo_won"))
        return df.select(*cols, ovo_vote("_ovo_won", self.classes).alias(out_col))

    def save(self, path: str) -> None:
        for (i, j), m in zip(self.pairs, self.models):
            m.write().overwrite().save(f"{path}/pair_{i}_{j}")
        meta = {"classes": self.classes, "pairs": self.pairs, "features_col": self.features_col, "fits": self.fits}
        s = SparkSession.getActiveSession()
        s.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            f"{path}/metadata")

    @staticmethod
    def load(path: str) -> "OneVsOneModel":
        s = SparkSession.getActiveSession()
        meta = json.loads(s.read.text(f"{path}/metadata").first()[0])
        pairs = [tuple(p) for p in meta["pairs"]]
        models = [LinearSVCModel.load(f"{path}/pair_{i}_{j}") for i, j in pairs]
        return OneVsOneModel(meta["classes"], pairs, models, meta["features_col"], meta.get("fits"))


def ovo_vote(winners, classes: list[int]) -> F.Column:
    """The class of ``classes`` (any ids, ascending) with the most pairwise wins; ties go to the lowest id."""
    w = F.col(winners) if isinstance(winners, str) else winners
    ids = F.array(*[F.lit(c) for c in classes])
    votes = F.transform(ids, lambda c: F.size(w) - F.size(F.array_remove(w, c)))
    return F.element_at(ids, argmax(votes) + 1)


# Iterative fits run one job per iteration; below this many rows per task the
# per-task overhead dominates, so small training sets are coalesced.
ROWS_PER_TASK = 10_000


def sized_for_iterations(df: DataFrame, n_rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Coalesce (no shuffle) to about ``n_rows / rows_per_task`` partitions; never split."""
    want = max(1, -(-n_rows // rows_per_task))
    return df.coalesce(want) if want < df.rdd.getNumPartitions() else df


def _resize_cached(data: DataFrame, n_rows: int) -> DataFrame:
    """Swap a cached, materialised frame for a coalesced cached copy when that pays.

    The copy is materialised from the first cache before that is dropped;
    otherwise the copy would recompute the whole lineage in few tasks.
    """
    sized = sized_for_iterations(data, n_rows)
    if sized is data:
        return data
    sized = sized.persist(StorageLevel.MEMORY_AND_DISK)
    sized.count()
    data.unpersist()
    return sized


def fit_iterative(estimator, df: DataFrame):
    """Fit an iterative estimator on a cached copy of ``df`` sized for per-iteration jobs.

    The rows are kept (memory, then disk; lost blocks are recomputed from
    lineage) and small inputs are coalesced to about ``ROWS_PER_TASK`` rows
    per task, so each iteration's job is not dominated by task overhead.
    """
    data = df.persist(StorageLevel.MEMORY_AND_DISK)
    data = _resize_cached(data, data.count())
    try:
        return estimator.fit(data)
    finally:
        data.unpersist()


class Room:
    """Memory that concurrent fits may hold together: half of what the executors have for cached rows.

    A fit that is larger than that waits until it is alone.  No more fits run
    than there are cores, as each keeps the driver busy with short jobs.
    """

    def __init__(self, spark: SparkSession, size: float | None = None):
        self.most, self.running = max(2, spark.sparkContext.defaultParallelism), 0
        if size is None:
            most = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
            each = []
            while most.hasNext():
                each.append(most.next()._1())
            size = sum(each) * max(1, len(each) - 1) / len(each) / 2  # a cluster's driver is in the list
        self.size, self.used, self._changed = size, 0, Condition()

    @contextmanager
    def take(self, size: int):
        with self._changed:
            self._changed.wait_for(lambda: not self.running or self.running < self.most and self.used + size <= self.size)
            self.running += 1
            self.used += size
        try:
            yield
        finally:
            with self._changed:
                self.running -= 1
                self.used -= size
                self._changed.notify_all()


def fit_svm(train: DataFrame, features_col: str = "features", label_col: str = "label_id", C: float = 1.0,
            max_iter: int = 50, tol: float = 1e-6, parallelism: int | None = None, room: Room | None = None) -> OneVsOneModel:
    """One binary ``LinearSVC`` per class pair.

    ``regParam = 1 / (C * n_pair)`` with no standardization gives the primal
    objective 1/2 |w|^2 + C * sum(hinge) with a free intercept.  The training
    vectors are kept (memory, then disk) for the iterations; pair fits are
    independent jobs submitted ``parallelism`` at a time (default: all pairs,
    at most 16), since on little data an iteration is a short job dominated by
    scheduling.  Every fit caches its pair's rows as blocks, a row once for each
    other class; ``room`` (which several calls may share) bounds what the fits
    that run at the same time hold, so that large data are iterated over in
    memory and not read from disk in every iteration.  Rows without a label are
    not used; the classes may be any ids.  ``fits`` of the result reports every
    pair's iterations and whether it reached ``max_iter``.
    """
    # Sorted by class inside each partition (no shuffle): the cached column
    # batches then hold few classes each, so a pair's filter skips the
    # batches of the other classes through their min/max statistics.
    data = (train.where(F.col(label_col).isNotNull()).select(features_col, F.col(label_col).cast("int").alias("_y"))
            .sortWithinPartitions("_y").persist(StorageLevel.MEMORY_AND_DISK))
    entries = F.size(F.unwrap_udt(F.col(features_col))["values"])
    found = data.groupBy("_y").agg(F.count(F.lit(1)).alias("n"), F.sum(entries).alias("entries")).collect()
    counts = {r["_y"]: r["n"] for r in found}
    # A block holds a place and a value for each entry, and a bound, a label and a weight for each row.
    held = {r["_y"]: 12 * (r["entries"] or 0) + 24 * r["n"] for r in found}
    if len(counts) < 2:
        data.unpersist()
        raise ValueError("need at least two classes")
    data = _resize_cached(data, sum(counts.values()))
    classes = sorted(counts)
    pairs = list(combinations(classes, 2))
    room = room or Room(train.sparkSession)

    def fit_pair(pair):
        i, j = pair
        sub = data.where(F.col("_y").isin(i, j)).select(
            features_col, (F.col("_y") == j).cast("double").alias("_bin"))
        svc = LinearSVC(featuresCol=features_col, labelCol="_bin", regParam=1.0 / (C * (counts[i] + counts[j])),
                        standardization=False, fitIntercept=True, maxIter=max_iter, tol=tol)
        with room.take(held[i] + held[j]):
            model = svc.fit(sub)
        took = model.summary().totalIterations
        return model, {"pair": [i, j], "iterations": took, "at_limit": took >= max_iter}

    workers = parallelism or min(16, max(1, len(pairs)))
    try:
        with ThreadPoolExecutor(max_workers=workers) as ex:
            done = list(ex.map(fit_pair, pairs))
    finally:
        data.unpersist()
    return OneVsOneModel(classes, pairs, [m for m, _ in done], features_col, [f for _, f in done])


def fit_one_vs_rest(train: DataFrame, features_col: str = "features", label_col: str = "label_id", C: float = 1.0,
                    max_iter: int = 100, tol: float = 1e-6, parallelism: int = 8):
    """One linear SVM per class against the rest, for schemes of many classes (K fits instead of K(K-1)/2).

    A Spark ML ``OneVsRestModel``: the class whose decision value is largest is predicted.
    """
    from pyspark.ml.classification import OneVsRest
    rows = train.where(F.col(label_col).isNotNull()).select(features_col, F.col(label_col).cast("double").alias(label_col))
    n = rows.count()
    svc = LinearSVC(featuresCol=features_col, regParam=1.0 / (C * max(n, 1)), standardization=False, fitIntercept=True,
                    maxIter=max_iter, tol=tol)
    return fit_iterative(OneVsRest(classifier=svc, featuresCol=features_col, labelCol=label_col,
                                   predictionCol="prediction_id", parallelism=parallelism), rows)


# --------------------------------------------------------------------------- J6: grid selection


def lr_grid(reg_params=(0.0, 0.01, 0.1), max_iters=(10, 50)) -> tuple[LogisticRegression, list]:
    """A multinomial logistic regression and a grid over (regParam, maxIter)."""
    lr = LogisticRegression(featuresCol="features", labelCol="label_id", predictionCol="prediction_id",
                            family="multinomial")
    grid = (ParamGridBuilder().addGrid(lr.regParam, list(reg_params)).addGrid(lr.maxIter, list(max_iters))
            .build())
    return lr, grid


def train_select(train: DataFrame, valid: DataFrame, vocab: DataFrame, estimator=None, grid=None,
                 parallelism: int | None = None):
    """Fit one model per parameter map, report each on ``valid``, keep the best by macro F1.

    Returns ``(best_model, scores, best_run)``: ``scores`` is one row per run
    (``run_id, macro_f1, weighted_f1, accuracy``; computed once and held by
    the driver, one row per parameter map), ``best_run`` the id of the winner
    (ties to the lowest) and ``best_model`` its model, ready to be saved.  All models
    score a row in one projection: the row then has one prediction per run.
    """
    from . import labels as L
    from . import metrics as M
    if estimator is None:
        estimator, grid = lr_grid()
    # Keep only what the fits read (not the text or its n-gram arrays).
    data = train.select(estimator.getFeaturesCol(), estimator.getLabelCol()).persist(
        StorageLevel.MEMORY_AND_DISK)
    data = _resize_cached(data, data.count())

    def fit_one(pm):
        return estimator.copy(pm).fit(data)

    try:
        with ThreadPoolExecutor(max_workers=parallelism or min(16, max(1, len(grid)))) as ex:
            models = list(ex.map(fit_one, grid))
    finally:
        data.unpersist()
    rows = valid.select("labels", estimator.getFeaturesCol())
    for k, m in enumerate(models):
        m = m.copy()
        m.setPredictionCol(f"_p{k}").setRawPredictionCol(f"_r{k}").setProbabilityCol(f"_q{k}")
        rows = m.transform(rows).drop(f"_r{k}", f"_q{k}")
    runs = F.array(*[F.struct(F.lit(k).alias("run_id"), F.col(f"_p{k}").alias("prediction_id"))
                     for k in range(len(models))])
    preds = rows.select("labels", F.explode(runs).alias("r")).select("labels", "r.*")
    preds = L.decode_labels(preds, vocab, "prediction_id", "prediction")
    found = M.score(preds, vocab, by=("run_id",)).collect()
    scores = train.sparkSession.createDataFrame(
        [tuple(r) for r in found], "run_id int, macro_f1 double, weighted_f1 double, accuracy double")
    best = min(found, key=lambda r: (-r["macro_f1"], r["run_id"]))["run_id"]
    return models[best], scores, best


# --------------------------------------------------------------------------- J7-J9: scoring, persistence
def score_batch(model, df: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Score many rows with a fitted model; decode the class id to a label when a vocabulary is given."""
    from . import labels as L
    out = model.transform(df)
    if vocab is not None:
        out = L.decode_labels(out, vocab, "prediction_id", "prediction")
    return out


def save_model(model, path: str) -> None:
    """Persist a fitted pipeline or one-vs-one model to (shared) storage."""
    if isinstance(model, OneVsOneModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str, kind: str = "pipeline"):
    """Reload a model saved by ``save_model`` (J9): a pipeline, a ``classifier`` alone or a one-vs-one model (``ovo``)."""
    if kind == "ovo":
        return OneVsOneModel.load(path)
    if kind == "classifier":
        return LogisticRegressionModel.load(path)
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
