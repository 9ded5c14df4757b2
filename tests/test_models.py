import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import encode as K
from tessera.operators import labels as L
from tessera.operators import metrics as M
from tessera.operators import models as J
from tessera.plans import registry as R

from .conftest import SF001


def test_svm_beats_majority_and_reloads(spark, tmp_path):
    trv, tev, vocab, col = R._svm_inputs(spark, SF001, with_features=False)
    model = J.fit_svm(trv, features_col=col)
    pred = L.decode_labels(model.transform(tev), vocab, "prediction_id", "prediction")
    acc = M.score(pred, vocab).first().accuracy
    train, test = R._docs_train_test(spark, SF001)
    floor = J.majority_predict(train, test).select(
        F.avg((F.col("labels") == F.col("prediction")).cast("double"))).first()[0]
    assert acc > floor
    assert len(model.fits) == len(model.pairs) and all(f["iterations"] > 0 for f in model.fits)
    assert model.unconverged == [tuple(f["pair"]) for f in model.fits if f["iterations"] >= 50]
    path = os.path.join(tmp_path, "ovo")
    J.save_model(model, path)
    loaded = J.load_model(path, "ovo")
    assert loaded.fits == model.fits
    again = loaded.transform(tev)
    a = {r.sentence_id: r.prediction_id for r in model.transform(tev).collect()}
    b = {r.sentence_id: r.prediction_id for r in again.collect()}
    assert a == b


def test_train_select_is_deterministic(spark):
    trv, tev, vocab, col = R._svm_inputs(spark, SF001, with_features=False)
    est, grid = J.lr_grid(reg_params=(0.0, 0.1), max_iters=(5,))
    est.setFeaturesCol(col)
    model, scores, best = J.train_select(trv, tev, vocab, est, grid)
    _, scores2, best2 = J.train_select(trv, tev, vocab, est, grid)
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, scores2.collect())) and best == best2
    assert best == M.best_run(scores).first().run_id
    # the winner predicts what its scores say
    pred = L.decode_labels(model.transform(tev), vocab, "prediction_id", "prediction")
    assert M.score(pred, vocab).first().macro_f1 == pytest.approx(scores.where(F.col("run_id") == best).first().macro_f1)


def blobs(spark, classes):
    from pyspark.ml.linalg import Vectors
    rows = [(c, Vectors.dense([10.0 * (c == d) + (i % 3) for d in classes])) for c in classes for i in range(10)]
    return spark.createDataFrame(rows, ["label_id", "features"])


def test_svm_with_class_ids_that_have_gaps(spark):
    df = blobs(spark, [0, 2, 3])
    model = J.fit_svm(df.union(df.limit(1).withColumn("label_id", F.lit(None).cast("long"))), max_iter=20)
    assert model.transform(df).where("prediction_id <> label_id").count() == 0
    rest = J.fit_one_vs_rest(blobs(spark, [0, 1, 2]), max_iter=20)
    assert rest.transform(blobs(spark, [0, 1, 2])).where("prediction_id <> label_id").count() == 0
    with pytest.raises(ValueError):
        J.fit_svm(df.where("label_id = 2"))
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_single_sentence_scoring_and_pipeline_reload(spark, tmp_path):
    """A one-row frame through the same batch scorer, with a saved and reloaded pipeline."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from tessera.operators import vectors as V
    train, test = R._docs_train_test(spark, SF001)
    vocab = L.label_vocab(train)
    pm = V.fit_tfidf_model(train, "text", "tfidf")
    lr = LogisticRegression(featuresCol="tfidf", labelCol="label_id", predictionCol="prediction_id", maxIter=20)
    model = PipelineModel(stages=[*pm.stages, lr.fit(L.encode_labels(pm.transform(train), vocab))])
    one = spark.createDataFrame([("x", "Das ist ganz falsch, und niemand ist hier.")], "sentence_id string, text string")
    assert J.score_batch(model, one, vocab).first().prediction in L.vocab_list(vocab)
    J.save_model(model, str(tmp_path / "m"))
    again = J.load_model(str(tmp_path / "m"))
    cols = ["sentence_id", "prediction"]
    assert sorted(map(tuple, J.score_batch(again, test, vocab).select(*cols).collect())) == sorted(
        map(tuple, J.score_batch(model, test, vocab).select(*cols).collect()))


def test_ablation_reports(spark):
    rows = {(r.run_id, r.label): r.support for r in R.svm_ablation(spark, SF001).collect()}
    train, test = R._docs_train_test(spark, SF001)
    want = {r.labels: r["count"] for r in test.groupBy("labels").count().collect()}
    assert {x for _, x in rows} == {*L.vocab_list(L.label_vocab(train)), "accuracy", "macro avg", "weighted avg"}
    assert all(rows[run, x] == n for run in (0, 1) for x, n in want.items())


def test_encode_tokens(spark):
    train = spark.createDataFrame([("1", "b a a"), ("2", "c")], "sentence_id string, text string")
    vocab = K.fit_token_vocab(train)
    assert {r.token: r.token_id for r in vocab.collect()} == {"a": 2, "b": 3, "c": 4}
    df = spark.createDataFrame([("1", "a z b c"), ("2", ""), ("3", "c c")], "sentence_id string, text string")
    got = {r.sentence_id: (r.input_ids, r.attention_mask) for r in K.encode_tokens(df, vocab, 3).collect()}
    assert got["1"] == ([2, 1, 3], [1, 1, 1])
    assert got["2"] == ([0, 0, 0], [0, 0, 0])
    assert got["3"] == ([4, 4, 0], [1, 1, 0])
    b = K.encode_tokens(df.withColumn("batch", F.lit(0)), vocab, 8, pad_to="batch", batch_col="batch")
    assert {r.sentence_id: len(r.input_ids) for r in b.collect()} == {"1": 4, "2": 4, "3": 4}


def test_map_batches(spark):
    df = spark.createDataFrame([("1", "abc", "x"), ("2", "äöü!", "y")], "sentence_id string, text string, labels string")

    def fn(pdf):
        return pdf.assign(n=pdf["text"].str.len())[["sentence_id", "n"]]
    got = {r.sentence_id: r.n for r in K.map_batches(df, fn, "sentence_id string, n long", drop=("labels",)).collect()}
    assert got == {"1": 3, "2": 4}


def test_map_batches_sets_up_once_per_task(spark):
    df = spark.range(40, numPartitions=2).selectExpr("cast(id as string) as sentence_id", "'t' as text")

    def setup():
        import uuid
        return uuid.uuid4().hex

    def fn(pdf, state):
        return pdf.assign(s=state)[["sentence_id", "s"]]
    with_small_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = K.map_batches(df, fn, "sentence_id string, s string", setup=setup).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_small_batches)
    assert len(got) == 40 and len({r.s for r in got}) == 2


def test_svm_separable_fits_whole_texts(spark, monkeypatch):
    """The separable check fits and reads every text to its end, with the operator's own iteration limit."""
    seen, given = [], []
    fit_tfidf, fit_svm = R.V.fit_tfidf_model, R.J.fit_svm
    monkeypatch.setattr(R.V, "fit_tfidf_model", lambda d, *a, **k: seen.append(d) or fit_tfidf(d, *a, **k))
    monkeypatch.setattr(R.J, "fit_svm", lambda d, **k: given.append(k) or fit_svm(d, **k))
    R.svm_separable(spark, SF001)
    marked = seen[0].select("sentence_id", F.col("text").alias("marked"))
    rows = marked.join(R.text_docs(spark, SF001), "sentence_id").select("text", "marked").collect()
    assert rows and all(r.marked.startswith(r.text) and len(r.marked) > 1.5 * len(r.text) for r in rows)
    assert max(len(r.text) for r in rows) > 1000 and "max_iter" not in given[0]


def test_saved_model_agreement_uses_the_whole_grid(spark, monkeypatch):
    grids = []
    select = R.J.train_select
    monkeypatch.setattr(R.J, "train_select", lambda *a, **k: grids.append(a[4]) or select(*a, **k))
    assert R.score_saved_model_agreement(spark, SF001).where("not agrees").count() == 0
    assert len(grids[0]) == len(J.lr_grid()[1]) == 6


def test_fits_share_bounded_memory(spark, monkeypatch):
    """Fits that together would hold more than the room wait for each other; small ones run together."""
    import threading
    import time
    running, most, lock, fit = [0], [0], threading.Lock(), J.LinearSVC.fit

    def watched(self, df):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.2)
        try:
            return fit(self, df)
        finally:
            with lock:
                running[0] -= 1
    monkeypatch.setattr(J.LinearSVC, "fit", watched)
    df = blobs(spark, [0, 1, 2])
    room = J.Room(spark, size=1)  # every fit is larger: one at a time, over all calls
    with J.ThreadPoolExecutor(2) as ex:
        both = list(ex.map(lambda _: J.fit_svm(df, max_iter=5, room=room), range(2)))
    assert most[0] == 1 and not room.used and all(len(m.models) == 3 for m in both)
    most[0] = 0
    assert J.Room(spark).size > 0 and len(J.fit_svm(df, max_iter=5).models) == 3
    assert most[0] > 1


def test_rows_are_dealt_by_their_number(spark):
    from tessera.operators.partitioning import dealt
    few, cores = spark.range(0, 1000, 1, 2).withColumnRenamed("id", "sentence_id"), spark.sparkContext.defaultParallelism
    parts = lambda rows: dealt(few, 1000, rows).rdd.getNumPartitions()
    assert parts(1000) == 1 and parts(250) == 4 and 2 * cores < parts(50) <= 3 * cores and parts(5) == 40
    assert dealt(few, 1000, 50).count() == dealt(few, 0, 50).count() == 1000
