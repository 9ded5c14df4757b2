"""What a task holds does not grow with the input: rows per n-gram or token are neither shuffled nor sorted."""
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import encode as K
from tessera.operators import features as H
from tessera.operators import tfidf as TF
from tessera.operators import vectors as V
from tessera.operators.partitioning import spread_if_few


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, False, "ab a"), (1, False, "b"), (1, True, "ab"), (2, False, "zz ab"), (None, True, "a"), (None, True, "b a"),
            (3, True, ""), (4, False, None)]
    return spark.createDataFrame(rows, "sentence_id long, is_test boolean, norm_text string")


def test_term_counts_and_weights_move_texts_not_grams(spark, docs):
    counts = TF.term_counts(docs, keep=("is_test",))
    assert "Aggregate" not in plan(counts) and plan(counts).count("Exchange") == 1
    idf = TF.fit_idf(docs.where("not is_test"))
    w = TF.weigh(docs, idf, ("is_test",))
    assert "Window" not in plan(w) and "Join" not in plan(w) and plan(w).count("Exchange") == 1


def test_weights_of_repeated_and_null_ids_equal_the_joined_form(spark, docs):
    idf = TF.fit_idf(docs.where("not is_test"))
    as_map = lambda d: {tuple(r)[:-1]: r[-1] for r in d.collect()}
    expect = as_map(TF.tfidf(TF.term_counts(docs, keep=("is_test",)), idf))
    grams = docs.select("sentence_id", "is_test", F.explode(TF.char_wb_grams(F.col("norm_text"))).alias("term"))
    assert as_map(TF.term_counts(docs, keep=("is_test",))) == as_map(grams.groupBy("sentence_id", "is_test", "term").count())
    lists = TF.weigh(docs, idf, ("is_test",), lists=True).select(
        "sentence_id", "is_test", F.explode(F.arrays_zip("terms", "values")).alias("p")).select("sentence_id", "is_test", "p.*")
    for got in (as_map(TF.weigh(docs, idf, ("is_test",))), as_map(lists), as_map(TF.weigh(docs, idf, ("is_test",), max_broadcast_terms=1))):
        assert got.keys() == expect.keys()
        assert all(math.isclose(got[k], expect[k], abs_tol=1e-12) for k in expect)


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(1, "Die Hunde bellen."), (1, "ab cd"), (2, None), (3, ""), (None, "ab"), (None, "zz ab"), (4, "! ab"), (5, "x zz"), (5, "x zz")]
    return spark.createDataFrame(rows, "sentence_id long, text string")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_lemmas_are_looked_up_without_a_row_per_token(spark, tokens):
    lemmas = spark.createDataFrame([("hunde", "hund"), ("ab", ""), ("die", None), ("cd", "c d"), (None, "q")], "form string, lemma string")
    got = H.normalize_text(tokens, lemmas)
    assert "Generate" not in plan(got) and "Join" not in plan(got)
    assert rows(got) == rows(H.normalize_text(tokens, lemmas, max_broadcast_rows=1))


@pytest.mark.parametrize("pad_to", ["max_length", "batch"])
def test_ids_are_looked_up_without_a_row_per_token(spark, tokens, pad_to):
    vocab = spark.createDataFrame([("ab", 2), ("x", 3), (".", 4)], "token string, token_id int")
    d = tokens.withColumn("batch", F.lit(1))
    got = K.encode_tokens(d, vocab, 3, pad_to=pad_to, batch_col="batch")
    assert "Generate" not in plan(got) and "Join" not in plan(got)
    assert rows(got) == rows(K.encode_tokens(d, vocab, 3, pad_to=pad_to, batch_col="batch", max_broadcast_rows=1))


def test_vectors_are_counted_without_a_string_per_gram(spark, tmp_path):
    d = spark.createDataFrame([(1, "Ab a\U0001f600 b!"), (2, None), (3, "zz"), (4, "ab")], "sentence_id long, text string")
    model = V.fit_tfidf_model(d.where("sentence_id <> 3"))
    assert "regexp_extract_all" not in plan(model.transform(d).select("tfidf")).split("ArrowEvalPython")[0]
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import CountVectorizerModel
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    as_before = PipelineModel(stages=[model.stages[0], V.CharGrams(inputCol="norm_text", outputCol="grams"),
                                      CountVectorizerModel.from_vocabulary(model.stages[2].vocabulary, inputCol="grams", outputCol="tf"),
                                      *model.stages[3:]])
    vectors = lambda m: [r.tfidf for r in m.transform(d).orderBy("sentence_id").collect()]
    assert vectors(model) == vectors(again) == vectors(as_before)


def test_a_scan_is_spread_by_its_splits(spark):
    few, more = (spread_if_few(spark.range(0, 100, 1, n).withColumnRenamed("id", "sentence_id")) for n in (2, 20))
    assert more.rdd.getNumPartitions() > few.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
