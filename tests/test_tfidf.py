import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import tfidf as TF
from tessera.operators import vectors as V
from tessera.plans import registry as R

from .conftest import SF001

EXPECTED = {
    "1": {" ": 0.651002, " a": 0.457480, "a": 0.457480, "a ": 0.228740, "ab": 0.228740, "b": 0.162751,
          "b ": 0.162751},
    "2": {" ": 0.708199, " b": 0.497675, "b": 0.354100, "b ": 0.354100},
    "3": {" ": 0.817758, " a": 0.287333, "a": 0.287333, "ab": 0.287333, "b": 0.204440, "b ": 0.204440},
}


def test_char_wb_fixture(spark):
    docs = spark.createDataFrame([("1", "ab a", False), ("2", "b", False), ("3", "ab z", True)],
                                 "sentence_id string, norm_text string, is_test boolean")
    w, idf = TF.fit_transform_tfidf(docs)
    got = {}
    for r in w.collect():
        got.setdefault(r.sentence_id, {})[r.term] = round(r.weight, 6)
    assert got == EXPECTED
    idfs = {r.term: round(r.idf, 6) for r in idf.collect()}
    assert idfs == {" ": 1.0, "b": 1.0, "b ": 1.0, " a": 1.405465, "a": 1.405465, "a ": 1.405465,
                    "ab": 1.405465, " b": 1.405465}
    assert [r.term for r in TF.gram_vocab(idf).orderBy("term_index").collect()] == sorted(idfs)


def test_grams_whitespace_and_longer_n(spark):
    df = spark.createDataFrame([(" a\tbc   d ",), ("   ",)], "t string")
    got = [sorted(r[0]) for r in df.select(TF.char_wb_grams(F.col("t"))).collect()]
    ref = []
    for w in ["a", "bc", "d"]:
        p = f" {w} "
        ref += list(p) + [p[i:i + 2] for i in range(len(p) - 1)]
    assert got == [sorted(ref), []]
    tri = df.select(TF.char_wb_grams(F.col("t"), 3, 3)).first()[0]
    assert sorted(tri) == sorted([" a ", " bc", "bc ", " d "])


@pytest.mark.parametrize("min_n, max_n", [(1, 2), (1, 1), (2, 2), (1, 3)])
def test_counts_in_batches_equal_the_expression(spark, monkeypatch, min_n, max_n):
    """Counting in Arrow batches against the exploded n-grams: long and astral texts, blanks, nulls, repeated ids."""
    monkeypatch.setattr(TF, "_CHARS", 7)  # texts are counted in pieces, batches are cut
    texts = ["ab a", "", None, " \t ", "\U0001f600\U0001f600 é\ta", "aaaaaaa", "a  b " * 9, "abcdefg hijklmn", "x"]
    df = spark.createDataFrame([(str(k % 7), t) for k, t in enumerate(texts)], "sentence_id string, norm_text string")
    grams = df.select("sentence_id", F.explode(TF.char_wb_grams(F.col("norm_text"), min_n, max_n)).alias("term"))
    as_set = lambda d: {tuple(r) for r in d.collect()}
    assert as_set(TF.term_counts(df, min_n, max_n)) == as_set(grams.groupBy("sentence_id", "term").count())
    own = df.withColumn("sentence_id", F.monotonically_increasing_id())
    distinct = own.select("sentence_id", F.explode(TF.char_wb_grams(F.col("norm_text"), min_n, max_n)).alias("term")).distinct()
    expect = as_set(distinct.groupBy("term").count()) | {(None, len(texts))}
    assert as_set(TF.document_frequencies(df, min_n, max_n)) == expect


def test_ml_vectors_equal_long_table(spark):
    """I5 (Spark ML stages) against I4 (long table), brute force on sf0.001."""
    train, test = R._docs_train_test(spark, SF001)
    docs = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    from tessera.operators.features import normalize_text
    w, _ = TF.fit_transform_tfidf(normalize_text(docs))
    long = {}
    for r in w.collect():
        long.setdefault(r.sentence_id, []).append(r.weight)
    for pm in (V.fit_tfidf_model(train, "text", "tfidf"),):
        vec = pm.transform(docs).select("sentence_id", vector_to_array("tfidf").alias("a")).collect()
        for r in vec:
            nz = sorted(x for x in r.a if x != 0)
            assert nz == pytest.approx(sorted(long.get(r.sentence_id, [])), abs=1e-9)
            if nz:
                assert math.isclose(sum(x * x for x in nz), 1.0, rel_tol=1e-9)
    # vector index = position in the sorted n-gram vocabulary
    vocab = V.fit_tfidf_model(train, "text", "tfidf").stages[2].vocabulary
    assert list(vocab) == sorted(vocab)


def test_too_many_terms_raise_and_nothing_stays_cached(spark):
    train, test = R._docs_train_test(spark, SF001)
    with pytest.raises(ValueError):
        V.fit_tfidf_model(train, vocab_size=3)
    R.tfidf(spark, SF001).count()
    R.idf(spark, SF001).count()
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_idf_reads_text_without_a_shuffle(spark):
    docs = spark.range(0, 64, numPartitions=8).selectExpr("id as sentence_id", "'ab cd' as norm_text")
    plan = TF.fit_idf(docs)._jdf.queryExecution().toString()
    assert "hashpartitioning(sentence_id" not in plan


@pytest.mark.parametrize("min_n, max_n", [(1, 2), (1, 1), (2, 2)])
def test_table_and_sorted_counts(min_n, max_n):
    """Counts by a table of pairs and, where it would be mostly empty, by a sort, against a count by hand."""
    from collections import Counter

    import numpy as np
    few = ["ab a ab", "b", "aaaa ä😀"] * 9
    many = ["".join(chr(0x4E00 + (k * 7919 + j * 104729) % 9000) for j in range(40)) for k in range(60)]
    for texts in (few, many, few + many):
        padded = [TF._words_padded(t) for t in texts]
        owner, codes, n = TF._many_grams(padded, np.arange(len(texts)) + 5, min_n, max_n)
        expect = {}
        for k, t in enumerate(texts):
            own = Counter(f" {w} "[i:i + m] for w in t.split() for m in range(min_n, max_n + 1) for i in range(len(w) + 3 - m))
            expect.update({(k + 5, g): c for g, c in own.items()})
        assert {(o, g): c for o, g, c in zip(owner.tolist(), TF._as_text(codes).to_pylist(), n.tolist())} == expect
        assert (np.diff(owner) >= 0).all()
        together = TF._many_grams(padded, np.zeros(len(texts), dtype=np.int64), min_n, max_n)
        assert Counter(dict(zip(together[1].tolist(), together[2].tolist()))) == sum(
            (Counter({c: k}) for c, k in zip(codes.tolist(), n.tolist())), Counter()) and not together[0].any()


def test_a_model_of_counted_rows_is_that_of_their_texts(spark):
    d = spark.createDataFrame([(1, "Ab a\U0001f600 b!"), (2, None), (3, "zz Zz."), (4, "ab"), (None, "")], "sentence_id long, text string")
    counted = V.count_grams(d)
    assert {tuple(r) for r in TF.counted_frequencies(counted).collect()} == {
        tuple(r) for r in TF.document_frequencies(V.TextNormalizer(inputCol="text", outputCol="norm_text").transform(d)).collect()}
    a, b = V.fit_tfidf_model(d), V.fit_tfidf_model(counted.drop("text", "norm_text"), counted=True)
    vectors = lambda m, d: [r.tfidf for r in m.transform(d).orderBy("sentence_id").collect()]
    assert vectors(a, d) == vectors(V.after_counting(b), counted.drop("text", "norm_text")) == vectors(b, d)


def test_svm_inputs_read_the_texts_once(spark, monkeypatch):
    """Both splits' vectors come from one written table of counts; no text is tokenized or read again."""
    made = []
    normal = V.TextNormalizer._transform
    monkeypatch.setattr(V.TextNormalizer, "_transform", lambda s, d: made.append(d) or normal(s, d))
    for with_features in (False, True):
        made.clear()
        frames = R._svm_inputs(spark, SF001, with_features)[:2]
        assert len(made) == 1
        for df in frames:
            plan = df._jdf.queryExecution().toString()
            assert "documents.parquet" not in plan and "text#" not in plan
    train, test = R._docs_train_test(spark, SF001)
    assert [df.count() for df in frames] == [train.count(), test.count()]
