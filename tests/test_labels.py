import pytest
from pyspark.sql import functions as F

from tessera.operators import labels as L


def sentences(spark, rows):
    return spark.createDataFrame(rows, "sentence_id string, text string, coarse string, fine string")


def test_fine_scheme_rules(spark):
    s = sentences(spark, [("1", "a", "EXPRESSIVE", "THANK"), ("2", "b", "COMMISSIVE", "THANK"),
                          ("3", "c", "COMMISSIVE", "PROMISE"), ("4", "d", "ASSERTIVE", "GUESS")])
    got = {r.sentence_id: r.labels for r in L.label_scheme(s, "fine").collect()}
    assert got == {"1": "EXCLUDED", "2": "EXCLUDED", "3": "COMMISSIVE", "4": "GUESS"}


def test_merged_and_coarse(spark):
    s = sentences(spark, [("1", "a", "COMMISSIVE", "X"), ("2", "b", "OTHER", "X"), ("3", "c", "UNSURE", "X")])
    assert {r.sentence_id: r.labels for r in L.label_scheme(s, "coarse_merged").collect()} == \
        {"1": "COMOTH", "2": "COMOTH", "3": "UNSURE"}
    assert {r.sentence_id: r.labels for r in L.label_scheme(s, "coarse").collect()} == \
        {"1": "COMMISSIVE", "2": "OTHER", "3": "UNSURE"}
    with pytest.raises(ValueError):
        L.label_scheme(s, "nope")


def test_fold_rare(spark):
    rows = [(str(i), "A") for i in range(12)] + [(str(100 + i), "B") for i in range(3)]
    df = spark.createDataFrame(rows, "sentence_id string, labels string")
    got = sorted({r.labels for r in L.fold_rare_labels(df, 10).collect()})
    assert got == ["A", "EXCLUDED"]


def test_vocab_code_point_order_and_lookups(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "É", "a", "Z", "a"]], "labels string")
    vocab = L.label_vocab(df)
    assert L.vocab_list(vocab) == ["Z", "a", "b", "É"]
    assert [r.label_id for r in vocab.orderBy("label_id").collect()] == [0, 1, 2, 3]
    enc = L.encode_labels(spark.createDataFrame([("a",), ("É",)], "labels string"), vocab)
    assert sorted((r.labels, r.label_id) for r in enc.collect()) == [("a", 1), ("É", 3)]
    bad = L.encode_labels(spark.createDataFrame([("zz",)], "labels string"), vocab)
    with pytest.raises(Exception):
        bad.collect()
    dec = L.decode_labels(spark.createDataFrame([(2,), (9,)], "prediction_id int"), vocab)
    assert sorted((r.prediction_id, r.prediction) for r in dec.collect()) == [(2, "b"), (9, None)]


def test_counts_and_unseen(spark):
    train = spark.createDataFrame([("A",), ("A",), ("B",)], "labels string")
    test = spark.createDataFrame([("A",), ("C",), ("C",)], "labels string")
    assert [tuple(r) for r in L.label_counts(train, test).collect()] == [("A", 2, 1), ("B", 1, 0)]
    assert [tuple(r) for r in L.unseen_labels(train, test).collect()] == [("C", 2)]
    assert L.num_classes(test).first()[0] == 2


def test_fold_rare_labels_inline_and_joined_agree(spark, monkeypatch):
    from tessera.operators import labels as L
    df = spark.createDataFrame([(str(i), "A" if i < 12 else ("B" if i < 15 else "C")) for i in range(16)],
                               "sentence_id string, labels string")
    inline = sorted(tuple(r) for r in L.fold_rare_labels(df, 10).collect())
    monkeypatch.setattr(L, "INLINE_RARE", 0)
    joined = sorted(tuple(r) for r in L.fold_rare_labels(df, 10).collect())
    assert inline == joined
    assert {r[1] for r in inline} == {"A", "EXCLUDED"}


def test_fixed_scheme_vocabularies(spark):
    coarse = {r.label: r.label_id for r in L.scheme_vocab(spark, "coarse").collect()}
    assert coarse == {"ASSERTIVE": 0, "COMMISSIVE": 1, "DIRECTIVE": 2, "EXPRESSIVE": 3, "OTHER": 4, "UNSURE": 5}
    merged = {r.label: r.label_id for r in L.scheme_vocab(spark, "coarse_merged").collect()}
    assert merged == {"ASSERTIVE": 0, "COMOTH": 1, "DIRECTIVE": 2, "EXPRESSIVE": 3, "UNSURE": 4}
    train = spark.createDataFrame([("B",), ("A",)], "labels string")
    assert L.vocab_list(L.scheme_vocab(spark, "fine", train)) == ["A", "B"]
    with pytest.raises(ValueError):
        L.scheme_vocab(spark, "fine")
