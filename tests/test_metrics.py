import pytest
from pyspark.sql import functions as F

from tessera.functions.text import argmax
from tessera.operators import labels as L
from tessera.operators import metrics as M
from tessera.operators.models import majority_label, ovo_vote

# Golden confusion counts of the saved coarse error file (errors only, true -> predicted).
COARSE = {("ASSERTIVE", "COMMISSIVE"): 1, ("ASSERTIVE", "EXPRESSIVE"): 4, ("ASSERTIVE", "UNSURE"): 14,
          ("DIRECTIVE", "ASSERTIVE"): 2, ("DIRECTIVE", "EXPRESSIVE"): 2, ("DIRECTIVE", "OTHER"): 2,
          ("DIRECTIVE", "UNSURE"): 3, ("EXPRESSIVE", "ASSERTIVE"): 27, ("EXPRESSIVE", "COMMISSIVE"): 1,
          ("EXPRESSIVE", "DIRECTIVE"): 3, ("EXPRESSIVE", "OTHER"): 2, ("EXPRESSIVE", "UNSURE"): 12,
          ("OTHER", "UNSURE"): 1, ("UNSURE", "ASSERTIVE"): 11, ("UNSURE", "DIRECTIVE"): 2,
          ("UNSURE", "EXPRESSIVE"): 5}
COARSE_LABELS = ["ASSERTIVE", "COMMISSIVE", "DIRECTIVE", "EXPRESSIVE", "OTHER", "UNSURE"]


def pred_df(spark, pairs):
    return spark.createDataFrame([(str(i), t, p) for i, (t, p) in enumerate(pairs)],
                                 "sentence_id string, labels string, prediction string")


def test_report_fixture(spark):
    p = pred_df(spark, list(zip("AAABBC", "AABBAA")))
    vocab = L.vocab_from_list(spark, ["A", "B", "C", "D"])
    rep = {r.label: r for r in M.classification_report(p, vocab).collect()}
    exp = {"A": (0.5, 0.666667, 0.571429, 3), "B": (0.5, 0.5, 0.5, 2), "C": (0, 0, 0, 1), "D": (0, 0, 0, 0),
           "accuracy": (0.5, 0.5, 0.5, 6), "macro avg": (0.25, 0.291667, 0.267857, 6),
           "weighted avg": (0.416667, 0.5, 0.452381, 6)}
    for k, (pr, rc, f1, sup) in exp.items():
        r = rep[k]
        assert (round(r.precision, 6), round(r.recall, 6), round(r.f1_score, 6), r.support) == (pr, rc, f1, sup), k
    assert [r.label for r in M.classification_report(p, vocab).orderBy("row_order").collect()] == \
        ["A", "B", "C", "D", "accuracy", "macro avg", "weighted avg"]
    s = M.score(p, vocab).first()
    assert round(s.macro_f1, 6) == 0.267857 and round(s.weighted_f1, 6) == 0.452381


def test_golden_error_confusion(spark):
    pairs = [k for k, n in COARSE.items() for _ in range(n)]
    p = pred_df(spark, pairs)
    conf = {(r.true_label, r.pred_label): r.n for r in M.confusion(M.errors(p), COARSE_LABELS).collect()}
    assert len(conf) == 36
    assert sum(conf.values()) == 92
    assert all(conf[k] == COARSE.get(k, 0) for k in conf)
    wide = {r.true_label: r for r in M.confusion_matrix(p, COARSE_LABELS).collect()}
    assert wide["EXPRESSIVE"]["ASSERTIVE"] == 27 and wide["COMMISSIVE"]["UNSURE"] == 0


def test_properties(spark):
    pairs = [(t, p) for t in "ABC" for p in "ABCX" for _ in range(ord(t) % 3 + 1)]
    p = pred_df(spark, pairs)
    rep = {r.label: r for r in M.classification_report(p, ["A", "B", "C"]).collect()}
    assert sum(rep[x].support for x in "ABC") == len(pairs)
    assert rep["weighted avg"].recall == pytest.approx(rep["accuracy"].precision)
    grouped = M.classification_report(p.withColumn("run_id", F.lit(1)), ["A", "B", "C"], by=("run_id",))
    assert grouped.count() == 6


def test_majority_argmax_vote(spark):
    train = spark.createDataFrame([(x,) for x in "ABBAC"], "labels string")
    assert majority_label(train) == "A"
    e = spark.createDataFrame([([0.1, 0.7, 0.7],)], "s array<double>")
    assert e.select(argmax("s")).first()[0] == 1
    v = spark.createDataFrame([([0, 2, 2, 0, 1],)], "w array<int>")
    assert v.select(ovo_vote("w", [0, 1, 2])).first()[0] == 0


def test_vote_with_gaps_and_ties(spark):
    v = spark.createDataFrame([([2, 3, 3],), ([0, 3, 2],), ([7, 7, 2],)], "w array<int>")
    assert [r[0] for r in v.select(ovo_vote("w", [0, 2, 3, 7])).collect()] == [3, 0, 7]


def test_best_run(spark):
    m = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7), (3, float("nan")), (4, None)], "run_id int, macro_f1 double")
    assert M.best_run(m).first().run_id == 1
    named = spark.createDataFrame([("b", 0.7), ("a", 0.7), ("c", None)], "run_id string, macro_f1 double")
    assert tuple(M.best_run(named).first()) == ("a", 0.7)
    assert M.best_run(named.where("macro_f1 is null")).first().run_id == "c"


def test_attach_predictions_keeps_sentences_without_one(spark):
    sentences = spark.createDataFrame([("1", "x", "A"), ("2", "y", "B")], "sentence_id string, text string, labels string")
    preds = spark.createDataFrame([("1", "A")], "sentence_id string, prediction string")
    out = M.attach_predictions(sentences, preds)
    assert out.count() == 2 and [r.Text for r in M.error_table(out).collect()] == ["y"]


def plain_report(rows, labels):
    """(label -> precision, recall, f1, support) and (rows, hits), counted one by one."""
    out = {}
    for x in labels:
        tp = sum(t == p == x for t, p in rows)
        sup, prd = sum(t == x for t, _ in rows), sum(p == x for _, p in rows)
        out[x] = (tp / prd if prd else 0.0, tp / sup if sup else 0.0, 2 * tp / (sup + prd) if sup + prd else 0.0, sup)
    return out, len(rows), sum(t is not None and t == p for t, p in rows)


@pytest.mark.parametrize("k", [2, 70])
def test_reports_by_group_against_plain_counts(spark, k):
    """Few and many labels; a NULL group, NULL and unknown labels."""
    labs = [f"L{i:03d}" for i in range(k)]
    pairs = [(labs[(i * 7) % k], labs[(i * 11) % k] if i % 3 else labs[(i * 7) % k]) for i in range(400)]
    pairs += [(labs[0], "OUTSIDE"), (None, labs[1]), (labs[1], None), ("OUTSIDE", "OUTSIDE")]
    groups = [None if i % 3 == 2 else i % 3 for i in range(len(pairs))]
    p = spark.createDataFrame([(g, t, q) for g, (t, q) in zip(groups, pairs)], "run_id int, labels string, prediction string")
    vocab = L.vocab_from_list(spark, labs)
    rep = {(r.run_id, r.label): r for r in M.classification_report(p, vocab, by=("run_id",)).collect()}
    conf = {(r.run_id, r.true_label, r.pred_label): r.n for r in M.confusion(p, vocab, by=("run_id",)).collect()}
    assert len(rep) == 3 * (k + 3) and len(conf) == 3 * k * k
    for g in (0, 1, None):
        rows = [x for x, h in zip(pairs, groups) if h == g]
        want, n, hits = plain_report(rows, labs)
        for x in labs:
            r = rep[g, x]
            assert (r.precision, r.recall, r.f1_score, r.support) == pytest.approx(want[x])
        assert rep[g, "accuracy"].support == n and rep[g, "accuracy"].f1_score == pytest.approx(hits / n)
        assert rep[g, "macro avg"].f1_score == pytest.approx(sum(w[2] for w in want.values()) / k)
        assert all(conf[g, a, b] == rows.count((a, b)) for a in labs for b in labs)
    seen = M.confusion(p, vocab, by=("run_id",), dense=False)
    assert {(r.run_id, r.true_label, r.pred_label): r.n for r in seen.collect()} == {c: n for c, n in conf.items() if n}


@pytest.mark.parametrize("k", [2, 70])
def test_empty_input_gives_the_whole_grid(spark, k):
    labs = [f"L{i:03d}" for i in range(k)]
    none = pred_df(spark, [("A", "A")]).where("false")
    assert [r.n for r in M.confusion(none, labs).collect()] == [0] * (k * k)
    wide = M.confusion_matrix(none, labs).collect()
    assert len(wide) == k and all(r[x] == 0 for r in wide for x in labs)
    rep = M.classification_report(none, labs).collect()
    assert len(rep) == k + 3 and all(r.support == 0 and r.f1_score == 0 for r in rep)
    assert M.confusion(M.errors(pred_df(spark, [("L000", "L000")])), labs).agg(F.sum("n")).first()[0] == 0


def test_weighted_rows_count_as_many(spark):
    pairs = [("A", "B")] * 3 + [("B", "B")] * 5 + [(None, "A")] * 2
    p = pred_df(spark, pairs)
    w = p.groupBy("labels", "prediction").count()
    assert sorted(map(tuple, M.classification_report(p, ["A", "B"]).collect())) == sorted(
        map(tuple, M.classification_report(w, ["A", "B"], weights="count").collect()))


def test_distributed_label_vocab(spark):
    train = spark.createDataFrame([(x,) for x in "dbcaebd"], "labels string")
    small = [tuple(r) for r in L.label_vocab(train).orderBy("label_id").collect()]
    big = [tuple(r) for r in L.label_vocab(train, max_labels=2).orderBy("label_id").collect()]
    assert small == big == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)]
