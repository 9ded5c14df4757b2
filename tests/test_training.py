"""Training by epochs: against a plain numpy loop, resumed runs, edges."""
import hashlib
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import labels as L
from tessera.operators import training as E

LABELS = ["a", "b", "c"]


def rows_of(n, seed, terms=7):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = int(rng.integers(3))
        doc = f"d{i}"
        out.append((doc, y, E.INTERCEPT, 1.0))
        out += [(doc, y, f"t{t}", float(rng.normal(y == t % 3, 0.7))) for t in rng.choice(terms, 4, replace=False)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "sentence_id string, label_id int, term string, value double")


def by_hand(rows, s, until):
    """The weights after each epoch, as {term: [w per class]}."""
    w, out = {}, []
    docs = {}
    for doc, y, term, v in rows:
        docs.setdefault(doc, (y, {}))[1][term] = v
    for epoch in range(1, until + 1):
        for b in range(s.batches):
            h = lambda d: int(hashlib.md5(f"{s.seed}:{epoch}:{d}".encode()).hexdigest()[:8], 16) % s.batches
            part = {d: x for d, x in docs.items() if s.batches == 1 or h(d) == b}
            rate = s.step_size((epoch - 1) * s.batches + b)
            grad = {}
            for y, terms in part.values():
                z = np.sum([np.array(w.get(t, [0.0] * 3)) * v for t, v in terms.items()], axis=0)
                p = np.exp(z - z.max())
                p = p / p.sum() - np.eye(3)[y]
                for t, v in terms.items():
                    grad[t] = grad.get(t, 0) + v * p
            if not part:
                continue
            w = {t: np.array(x) * (1 if t == E.INTERCEPT else 1 - rate * s.decay) for t, x in w.items()}
            for t, g in grad.items():
                w[t] = w.get(t, np.zeros(3)) - rate * g / len(part)
        out.append({t: list(x) for t, x in w.items()})
    return out


def close(df, expect):
    got = {r.term: r.w for r in df.collect()}
    assert got.keys() == expect.keys()
    for t, x in expect.items():
        assert np.allclose(got[t], x, atol=1e-9), t


@pytest.fixture(scope="module")
def vocab(spark):
    return L.vocab_from_list(spark, LABELS)


@pytest.mark.parametrize("batches", [1, 3])
def test_epochs_match_a_plain_loop(spark, vocab, tmp_path, batches):
    s = E.Schedule(epochs=3, batches=batches, rate=1.5, warmup=0.4)
    rows = rows_of(60, 1)
    run = E.train_epochs(frame(spark, rows), frame(spark, rows_of(30, 2)), vocab, str(tmp_path), s)
    for epoch, expect in enumerate(by_hand(rows, s, 3), 1):
        close(run.weights(epoch), expect)
    scores = run.scores().orderBy("epoch").collect()
    assert [r.epoch for r in scores] == [1, 2, 3] and scores[-1].macro_f1 > 0.5
    top = max(r.macro_f1 for r in scores)
    assert run.best() == min(r.epoch for r in scores if r.macro_f1 == top)


def test_a_stopped_run_goes_on(spark, vocab, tmp_path):
    s = E.Schedule(epochs=4, batches=2)
    train, valid = frame(spark, rows_of(50, 3)), frame(spark, rows_of(20, 4))
    whole = E.train_epochs(train, valid, vocab, str(tmp_path / "whole"), s)
    path = str(tmp_path / "parts")
    part = E.train_epochs(train, valid, vocab, path, s, until=2)
    assert part.done() == 2 and part.scores().count() == 2
    # The third epoch was cut off: its weights are there, its scores are not committed.
    E.train_epochs(train, valid, vocab, path, s, until=3)
    os.remove(f"{path}/epoch=3/scores/_SUCCESS")
    shutil.move(f"{path}/epoch=3/step=0", f"{path}/epoch=3/lost")
    assert part.done() == 2
    again = E.train_epochs(train, valid, vocab, path, s)
    assert again.done() == 4
    for epoch in range(1, 5):
        close(again.weights(epoch), {r.term: r.w for r in whole.weights(epoch).collect()})
    assert again.scores().orderBy("epoch").collect() == whole.scores().orderBy("epoch").collect()
    # Nothing left to do: the rows are not read.
    broken = train.withColumn("value", F.raise_error(F.lit("read")).cast("double"))
    assert E.train_epochs(broken, valid, vocab, path, s).done() == 4


def test_edges(spark, vocab, tmp_path):
    s = E.Schedule(epochs=2, batches=2)
    rows = frame(spark, rows_of(12, 5))
    none = E.train_epochs(rows.where("false"), rows, vocab, str(tmp_path / "none"), s)
    assert none.weights(2).count() == 0 and none.done() == 2 and none.best() == 1
    unlabelled = rows.withColumn("label_id", F.lit(None).cast("int")).withColumn(
        "sentence_id", F.concat(F.lit("u"), "sentence_id"))
    a = E.train_epochs(rows, rows, vocab, str(tmp_path / "a"), s)
    b = E.train_epochs(rows.union(unlabelled), rows, vocab, str(tmp_path / "b"), s)
    close(b.weights(2), {r.term: r.w for r in a.weights(2).collect()})
    # A document without terms has its intercept; the shuffle join (weights beyond the broadcast bound) gives the same.
    labelled = spark.createDataFrame([("x", 0), ("y", 1)], "sentence_id string, label_id int")
    weights = spark.createDataFrame([("x", "t", 1.0)], "sentence_id string, term string, weight double")
    long = E.long_rows(labelled, weights)
    assert sorted((r.sentence_id, r.term) for r in long.collect()) == [("x", ""), ("x", "t"), ("y", "")]
    step = {r.term: r.w for r in E.gradient_step(rows, a.weights(2), 3, 12, 0.5, 0.1, 10 ** 9).collect()}
    close(E.gradient_step(E.by_document(rows), a.weights(2), 3, 12, 0.5, 0.1, 8), step)


def test_step_sizes():
    s = E.Schedule(epochs=10, batches=2, rate=1.0, warmup=0.1)
    sizes = [s.step_size(k) for k in range(20)]
    assert sizes[:2] == [0.5, 1.0] and all(a > b > 0 for a, b in zip(sizes[1:], sizes[2:]))
    assert [E.Schedule(epochs=1, warmup=0.0).step_size(0)] == [2.0]
