"""Mixing, decontamination, token counts, toxicity and context-tree scores."""
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import context_tree, decontaminate, lm_score, mixing, queries, token_counts, toxicity
from tessera.llm.blocks import word_runs

from ..conftest import SF001, SF01
from ..oracle import compare, duck
from . import brute
from .conftest import HARD, LONG

# mixing


def filled(children, budget):
    """Exact shares: (name, weight, capacity) -> real share, by raising the water level."""
    out, left = {}, list(children)
    while left:
        level = budget / sum(w for _, w, _ in left)
        full = [c for c in left if c[2] <= c[1] * level]
        if not full:
            return out | {n: w * level for n, w, _ in left}
        for n, _, c in full:
            out[n] = c
            budget -= c
        left = [c for c in left if c not in full]
    return out


def test_shares_fill_siblings_first(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for p in range(30):
        kids = [(f"c{i}", rng.randrange(1, 9), rng.randrange(0, 1000)) for i in range(rng.randrange(1, 7))]
        budget = rng.randrange(0, 3000)
        rows += [(f"p{p}", n, w, c, budget) for n, w, c in kids]
        want |= {(f"p{p}", n): (s, min(budget, sum(c for *_, c in kids))) for n, s in filled(kids, budget).items()}
    df = spark.createDataFrame(rows, "domain string, lang string, weight long, capacity long, parent_budget long")
    got = mixing.share(df, ["domain"], "lang").collect()
    given_out = Counter()
    for r in got:
        share, total = want[r.domain, r.lang]
        assert abs(r.budget - share) < 1 and 0 <= r.budget <= r.capacity
        given_out[r.domain] += r.budget
    assert given_out == Counter({p: t for (p, _), (_, t) in want.items()})


def test_mixture_matches_sql(spark):
    problems, n = compare(queries.op3_mixture(spark, SF001), duck(SF001), queries.OP3_SQL)
    assert not problems and n > 100


def test_mixture_hard_rows(hard, none):
    mix = queries.source_mixture()
    got = mixing.mixture(hard, mix).collect()
    words = sum(len(brute.WORD.findall(t or "")) for _, t, *_ in HARD)
    assert abs(sum(r.take_tokens for r in got) - words * 3 // 2) <= 0
    assert all(0 < r.take_tokens <= r.n_tokens and r.epoch < 4 for r in got)
    assert mixing.mixture(none, mix).count() == 0
    whole = mixing.mix_documents(hard, mix)
    assert whole.columns == [*hard.columns, "domain", "epoch", "n_tokens", "take_tokens"]
    assert Counter((r.doc_id, r.epoch, r.take_tokens) for r in whole.collect()) == Counter(
        (r.doc_id, r.epoch, r.take_tokens) for r in got)


# decontamination


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", min_size=1, max_size=30), st.text("ab c", max_size=60), st.floats(0, 0.4))
def test_matcher_is_exact(item, text, rate):
    item, text = decontaminate.normal(item), decontaminate.normal(text)
    got = decontaminate.Matcher([(5, item)], rate).find(text)
    d = brute.distance_in(item, text)
    most = min(int(len(item) * rate), len(item) - 1)
    assert got == ([(5, d)] if item and d <= most else [])


def test_planted_passages(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    rng = random.Random(1)
    rows = []
    for i in range(60):
        item, text = bench[i % len(bench)]
        passage = list(decontaminate.normal(text))
        k = int(len(passage) * 0.05)
        edits = [0, k, 3 * k + 12][i % 3]
        for p in rng.sample(range(len(passage)), edits):
            passage[p] = rng.choice("#$%&")
        written = "".join(passage)
        if decontaminate.normal(written.upper()) == written:  # not so with every letter
            written = written.upper()
        rows.append((i, "Some words before. " + written + "\n\n and after " * 50, item if edits <= k else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item long")
    items = spark.createDataFrame([*bench, (None, None), (9999, "  ")], "item_id long, text string")
    for block in (4_000_000, 2000):  # one block, and several
        out = decontaminate.contaminated(docs, items, decontaminate.Settings(block_chars=block))
        got = {r.doc_id: r for r in out.collect()}
        for i, _, item in rows:
            assert (item in got[i].item_ids) == (item is not None) and got[i].contaminated == (item is not None)
    kept = decontaminate.drop_contaminated(docs, items)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, item in rows if item is None} and kept.columns == docs.columns


def test_query_finds_what_brute_force_finds(spark):
    """All documents and items of sf0.001, in one block and in several: the same items and distances, both directions."""
    docs, items = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    rate, rng = decontaminate.Settings().rate, random.Random(4)
    edited = []  # passages with edits up to the budget and one beyond it
    for n, r in enumerate(items.orderBy("item_id").limit(12).collect()):
        passage = list(decontaminate.normal(r.text))
        for p in rng.sample(range(len(passage)), int(len(passage) * rate) + n % 2):
            passage[p] = rng.choice(["", "~", passage[p] + "~"])
        edited.append((-1 - n, "before " + "".join(passage) + " after"))
    more = docs.select("doc_id", "text").union(spark.createDataFrame(edited, "doc_id long, text string"))
    want = brute.leaks([(r.doc_id, decontaminate.normal(r.text)) for r in more.collect()],
                       [(r.item_id, decontaminate.normal(r.text)) for r in items.collect()], rate)
    found = lambda df: {r.doc_id: set(zip(r.item_ids, r.distances)) for r in df.collect()}
    assert found(queries.op4_decontaminate(spark, SF001)) == {i: hits for i, hits in want.items() if i >= 0}
    several = decontaminate.Settings(block_chars=2500)
    assert found(decontaminate.contaminated(more, items, several)) == want
    held = {i for i, hits in want.items() if hits}
    assert any(i >= 0 for i in held) and any(d for hits in want.values() for _, d in hits)
    assert any(i < 0 and not hits for i, hits in want.items())
    assert {r.doc_id for r in decontaminate.drop_contaminated(more, items, several).collect()} == set(want) - held


def test_item_ids_of_any_type(spark, hard):
    items = spark.createDataFrame([("b", "naïve"), ("a", "naïve"), (None, "three four")], "item_id string, text string")
    for block in (4_000_000, 4):
        got = decontaminate.contaminated(hard, items, decontaminate.Settings(block_chars=block))
        assert got.count() == len(HARD)
        assert sorted((r.doc_id or 0, r.item_ids) for r in got.where("contaminated").collect()) == [
            (0, [None]), (1, [None]), (1, [None]), (2, [None]), (7, ["a", "b"])]
        kept = decontaminate.drop_contaminated(hard, items, decontaminate.Settings(block_chars=block))
        assert kept.columns == hard.columns and kept.count() == len(HARD) - 5


def test_decontamination_hard_rows(spark, hard, none):
    twice = "beta gamma delta alpha beta gamma"
    items = spark.createDataFrame([(1, twice), (2, twice)], "item_id long, text string")
    got = decontaminate.contaminated(hard, items)
    assert got.count() == len(HARD)
    assert {r.doc_id: list(r.item_ids) for r in got.where("contaminated").collect()} == {6: [1, 2], 10: [1, 2]}
    assert decontaminate.contaminated(hard, items.where("false")).where("contaminated").count() == 0
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.drop_contaminated(none, items).count() == 0


# token counts


@pytest.fixture(scope="module")
def tokenizer():
    with open(queries.VOCABULARY, "rb") as f:
        return token_counts.Tokenizer(f.read())


mess = st.lists(st.sampled_from(["a", "b", "'", "l", "s", " ", "  ", "\n", "é", "1", "!", "'ll", "'re", "　", "x" * 40]),
                max_size=150).map("".join)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(mess, st.lists(st.tuples(st.integers(0, 400), st.integers(0, 60), mess.map(lambda t: t[:30])), max_size=4))
def test_edits_count_like_a_full_encoding(tokenizer, text, edits):
    tree = token_counts.Tree.build(text, tokenizer)
    assert tree.n_tokens == len(tokenizer.encoding.encode_ordinary(text))
    for a, size, new in edits:
        a = min(a, len(text))
        b = min(a + size, len(text))
        after, _ = tree.edit(text, a, b, new, tokenizer)
        assert after == text[:a] + new + text[b:]
        text = after
        assert (tree.n_tokens, tree.n_chars) == (len(tokenizer.encoding.encode_ordinary(text)), len(text))


def applied(text, edits):
    done, shift = 0, 0
    for a, b, new in token_counts._in_order([{"start": a, "end": b, "new": n} for a, b, n in edits], len(text)):
        text = text[:a + shift] + new + text[b + shift:]
        shift += len(new) - (b - a)
    return text


def test_token_query_counts_like_full_encodings(spark, tokenizer):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/documents.parquet").withColumn(
        "edits", token_counts.spread_edits("text", "doc_id")).collect()}
    count = lambda t: len(tokenizer.encoding.encode_ordinary(t))
    rows = queries.op6_token_counts(spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        d = docs[r.doc_id]
        after = applied(d.text, [tuple(e) for e in d.edits])
        assert (r.n_tokens, r.n_tokens_after, r.n_chars_after) == (count(d.text), count(after), len(after))
    long = [r for r in rows if r.n_chars_after > 8000]
    assert long and all(r.n_chars_encoded < r.n_chars_after / 4 for r in long)


def test_token_counts_hard_rows(spark, none):
    edits = [(3, 1, "ab"), (1, 9, None), None, (-5, 0, "x"), (10 ** 9, 10 ** 9 + 1, "end"), (None, None, None)]
    rows = [(i, t, edits if i != 4 else None) for i, t, *_ in HARD]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,end:long,new:string>>")
    got = token_counts.edited_counts(token_counts.with_trees(df, queries.VOCABULARY), "edits", queries.VOCABULARY).collect()
    want = Counter()
    for i, t, e in rows:
        after = applied(t or "", [((x[0] or 0), x[1] or 0, x[2] or "") for x in e or [] if x])
        want[i, len(after)] += 1
    assert Counter((r.doc_id, r.n_chars_after) for r in got) == want
    assert token_counts.with_trees(none, queries.VOCABULARY).count() == 0


# toxicity


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    n, k = 3000, 12
    x = rng.random((n, k)) < 0.2
    true = np.linspace(-1, 2, k)
    u = rng.logistic(size=n)
    grade = (x @ true + u > 1.5).astype(int) + (x @ true + u > 3.0)
    row, column = np.nonzero(x)
    w, cuts = toxicity.fit_ordinal(row, column, k, grade, toxicity.Settings(ridge=1e-5))
    assert np.abs(w - true).max() < 0.6 and np.abs(cuts - [1.5, 3.0]).max() < 0.4
    # at the optimum the mean predicted probability of each grade is its rate
    over = 1 / (1 + np.exp(-(np.bincount(row, w[column], n)[:, None] - cuts)))
    assert np.allclose(over.mean(axis=0), [(grade >= 1).mean(), (grade >= 2).mean()], atol=0.01)


def test_held_out_accuracy(spark):
    """Fitted on half of the labels at sf0.1 and read on the other half: few false alarms, most toxic texts found."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    model = toxicity.fit(docs, labels.where(half))
    got = toxicity.score(docs, model).join(labels.where(~half).withColumnRenamed("toxic", "label"), "doc_id")
    table = {(r.label, r.toxic): r["count"] for r in got.groupBy("label", "toxic").count().collect()}
    hit, miss, wrong, right = (table.get(k, 0) for k in ((1, True), (1, False), (0, True), (0, False)))
    assert hit / (hit + miss) > 0.8 and wrong / (wrong + right) < 0.02
    order = got.groupBy("label").agg(F.avg("severity")).orderBy("label").collect()
    assert order[1][1] > 10 * order[0][1]


def test_toxicity_query_scores_like_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert (model.weights > 0).any() and model.cuts[0] < model.cuts[1]
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op7_toxicity(spark, SF001).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        *want, grade = brute.toxicity(texts[r.doc_id], model.weights, model.cuts, toxicity.SLOTS)
        assert np.allclose([r.p_toxic, r.p_severe, r.severity], want, atol=1e-4)
        assert r.toxic == (r.p_toxic >= 0.5) and (r.grade == grade or abs(want[0] - 0.5) < 1e-3)


def test_given_grades_are_learned(spark):
    """Labels with three grades teach both thresholds; words that speak against toxicity get negative weights."""
    rng = random.Random(6)
    plain = [f"plain{i}" for i in range(300)]
    rows = []
    for i in range(900):
        grade = i % 3
        words = rng.sample(plain, 12) + rng.sample(["harsh", "awful", "vile"], grade) + ["awful", "vile"][:grade - 1]
        words += ["kindly"] * (grade == 0 or rng.random() < 0.1)
        rng.shuffle(words)
        rows.append((i, " ".join(words), grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.fit(docs, docs.where("doc_id < 600"), grade_col="grade")
    got = toxicity.score(docs.where("doc_id >= 600"), model).collect()
    truth = dict((i, g) for i, _, g in rows)
    assert sum(r.grade == truth[r.doc_id] for r in got) > 0.85 * len(got)
    mean = [np.mean([r.severity for r in got if truth[r.doc_id] == g]) for g in range(3)]
    assert mean[0] < 0.3 < 0.7 < mean[1] < 1.3 < 1.6 < mean[2]
    assert (model.weights < -0.1).any() and (model.weights > 0.1).any()


def test_sample_holds_the_smallest_hashes(spark):
    labels = spark.range(5000).select((F.col("id") % 4000).alias("doc_id"), (F.col("id") % 3).cast("int").alias("toxic"))
    best = {}
    for i in range(5000):
        best[i % 4000] = max(best.get(i % 4000, 0), i % 3)
    hashes = {r.i: r.h for r in spark.range(4000).select(F.col("id").alias("i"), F.xxhash64("id").alias("h")).collect()}
    for most in (1, 700, 4000, 9000):
        got = toxicity._sample(labels, "toxic", "doc_id", most).collect()
        want = sorted(hashes, key=hashes.get)[:most]
        assert {tuple(r) for r in got} == {(i, best[i]) for i in want} and len(got) == min(most, 4000)


def test_toxicity_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (3, 0), (77, 1), (6, 0), (1, 1)], "doc_id long, toxic int")
    for some in (labels, labels.where("false"), labels.where("toxic = 0")):
        model = toxicity.fit(hard, some)
        got = toxicity.score(hard, model)
        assert got.count() == len(HARD)
        assert got.where("p_severe > p_toxic or severity < 0 or severity > 2").count() == 0
        assert toxicity.drop_toxic(hard, model).columns == hard.columns
    assert toxicity.drop_toxic(hard, model).count() == len(HARD)
    assert toxicity.score(none, model).count() == 0


def test_word_runs_match_the_pattern():
    import pyarrow as pa
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB \t\n\r\x0b\x0cé!") for _ in range(rng.randrange(20))) for _ in range(500)] + [None, ""]
    words = [w for run in word_runs(pa.array(texts)) for w in (
        bytes(run.raw[a:b]).decode() for a, b in zip(run.start, run.end))]
    assert words == [w for t in texts for w in brute.WORD.findall(brute.lower(t))]
    hashes = np.concatenate([run.hash for run in word_runs(pa.array(texts))])
    assert len(set(hashes.tolist())) == len(set(words))


# language models

CORPUS = ["the cat sat", "The cat ate the rat", "", "zzz", None, "été à la mer", "aaaaaaaaaaaa", "the end"]


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_context_tree_matches_recursion(spark, depth):
    rows = [(i, t) for i, t in enumerate(CORPUS * 3)] + [(None, "unseen: qux!")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, block string")
    held = {r.doc_id: r.h for r in docs.select("doc_id", lm_score.held_out("doc_id").alias("h")).collect()}
    assert held[None] and any(held[i] for i in range(24)) and not all(held[i] for i in range(24))
    train = [t for i, t in rows if not held[i]]
    tree = brute.ContextTree(train, depth)
    tokens = Counter(w for t in train for w in brute.WORD.findall(brute.lower(t)))
    tokens["<end>"] = len(train)
    n, v = sum(tokens.values()), len(tokens)
    got = {r.doc_id: r for r in lm_score.scores(docs, lm_score.Settings(depth=depth, block_bytes=40)).collect()}
    for i, t in rows:
        words = [*brute.WORD.findall(brute.lower(t)), "<end>"]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(words), n)
        assert r.n_known == sum(tokens[w] > 0 for w in words)
        assert math.isclose(r.base_score, sum(math.log10((tokens[w] + .1) / (n + .1 * (v + 1))) for w in words), abs_tol=1e-9)
        assert math.isclose(r.score, tree.score(t), rel_tol=1e-7)


def test_long_texts_and_hot_rows_match_recursion(spark):
    """One text of many blocks, words longer than a block, rows equal in id and text, many empty rows."""
    rng = random.Random(8)
    long = " ".join(rng.choice(["the", "cat", "sat", "été", "A" * 90]) for _ in range(120))
    rows = [(1, long), (1, long), (2, long + " "), (3, "x" * 200)] + [(None, None)] * 300 + [(None, "")] * 200
    rows += [(i, t) for i, t in enumerate(CORPUS)] + [(i, "") for i in range(100, 160)] + [(7, "hot row")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {r.doc_id: r.h for r in docs.select("doc_id", lm_score.held_out("doc_id").alias("h")).distinct().collect()}
    train = [t for i, t in rows if not held[i]]
    tree = brute.ContextTree(train, 2)
    tokens = Counter(w for t in train for w in brute.WORD.findall(brute.lower(t)))
    n, v = sum(tokens.values()) + len(train), len(tokens) + 1
    tokens["<end>"] = len(train)

    def of(i, t):
        words = [*brute.WORD.findall(brute.lower(t)), "<end>"]
        base = sum(math.log10((tokens[w] + .1) / (n + .1 * (v + 1))) for w in words)
        return i or -1, held[i], len(words), sum(tokens[w] > 0 for w in words), n, round(base, 6), round(tree.score(t), 5)

    known = {r: of(*r) for r in set(rows)}
    got = lm_score.scores(docs, lm_score.Settings(depth=2, block_bytes=60)).collect()
    assert Counter((r.doc_id or -1, *r[1:5], round(r.base_score, 6), round(r.score, 5)) for r in got) == Counter(
        known[r] for r in rows)
    assert all(math.isclose(r.bits_per_byte, -r.score / math.log10(2) / (len((long + " ").encode()) + 1))
               for r in got if r.doc_id == 2 and r.n_tokens > 50)


def test_groups_are_bounded_by_the_block(spark):
    """100,000 equal rows are one row of one block; 100,000 empty rows of different ids spread over the blocks."""
    s = lm_score.Settings(block_bytes=1 << 16)
    rows = spark.range(100_000).select(F.col("id"), F.col("id").alias("row_key"), F.lit(False).alias("held"),
                                       F.lit(1).cast("long").alias("times"), F.lit(False).alias("cut"), F.lit("").alias("text"))
    same = rows.select(F.lit(5).cast("long").alias("id"), F.lit(9).cast("long").alias("row_key"), "held", "times", "cut", "text")
    got = lm_score._dealt(same, 0, s).collect()
    assert len(got) == 1 and got[0].times == 100_000
    blocks = -(-100_000 * lm_score.ROW_BYTES // s.block_bytes)
    most = (lm_score._dealt(rows, 0, s).groupBy(F.pmod(F.xxhash64("id", "text", "lead"), F.lit(blocks))).count()
            .agg(F.max("count")).first()[0])
    assert most < 2 * s.block_bytes / lm_score.ROW_BYTES


def test_probabilities_of_next_bytes_add_up(spark):
    """After any context the 256 bytes share one."""
    rng = np.random.default_rng(1)
    ctx = [int.from_bytes(b"th"), int.from_bytes(b"zq"), 0xFFFF]
    rows = [((c << 8) | b, int(rng.integers(0, 9)) if b % 7 == 0 else 0) for c in ctx for b in range(256)]
    out = context_tree.log10_of_grams(spark.createDataFrame(rows, "gram long, n long"), 2)
    sums = out.groupBy(F.shiftright("gram", 8)).agg(F.sum(F.pow(F.lit(10.0), F.col("value"))).alias("s")).collect()
    assert len(sums) == 3 and all(math.isclose(r.s, 1, rel_tol=1e-9) for r in sums)


def test_scores_hard_rows(hard, none):
    got = lm_score.scores(hard).collect()
    assert len(got) == len(HARD) and all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert [r.n_tokens for r in got if r.doc_id == 6] == [len(LONG.split()) + 1]
    assert lm_score.scores(none).count() == 0


def test_held_out_texts_cost_more(spark):
    got = lm_score.scores(spark.read.parquet(f"{SF01}/documents.parquet"))
    a, b = (r[1] for r in got.groupBy("held_out").agg(F.avg("bits_per_byte")).orderBy("held_out").collect())
    assert 1 < a < b < 4
