"""Substring dedup, filter audit and target resampling: SQL on the given tables, brute force on hard rows."""
import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import blocks, filter_audit, queries, substring_dedup, target_resampling

from ..conftest import SF001
from ..oracle import compare, duck
from . import brute
from .conftest import HARD


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_substring_dedup", "op13_target_resampling"])
def test_queries_match_sql(spark, name):
    problems, rows = compare(queries.QUERIES[name](spark, SF001), duck(SF001), queries.ORACLE[name])
    assert not problems and rows


# ------------------------------------------------------------------ substring dedup
def cut_brute(rows, width):
    """(id, words, removed, sha of what stays) of each row, by sets of word tuples."""
    split = [brute.WORD.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and least[tuple(w[k:k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), brute.sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def shared_passages(seed, n, width):
    """Texts cut from a few long passages, so that windows overlap, touch and repeat inside a text."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(width, 4 * width))] for _ in range(4)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(base)
            a = rng.randrange(len(p))
            words += p[a:a + rng.randrange(1, 3 * width)] + [f"x{rng.randrange(10 ** 6)}"] * rng.randrange(0, 3)
        rows.append((rng.choice([i, i, i, rng.randrange(n), None]), rng.choice([" ", "\n", "  \t"]).join(words)))
    return rows


@pytest.mark.parametrize("seed, width, gram", [(1, 50, 25), (2, 8, 4), (3, 8, 8), (4, 5, 1)])
def test_repeats_match_brute_force(spark, seed, width, gram):
    rows = shared_passages(seed, 120, width)
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), substring_dedup.Settings(width, gram))
    assert Counter(tuple(r[:4]) for r in got.collect()) == Counter(cut_brute(rows, width))


def test_repeats_hard_rows(hard):
    rows = [r[:2] for r in HARD]
    got = substring_dedup.repeats(hard).collect()
    assert Counter(tuple(r[:4]) for r in got) == Counter(cut_brute(rows, 50))
    long = next(r for r in got if r.doc_id == 10)  # all words of the very long text came before, one is new
    assert (long.n_words, long.n_removed) == (36001, 36000) and [tuple(x) for x in long.removed] == [(0, 36000)]


def test_repeated_words_are_cut_out(hard, none):
    out = substring_dedup.remove_repeats(hard)
    assert out.columns == hard.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[10] == "omega" and texts[6] == HARD[6][1] and texts[3] is None and texts[5] == " \t\n "
    assert out.count() == len(HARD)
    assert substring_dedup.remove_repeats(none).count() == 0 and substring_dedup.repeats(none).count() == 0


def test_a_passage_of_most_documents(spark):
    """One passage in two thirds of all rows: the smallest id keeps it, the others keep their own words."""
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(
        F.concat_ws(" ", *[F.concat(F.lit(f"{c}"), F.col("id").cast("string")) for c in "abc"]),
        F.when(F.col("id") % 3 > 0, F.lit(" " + passage)).otherwise(F.lit(""))).alias("text"))
    got = substring_dedup.repeats(docs)
    assert got.where("n_removed = 60").count() == 1999 and got.where("n_removed = 0").count() == 1001


def test_windows_and_intervals():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 9, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for family in (0, 1):
        h = substring_dedup.window_hashes(words, 3, family)
        by = {}
        for k in range(len(h)):
            by.setdefault(int(h[k]), set()).add(tuple(words[k:k + 3].tolist()))
        assert all(len(x) == 1 for x in by.values()) and len(by) == len({tuple(words[k:k + 3].tolist()) for k in range(398)})
    s, e = substring_dedup.intervals(np.array([0, 3, 13, 31]), 10)
    assert list(zip(s.tolist(), e.tolist())) == [(0, 23), (31, 41)]  # touching windows are one interval
    with pytest.raises(ValueError):
        substring_dedup.Settings(10, 11)


def test_long_texts_are_worked_through_in_pieces():
    """Pieces of a few bytes give what the whole text gives: words, kept words, hashes, CRCs."""
    rng = random.Random(8)
    for _ in range(200):
        raw = "".join(rng.choice(["a", "bc", " ", "\n", "\t ", "é", "longword", "\x0b"]) for _ in range(rng.randrange(60))).encode()
        words = raw.split()
        for size in (1, 3, 7, 1000):
            pieces = list(blocks.word_pieces(raw, size))
            assert [w for p in pieces for w in p] == words
        cuts = sorted(rng.sample(range(len(words) + 1), min(len(words) + 1, 2 * rng.randrange(3))))
        s, e = np.array(cuts[::2], dtype=np.int64), np.array(cuts[1::2], dtype=np.int64)
        if len(s) == len(e):
            kept = [w for k, w in enumerate(words) if not any(a <= k < b for a, b in zip(s, e))]
            assert b"".join(substring_dedup.kept_words(raw, s, e)) == b" ".join(kept)


@pytest.fixture
def tiny_pieces(monkeypatch):
    whole = blocks.word_pieces
    for m in (substring_dedup, filter_audit, target_resampling):
        monkeypatch.setattr(m, "word_pieces", lambda raw: whole(raw, 5))


def test_pieces_in_every_operator(tiny_pieces):
    raw = b"One two  three four five\nsix seven eight nine ten eleven"
    words = raw.split()
    assert substring_dedup.WordHashes().of(raw).tolist() == [substring_dedup.WordHashes()[w] for w in words]
    s, e = np.array([1, 6]), np.array([4, 7])
    assert b"".join(substring_dedup.kept_words(raw, s, e)) == b" ".join(words[:1] + words[4:6] + words[7:])
    ends, sizes = target_resampling.prefixes(raw)
    assert ends[-1] == zlib.crc32(b" ".join(words).lower()) and list(sizes) == [len(w) for w in words]


# ------------------------------------------------------------------ filter audit
def failing_brute(rows):
    """rows: (id, text); the set of failing filters of each."""
    ids = {}
    for i, t in rows:
        if i is not None:
            ids[t or ""] = min(i, ids.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        w = brute.WORD.findall(t)
        out.append("".join(f for f, bad in zip("ABCDE", [
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and ids[t] < i]) if bad))
    return out


def audit_brute(rows, labels):
    """rows: (id, text, part); the report by walking every order."""
    fails, out = failing_brute([r[:2] for r in rows]), {}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    first = Counter()
    for (i, _, part), f in zip(rows, fails):
        for order in permutations("ABCDE"):
            hit = next((x for x in order if x in f), None)
            if hit:
                first[part or "", hit] += 1
            for step, x in enumerate(order, 1):
                row = out.setdefault((part or "", "".join(order), step), [0] * 6)
                gone = any(y in f for y in order[:step - 1])
                removed = x in f and not gone
                for k, yes in enumerate([x not in f and not gone, removed, x in f and gone, f == x,
                                         removed and i in good, removed and i in toxic]):
                    row[k] += yes
    return {(*k, *v, first[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_matches_brute_force(spark, hard):
    rng = random.Random(3)
    texts = [None, "", "A b", "w " * 300, " ".join(f"w{k}" for k in range(250)), " ".join(f"W{k}" for k in range(250)),
             " ".join(f"w{k}" for k in range(210)) + " #", "É" * 40, "x$ " * 201]
    rows = [(rng.choice([k, k, rng.randrange(20), None]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(150)]
    rows += [r[:3] for r in HARD]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 150, 2)] + [(0, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    got = filter_audit.audit(docs, marks)
    assert {tuple(r) for r in got.collect()} == audit_brute(rows, labels)
    assert filter_audit.audit(docs.where("false"), marks).count() == 0
    assert filter_audit.audit(hard, marks.where("false")).count() == 3 * 600 + 600  # en, de, fr and null


def test_csr_shards_hold_the_counts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD", 64)  # many shards
    texts = ["a b a", "", "b c", None, "d " * 40, "a"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    shards, about, known = filter_audit.csr_shards(docs)
    words = {r.id: bytes(r.word).decode() for r in known.collect()}
    assert sorted(words) == list(range(4))
    got = {}
    for r in shards.join(about, "shard").collect():
        ptr, n = filter_audit.unpack(r.pointers), filter_audit.unpack(r.counts)
        cols = filter_audit.csr_columns(ptr, filter_audit.unpack(r.columns))
        for k, i in enumerate(r.ids):
            own = cols[ptr[k]:ptr[k + 1]].tolist()
            assert own == sorted(own)
            got[i] = dict(zip([words[c] for c in own], n[ptr[k]:ptr[k + 1]].tolist()))
    assert got == {k: dict(Counter((t or "").split())) for k, t in enumerate(texts)}


def test_words_are_numbered_without_an_object_per_word(monkeypatch, tiny_pieces):
    """Words, order, row pointers and counts of a shard, whatever the runs and pieces; only long texts are split in Python."""
    rng = random.Random(9)
    for limit in (1, 40, 1 << 20):
        monkeypatch.setattr(filter_audit, "runs", lambda bounds: blocks.runs(bounds, limit))
        texts = ["".join(rng.choice(["a", "A", "bc", " ", "\n", "\t ", "é", "longword", "\x0b", "\x1f"]) for _ in range(rng.randrange(60))).encode()
                 for _ in range(rng.choice([1, 2, 90]))]
        seen, pieces = [], filter_audit.word_pieces
        monkeypatch.setattr(filter_audit, "word_pieces", lambda raw: seen.append(raw) or pieces(raw))
        words, ptr, cols, n = filter_audit._numbered(texts)
        monkeypatch.setattr(filter_audit, "word_pieces", pieces)
        assert words.to_pylist() == list(dict.fromkeys(w for x in texts for w in x.split()))
        assert len(seen) < len(texts) or limit == 1 or len(texts) == 1
        for k, x in enumerate(texts):
            own = cols[ptr[k]:ptr[k + 1]]
            assert own.tolist() == sorted(own)
            assert {words[c].as_py(): m for c, m in zip(own.tolist(), n[ptr[k]:ptr[k + 1]].tolist())} == Counter(x.split())


# ------------------------------------------------------------------ target resampling
WORD_13 = __import__("re").compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def resample_brute(rows, target, s):
    grams = lambda t: [" ".join(w[k:k + n]) for w in [WORD_13.findall(brute.lower(t))]
                       for n in range(s.min_n, s.max_n + 1) for k in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % s.buckets
    raw, want = (Counter(bucket(g) for t in texts for g in grams(t)) for texts in ([t for _, t in rows], target))
    a, b = sum(raw.values()), sum(want.values())
    gain = lambda k: math.floor(1000 * math.log((want[k] + 1) * (a + s.buckets) / ((raw[k] + 1) * (b + s.buckets))))
    out = []
    for i, t in rows:
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in grams(t))
        out.append([i, len(grams(t)), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2 ** 32)))])
    may = [k for k, (_, t) in enumerate(rows) if len(WORD_13.findall(brute.lower(t))) >= s.least_words]
    order = sorted(may, key=lambda k: (-out[k][3], rows[k][0] is None, rows[k][0] or 0))
    for place, k in enumerate(order[:len(may) * s.percent // 100]):
        out[k].append(place + 1)
    return [tuple(x) if len(x) == 5 else (*x, None) for x in out]


@pytest.mark.parametrize("least_n, most_n", [(1, 1), (1, 3), (2, 2)])
def test_resampling_matches_brute_force(spark, hard, least_n, most_n):
    s = target_resampling.Settings(buckets=97, min_n=least_n, max_n=most_n, least_words=2, percent=40, seed=7)
    rows = [r[:2] for r in HARD] + [(20 + k, " ".join(f"w{j * k % 7} Éa{k % 3}" for j in range(k % 9))) for k in range(60)]
    target = ["w1 w2 w3", None, "", "Word one-two"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("x"))
    want = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in target_resampling.resample(docs, want, s).collect()]
    expect = resample_brute(rows, target, s)
    assert Counter(r[:4] for r in got) == Counter(r[:4] for r in expect)
    rank = lambda rs: Counter((r[0], r[3], r[4]) for r in rs if r[4])
    assert rank(got) == rank(expect)


def test_crcs_from_prefixes():
    texts = [b"", b"a", b"alpha beta gamma", b"x " * 70, b"y" * 5000 + b" z", " ".join("é中" * k for k in range(9)).encode()]
    docs = [t.split() for t in texts]
    pairs = [target_resampling.prefixes(t) for t in texts]
    ends = np.array([c for p, _ in pairs for c in p], dtype=np.uint32)
    sizes = np.array([c for _, p in pairs for c in p], dtype=np.int64)
    bounds = np.cumsum([0, *map(len, docs)])
    for n in range(1, 6):
        crc, count = target_resampling.ngram_crcs(ends, sizes, bounds, n)
        want = [zlib.crc32(b" ".join(w[k:k + n])) for w in docs for k in range(len(w) - n + 1)]
        assert crc.tolist() == want and count.tolist() == [max(len(w) - n + 1, 0) for w in docs]


def test_resampling_draws_towards_the_target(spark, none):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(
        F.when(F.col("id") % 5 == 0, "rare target words ").otherwise("common other words "), 10).alias("text"))
    want = spark.createDataFrame([("target rare",)], "text string")
    out = target_resampling.drawn(docs, want)
    assert out.count() == 200 and out.where("doc_id % 5 = 0").count() == 200
    assert target_resampling.resample(none, want).count() == 0
    assert target_resampling.resample(docs, want.where("false")).where("rank is not null").count() == 200
