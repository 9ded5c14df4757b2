import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, neardup, queries
from tessera.llm.components import components

from ..conftest import SF001
from ..oracle import compare, duck
from . import brute
from .conftest import HARD


def as_rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_exact_groups_match_sql(spark):
    problems, _ = compare(queries.op8_exact_dedup(spark, SF001), duck(SF001), queries.OP8_SQL)
    assert not problems


def test_exact_groups_hard_rows(hard):
    got = exact_dedup.exact_groups(hard).collect()
    assert len(got) == len(HARD)
    texts = Counter(brute.lower(t) for _, t, *_ in HARD)
    assert Counter(r.text_sha256 for r in got) == Counter({brute.sha(t): n for t, n in texts.items()})
    assert sum(r.kept for r in got) == len(texts)  # one of equal rows with equal ids, too
    assert {r.group_size for r in got if r.text_sha256 == brute.sha("")} == {3}
    assert [r.keep_id for r in got if r.text_sha256 == brute.sha("")] == [4, 4, 4]


def test_exact_duplicates_dropped_whole_rows(hard):
    out = exact_dedup.drop_exact_duplicates(hard)
    assert out.columns == hard.columns
    rows = out.collect()
    assert len(rows) == len({brute.lower(t) for _, t, *_ in HARD})
    assert {r.doc_id for r in rows} == {2, 4, 5, 6, 7, 9, 10}


def test_small_filter_only_costs_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 64 * 1024)
    docs = spark.range(30000).select(F.col("id").alias("doc_id"), (F.col("id") % 20000).cast("string").alias("text"))
    out = exact_dedup.exact_groups(docs)
    assert out.where("kept").count() == 20000
    assert out.where("group_size = 2").count() == 20000


def test_empty_tables(none):
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).count() == 0
    assert neardup.near_groups(none).count() == 0
    assert neardup.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_groups_match_brute_force(spark, width, percent):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = neardup.near_groups(docs, neardup.Settings(width, percent))
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == Counter(brute.near_groups(rows, width, percent))
    assert got.where("kept <> (doc_id = component_id)").count() == 0


def edited_copies(n, seed):
    """Copies of one text with more and more words replaced: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(160)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
        out.append((i + 100, " ".join(words)))
    return out


def test_large_near_group_matches_brute_force(spark):
    rows = edited_copies(220, 1) + [(i, f"alone {i} " * 5) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_groups(docs, neardup.Settings(3, 85))
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == Counter(brute.near_groups(rows, 3, 85))


def test_near_groups_hard_rows(hard):
    rows = [(i, t) for i, t, *_ in HARD]
    got = neardup.near_groups(hard, neardup.Settings(3, 85))
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == Counter(brute.near_groups(rows, 3, 85))
    kept = neardup.drop_near_duplicates(hard, neardup.Settings(3, 85))
    assert kept.columns == hard.columns
    assert as_rows(kept, "doc_id") == Counter({(1,): 2, (3,): 1, (4,): 1, (5,): 1, (6,): 1, (None,): 1, (7,): 1, (8,): 1,
                                                 (10,): 1})


def test_sketch_never_hides_a_link(spark):
    """Pairs at or above the threshold pass the size and sketch test, below and beyond the sample's size."""
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for n in (1, 5, 40, 300, 511, 513, 600, 3000, 20000):
        for _ in range(20):
            a = rng.integers(0, 2 ** 63, n, dtype=np.uint64)
            b = np.concatenate([a[: n - rng.integers(0, n // 12 + 1)], rng.integers(0, 2 ** 63, rng.integers(0, n // 14 + 1), dtype=np.uint64)])
            if len(b) and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
                rows.append((k, len(np.unique(a)), len(np.unique(b)),
                             neardup.odd_sketch(np.unique(a)).view(np.int64).tolist(),
                             neardup.odd_sketch(np.unique(b)).view(np.int64).tolist()))
                k += 1
    df = spark.createDataFrame(rows, "k long, n_a long, n_b long, sketch_a array<long>, sketch_b array<long>")
    assert k > 100
    assert df.where(neardup._may_link(neardup.Settings(3, 85))).count() == k


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 430)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = brute.roots(500, edges)
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    used = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: least[root[i]] for i in used}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_row_of_a_near_group_stays_under_equal_or_null_ids(spark):
    """Near-equal texts under one repeated id or without any: one row a group, other groups of that id untouched."""
    text = lambda word, i: " ".join(f"{word}{k}" for k in range(60)) + f" end{i}"
    rows = [(1, text("a", i)) for i in range(3)] + [(None, text("b", i)) for i in range(3)]
    rows += [(1, text("c", 0)), (None, text("d", 0)), (5, text("e", 0)), (None, text("e", 1)), (4, text("e", 2))]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text[0]) for r in kept) == Counter([(1, "a"), (None, "b"), (1, "c"), (None, "d"), (4, "e")])


def test_parity_maps_bound_the_difference():
    """Equal sets have equal maps; maps of any two widths differ in no more bits than the sets do elements."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64)) for n in (1, 2, 15, 17, 300, 500, 4000, 40000)]
    sets += [np.unique(np.concatenate([s[len(s) // 9:], rng.integers(0, 2 ** 63, len(s) // 3, dtype=np.uint64)])) for s in sets]
    maps = [neardup.parity_map(s).tobytes() for s in sets]
    assert max(map(len, maps)) == neardup.MOST_PARITY // 8
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    bits = neardup.maps_apart(maps, a, b)
    for i, j, d in zip(a.tolist(), b.tolist(), bits.tolist()):
        assert d <= len(np.setxor1d(sets[i], sets[j])) and (d == 0 or i != j)


def replaced(words, share, rng):
    return [f"x{rng.randrange(10 ** 9)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("block", [16, 1024])
def test_pairs_below_the_threshold_do_not_become_rows(spark, monkeypatch, block):
    """Long near copies, few of them linked, and a clique that no bucket's first or last member belongs to."""
    tested, confirmed = [], neardup._confirmed
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, *rest: tested.append(pairs.count()) or confirmed(pairs, *rest))
    rng = random.Random(7)
    base = [f"w{k}" for k in range(900)]
    apart = lambda: replaced(base, .035, rng)
    centre = apart()
    texts = [apart() for _ in range(50)] + [replaced(centre, .004, rng) for _ in range(40)] + [apart() for _ in range(50)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), neardup.Settings(3, 85))
    want = brute.near_groups(rows, 3, 85)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == Counter(want)
    assert 60 < len({c for _, _, c in want}) < 140
    assert sum(tested[1:]) < 3 * len(rows)
