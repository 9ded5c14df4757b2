import math

from pyspark.sql import functions as F

from tessera.operators.split import assign_split, assign_split_exact, split
from tessera.plans import inputs as I

from .conftest import SF01


def test_hash_split_sizes_and_stability(spark):
    d = I.documents_sentences(spark, SF01)
    t = assign_split(d, 0.2, 200)
    a = {r.sentence_id: r.is_test for r in t.collect()}
    b = {r.sentence_id: r.is_test for r in assign_split(d.repartition(7), 0.2, 200).collect()}
    assert a == b
    assert sum(a.values()) == 212
    train, test = split(d, 0.2, 200)
    assert train.count() + test.count() == d.count()
    assert train.join(test, "sentence_id").count() == 0


def test_exact_split(spark):
    d = I.documents_sentences(spark, SF01)
    t = assign_split_exact(d, 0.2, 200)
    n = d.count()
    assert t.where(F.col("is_test")).count() == math.ceil(0.2 * n) == 200
    again = assign_split_exact(d.repartition(5), 0.2, 200)
    assert {r.sentence_id for r in t.where("is_test").collect()} == \
        {r.sentence_id for r in again.where("is_test").collect()}


def test_exact_split_matches_global_rank(spark):
    """The two-level boundary search gives the first ceil(t * n) rows in (hash, id) order."""
    import math
    from pyspark.sql import functions as F
    from tessera.operators.split import assign_split_exact, split_hash
    df = spark.range(3000).select(F.col("id").alias("sentence_id"))
    ranked = [r.sentence_id for r in
              df.withColumn("_h", split_hash(F.col("sentence_id"), 7)).orderBy("_h", "sentence_id").collect()]
    for t in (0.0, 0.001, 0.2, 0.5, 1.0):
        got = {r.sentence_id for r in assign_split_exact(df, t, 7).where("is_test").collect()}
        assert got == set(ranked[:math.ceil(t * 3000)]), t


def test_exact_split_keeps_repeated_ids_together(spark):
    """Rows of one id are all test or all train; the test part is the smallest such set of at least k rows."""
    df = spark.createDataFrame([(f"s{i % 7}",) for i in range(70)] + [(None,)] * 3, "sentence_id string")
    out = assign_split_exact(df, 0.3, 200)
    sides = {r.sentence_id: r for r in out.groupBy("sentence_id").agg(
        F.min("is_test").alias("a"), F.max("is_test").alias("b"), F.count("*").alias("n")).collect()}
    assert all(r.a == r.b for r in sides.values())
    n = sum(r.n for r in sides.values() if r.a)
    assert 22 <= n < 22 + 10
    assert assign_split_exact(df.where("false"), 0.3).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan and "Union" not in plan


def test_groups_stay_together(spark):
    from tessera.operators.split import assign_split_groups
    rows = [(g, t, i) for g in ["a", "a/b", "%", None, ""] for t in ["x", "b/x", None] for i in range(1 + len(g or "") * 2)]
    df = spark.createDataFrame(rows, "group_id string, tweet_id string, pos int")
    out = assign_split_groups(df, test_size=0.4).collect()
    sides, sizes = {}, {}
    for r in out:
        sides.setdefault((r.group_id, r.tweet_id), set()).add(r.is_test)
        sizes[r.group_id, r.tweet_id] = sizes.get((r.group_id, r.tweet_id), 0) + 1
    assert all(len(s) == 1 for s in sides.values()) and len(sides) == 15
    n, k = sum(r.is_test for r in out), math.ceil(0.4 * len(rows))
    assert k <= n < k + max(sizes.values())
    assert assign_split_groups(df.where("false")).count() == 0
