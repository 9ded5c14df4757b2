"""The pipeline, stage by stage against plain Python at sf0.001."""
import corpus_pipeline as P
from tessera.llm import decontaminate, neardup, store, toxicity

from ..conftest import SF001
from . import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = store.written(stage(spark, docs, SF001), f"test-{name}")
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        if name != "mixing":
            assert out.columns == docs.columns and len(set(ids)) == len(ids)
            assert all(tuple(before[r.doc_id]) == tuple(r) for r in rows)
        if name == "exact_dedup":
            last = {}
            for i, r in before.items():
                k = brute.lower(r.text)
                last[k] = max(i, last.get(k, -1))
            assert set(ids) == set(last.values())
        if name == "near_dedup":
            s = neardup.Settings()
            want = brute.near_groups([(i, r.text) for i, r in before.items()], s.width, s.percent)
            assert set(ids) == {i for i, n, c in want if c == i or n == 0}
        if name == "decontamination":
            found = brute.leaks([(i, decontaminate.normal(r.text)) for i, r in before.items()],
                                [(i, decontaminate.normal(t)) for i, t in bench], decontaminate.Settings().rate)
            assert set(ids) == {i for i, hits in found.items() if not hits} and len(ids) < len(before)
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
            rated = {i: brute.toxicity(r.text, model.weights, model.cuts, toxicity.SLOTS)[0] for i, r in before.items()}
            assert min(abs(p - 0.5) for p in rated.values()) > 1e-4  # no text so close that sums in another order decide
            assert set(ids) == {i for i, p in rated.items() if p < 0.5} and 0.8 * len(before) < len(ids) < len(before)
        if name == "mixing":
            assert out.columns == [*docs.columns, "domain", "epoch", "n_tokens", "take_tokens"]
            words = {i: len(brute.WORD.findall(r.text)) for i, r in before.items()}
            assert set(ids) <= set(before) and all(0 < r.take_tokens <= r.n_tokens == words[r.doc_id] for r in rows)
            assert sum(r.take_tokens for r in rows) <= sum(words.values()) * 3 // 2
        docs = out


def test_run(spark):
    out = P.run(spark, SF001)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() > 0
