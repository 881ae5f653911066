"""The pipeline's stages, each against the plain definition on what its predecessor kept."""

import corpus_pipeline
from placewright.llm import contamination, mixing, queries
from tests.llm.test_operators import brute_components, brute_lines, brute_mix, pairs_of, rows, sha


def test_stages(spark, small, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights"]
    docs = small
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == small.columns
        if k == 0:
            assert out.count() >= 0.97 * docs.count()
        if k == 1:
            want = {d: s for d, _, _, s in brute_lines(pairs_of(docs))}
            assert {r["doc_id"]: sha(r["text"]) for r in out.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in out.collect())
        if k == 2:
            assert {r["doc_id"] for r in out.collect()} == {d for d, _, c in brute_components(pairs_of(docs), 5, 80) if d == c}
        if k == 3:
            items = [contamination.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            exact = {d for d, t in pairs_of(docs) if any(i in contamination.normal(t) for i in items)}
            kept = {r["doc_id"] for r in out.collect()}
            assert not kept & exact and len(kept) >= docs.count() - len(exact) - 3
        if k == 4:
            assert rows(out, "doc_id", "epoch") == brute_mix(spark, docs, None, 3.0)
        docs = out.cache()
    assert rows(corpus_pipeline.run(spark, sf), "doc_id", "epoch") == rows(docs, "doc_id", "epoch")


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11)) and mixing.MOST_LEAVES
