import brute
import corpus_pipeline
import pytest

from tallyweave.llm import quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    failed = {r.doc_id for r in quality.measure(spark.read.parquet(f"{SF}/documents.parquet")).where("band_failed").collect()}
    docs = [d for d in docs if not brute.quality(d.text)["base_failed"] and d.doc_id not in failed]
    first = {r["doc_id"] for r in brute.jaccard([(d.doc_id, d.text) for d in docs]) if r["doc_id"] == r["component_id"]}
    docs = [d for d in docs if d.doc_id in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in brute.decontamination([(d.doc_id, d.text) for d in docs], items) if not r["contaminated"]}
    docs = {d.doc_id: d for d in docs if d.doc_id in clean}
    sizes, most = {}, {}
    for d in docs.values():
        n = len(brute.SPACED.findall(d.text))
        sizes[d.source] = sizes.get(d.source, 0) + n
        most[d.source] = max(n, most.get(d.source, 0))
    want = brute.targets(sizes)
    got = corpus_pipeline.run(spark, SF).collect()
    taken, times = {}, {}
    for r in got:
        assert {c: r[c] for c in COLUMNS} == docs[r.doc_id].asDict()
        taken[r.source] = taken.get(r.source, 0) + len(brute.SPACED.findall(r.text))
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2
    for s, t in want.items():
        assert abs(taken.get(s, 0) - t) <= most[s] / 2 + 1 and t == pytest.approx(want[s])
    assert {"shard", "shard_depth", "shard_bytes"} <= set(got[0].asDict())


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
