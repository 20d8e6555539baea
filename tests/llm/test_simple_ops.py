import brute
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import decontaminate, mixing, quality, sharding
from tallyweave.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Ärger #1 Ärger"), (None, "a b c a b c"), (4, "Ärger #1 Ärger"), (7, "x" * 300_000), (8, "one two three\n" * 400)]


def rows(df, *keys):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple(str(r[k]) for k in keys))


def odd(spark):
    return spark.createDataFrame([(d, t, "extra", 1.5) for d, t in ODD], "doc_id long, text string, _text string, n_words double")


def docs_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_quality(spark):
    for df in (docs_of(spark), odd(spark)):
        want = sorted(({"doc_id": r.doc_id} | brute.quality(r.text) for r in df.collect()), key=str)
        got = rows(quality.measure(df), "doc_id")
        keys = want[0].keys()
        assert sorted(({k: g[k] for k in keys} for g in got), key=str) == want
        assert all(not g["kept"] for g in got if g["base_failed"])
        assert rows(quality.accepted(df), "doc_id", "text") == rows(df.join(spark.createDataFrame([(g["doc_id"],) for g in got if g["kept"]] or [(-1,)], "doc_id long").distinct(), "doc_id", "left_semi").select(df.columns), "doc_id", "text")
    assert quality.measure(docs_of(spark).limit(0)).count() == 0


def test_quality_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.measure(docs_of(spark, sf)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed")
    assert got.where("not kept").count() == 0


def test_quality_bands_are_those_of_the_labels_and_reject(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = docs_of(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    assert quality.fit(docs, labels) == quality.Rules()
    bad = quality.measure(docs).join(labels, "doc_id").where("quality = 0 and not base_failed")
    assert bad.count() == 291 and bad.where("not kept").count() == 172


def test_quality_reads_the_tail_chunk(spark):
    prose = docs_of(spark).where("length(text) > 4000").orderBy("doc_id").first().text.encode("ascii", "ignore").decode()[:2048]
    got = {r.doc_id: r for r in quality.measure(spark.createDataFrame([(1, prose), (2, prose + "ab " * 600)], "doc_id long, text string")).collect()}
    assert got[1].odd_chunk_share == 0.0 and got[2].odd_chunk_share == 0.5


@pytest.mark.parametrize("most", [2_000_000, 1_000])
def test_decontamination(spark, most):
    docs = docs_of(spark)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    text = [r.text for r in bench.collect()]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(9000 + i, f"Before {t.upper()} after") for i, t in enumerate(text[:5])] + [(9100, "tiny Item here, tiny item"), (None, "tiny-item")], "doc_id long, text string"))
    bench = bench.unionByName(spark.createDataFrame([(900, "Tiny item"), (901, None), (902, " .. "), (903, text[0]), (None, text[1])], "item_id long, text string"))
    want = sorted(brute.decontamination([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in bench.collect()]), key=lambda r: str(r["doc_id"]))
    assert rows(decontaminate.report(docs, bench, max_windows=most), "doc_id") == want
    kept = {r["doc_id"] for r in want if not r["contaminated"]}
    assert {r.doc_id for r in decontaminate.clean(docs, bench, max_windows=most).collect()} == kept
    cut = decontaminate.clean(docs, bench, spans=True)
    assert cut.count() == docs.count()
    assert cut.where("doc_id = 9000").first().text.split() == ["Before", ".", "after"]


def test_decontamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = rows(decontaminate.report(odd(spark), none), "doc_id")
    assert len(got) == len(ODD) and not any(r["n_hit"] for r in got)
    assert decontaminate.report(odd(spark).limit(0), none).count() == 0


def test_mixing(spark):
    docs = docs_of(spark).withColumn("source", F.when(F.col("doc_id") % 5 == 0, "hot").when(F.col("doc_id") % 41 == 0, None).otherwise(F.col("source")))
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(odd(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("tiny").alias("source"), F.lit(0).cast("long").alias("n_chars")))
    sizes, got = {}, mixing.copies(docs).join(docs.select("doc_id", "source").distinct(), "doc_id", "left")
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.SPACED.findall(r.text or ""))
    want = brute.targets(sizes)
    taken = {}
    got = mixing.copies(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    for s, n in sizes.items():
        assert [r.target for r in got if r.source_size == n][0] == pytest.approx(want[s])
        most = max((r["size"] for r in got if r.source_size == n), default=0)
        assert abs(taken[n] - want[s]) <= most / 2 + 1
    assert sorted(map(str, mixing.copies(docs.repartition(5)).collect())) == sorted(map(str, got))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.copies(docs.limit(0)).count() == 0


def test_mixing_splits_hot_classes(spark, monkeypatch):
    docs = spark.range(1000).selectExpr("id as doc_id", "'a b c' as text", "if(id < 900, 'a', 'b') as source")
    want = sorted(r.taken for r in mixing.copies(docs).where("source_size = 2700").collect())
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 50)
    got = mixing.copies(docs)
    assert sorted(r.taken for r in got.where("source_size = 2700").collect()) == want
    assert abs(sum(want) - got.where("source_size = 2700").first().target) <= 3


def test_row_numbers_do_not_depend_on_file_splits(spark, tmp_path):
    docs_of(spark).repartition(6, "doc_id").write.parquet(f"file://{tmp_path}/docs")
    rows_ = Scratch(spark).numbered(spark.read.parquet(f"file://{tmp_path}/docs"))
    first = {r._row: r.doc_id for r in rows_.select("_row", "doc_id").collect()}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("1k", "30k", "512m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert {r._row: r.doc_id for r in rows_.select("_row", "doc_id").collect()} == first
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_sharding(spark):
    docs = docs_of(spark).unionByName(odd(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n_chars")))
    same = docs.where("doc_id = 5")
    for _ in range(5):
        same = same.unionByName(same)
    docs = docs.unionByName(same)
    limit = 20_000
    got = sharding.shards(docs, limit).collect()
    assert len(got) == docs.count() and {"text", "lang", "shard"} <= set(got[0].asDict())
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(len((r.text or "").encode()))
        assert len(r.shard) == r.shard_depth
    for s, sizes in by.items():
        assert sum(sizes) <= limit or len(sizes) == 1
        assert not any(o != s and o.startswith(s) for o in by)  # a prefix code: no bucket inside another
    for s in by:  # only oversized buckets were split: with its sibling, a bucket does not fit
        whole = [x for o, sizes in by.items() if o.startswith(s[:-1]) for x in sizes]
        assert not s or (sum(whole) > limit and len(whole) > 1)
    assert {r.shard: r.shard_bytes for r in got} == {s: sum(x) for s, x in by.items()}
    assert sharding.assignment(docs.limit(0)).count() == 0
    assert {r.shard for r in sharding.assignment(docs, 1 << 30).collect()} == {""}
