import threading

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import blocking, features, learning, scoring, validate
from tallyweave.params import BlockParams, MatchParams
from tallyweave.plans import linkage, queries, surrogate
from tallyweave.sources import tsv

S1 = [("S1-101", "Acme Trading Co", "12 Main St", "US"), ("S1-102", "Beta Foods Pvt Ltd", "8 Market Road", "India"), ("S1-103", "Gamma SARL", "5 Rue de la Paix", "France"), ("S1-104", "Nowhere", "", "Peru")]
S2 = [("S2-201", "Acme Trading Company", "12 Main Street", "US"), ("S2-202", "Beta Foods", "8 Market Rd", "India"), ("S2-203", "Beta Foods", "", "India")]
S3 = [("S3-301", "Gamma SARL", "5 Rue de la Paix", "France")]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("records")
    for k, rows in (("1", S1), ("2", S2), ("3", S3)):
        (d / f"s{k}.tsv").write_text(f"source{k}_entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "\n\n".join("\t".join(r) for r in rows) + '\nS%s-999\t"quoted\n' % k)
    return d


def test_block_and_check(spark, files, tmp_path):
    out = str(tmp_path)
    cands = linkage.block(spark, f"{files}/s1.tsv", f"{files}/s2.tsv", f"{files}/s3.tsv", out)
    got = {(r.s1_id, r.cand_id): r for r in cands.collect()}
    assert set(got) >= {("S1-101", "S2-201"), ("S1-102", "S2-202"), ("S1-102", "S2-203"), ("S1-103", "S3-301")}
    assert not any(s == "S1-104" for s, _ in got)
    assert got["S1-103", "S3-301"].total == pytest.approx(3.8)
    lists = {r.s1_id: r.items for r in tsv.read_lists(spark, f"{out}/candidate_pairs").collect()}
    assert lists["S1-104"] == "" and lists["S1-102"] == "S2-202,S2-203" and len(lists) == 5
    scored = tsv.read_scored(spark, f"{out}/candidates_scored").collect()
    assert {(r.s1_id, r.cand_id, r["rank"]) for r in scored} == {(r.s1_id, r.cand_id, r["rank"]) for r in got.values()}
    report, code = linkage.check(spark, out, f"{files}/s1.tsv", [f"{files}/s2.tsv", f"{files}/s3.tsv"])
    assert code == 0 and report.count() == 0
    assert linkage.check(spark, out, f"{files}/s1.tsv", None)[0].where("rule = 'ids are not checked'").count() == 1


def test_holdout_and_limit(spark):
    s1 = spark.createDataFrame([(f"S1-{i}", "a", "b", "c") for i in range(200)], "id string, name string, addr string, country string")
    held = blocking.queries_of(s1, BlockParams(val_only=True)).count()
    assert 5 < held < 40 and blocking.queries_of(s1, BlockParams(limit=7)).count() == 7


def test_frequency_cap_falls_back_to_the_rarest(spark):
    rows = [(f"S2-{i}", "common word", "", "US") for i in range(6)] + [("S2-9", "common rare", "", "US")]
    cols = "id string, name string, addr string, country string"
    s1 = spark.createDataFrame([("S1-1", "common word", "", "US")], cols)
    got = blocking.scored_pairs(s1, spark.createDataFrame(rows, cols), BlockParams(max_df=2, max_df_trig=2))
    assert 0 < got.count() <= 6


def test_rules(spark):
    lines = [("S1-1\tS2-1,S2-1",), ("S1-1\tS3-2",), ("S1-2\tS1-1,X",), ("no tab",), ("  ",), ("S1-9\tS2-77",)]
    req = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "id string")
    known = spark.createDataFrame([("S2-1",), ("S3-2",)], "id string")
    got = {r.rule: (r.n, r.examples) for r in validate.list_rows_report(spark.createDataFrame(lines, "value string"), req, known).collect()}
    assert got == {
        "row without tab": (1, ["no tab"]), "repeated row": (1, ["S1-1"]), "repeated id in a list": (1, ["S1-1"]), "S1 id in a list": (1, ["S1-1"]), "unknown prefix": (1, ["X"]),
        "missing row": (1, ["S1-3"]), "row of an unknown S1 id": (1, ["S1-9"]), "unknown id": (1, ["S2-77"]),
    }
    assert validate.header_error("a,b", tsv.MATCH_HEADER) and validate.header_error("", tsv.MATCH_HEADER) and validate.header_error("a\tb", tsv.MATCH_HEADER) and not validate.header_error("Source1_entity_id\t matched_entity_ids ", tsv.MATCH_HEADER)
    assert validate.validate_file(spark, "/nowhere/at/all", tsv.MATCH_HEADER, req).first().rule.startswith("unreadable")


def test_scores(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "s1_id string, cand_id string")
    pairs = spark.createDataFrame([("a", "x", 0.9), ("a", "q", 0.8), ("c", "z", 0.3)], "s1_id string, cand_id string, prob double")
    gts = scoring.gt_counts(ids, truth)
    got = {round(r.tau, 2): r for r in scoring.sweep(pairs, truth, gts, "prob", [0.2, 0.5, 0.95]).collect()}
    assert got[0.5].f05 == pytest.approx((1.25 / 2.5 + 0 + 1 + 1) / 4) and got[0.5].prec == 0.5 and got[0.5].rec == pytest.approx(1 / 3)
    assert got[0.2].f05 == pytest.approx((0.5 + 0 + 0 + 1) / 4) and got[0.95].f05 == 0.5
    same = spark.createDataFrame([(0.1, 0.5), (0.2, 0.5)], "tau double, f05 double")
    assert scoring.best_tau(same).first().tau == 0.2 and scoring.best_tau(same, False).first().tau == 0.1


def test_context_next_best_is_strictly_lower(spark):
    rows = [("a", "x", 2.0), ("b", "x", 2.0), ("c", "x", 1.0), ("a", "y", 0.5)]
    got = features.context(spark.createDataFrame(rows, "s1_id string, cand_id string, total double")).collect()
    assert {r.cand_next for r in got if r.cand_id == "x"} == {1.0} and {r.cand_next for r in got if r.cand_id == "y"} == {0.0}


def test_train_and_predict(spark, tmp_path):
    run = surrogate.Run(spark, "/root/testdata/sf0.001")
    a, b, truth, cands = run.a, run.b, run.truth, run.cands
    table = linkage.training_table(cands, a, b, truth).persist()
    assert set(features.FEATURES) <= set(table.columns) and len(features.FEATURES) == 44
    gts = scoring.gt_counts(a.select(F.col("id").alias("s1_id")), truth)
    m = learning.train(table, truth, gts, MatchParams(rounds=3, depth=2, min_leaf=2))
    scored = linkage.predict(m, cands, a, b, str(tmp_path), cutoff=0.8)
    assert scored.count() == cands.count() and scored.where("prob < 0 or prob > 1").count() == 0
    assert tsv.read_lists(spark, f"{tmp_path}/matching_results").count() == a.count()
    assert len(m.importances()) == 15 and linkage.cache_tag(cands).count("x") == 1
    with pytest.raises(ValueError):
        m.predict(table.drop("njacc"))
    learning.save(m, f"{tmp_path}/matcher")
    again = learning.load(f"{tmp_path}/matcher")
    assert (again.tau, again.trees, again.features, again.baseline_tau) == (m.tau, m.trees, m.features, m.baseline_tau)
    prob = lambda x: {(r.s1_id, r.cand_id): r.prob for r in x.predict(table).collect()}
    assert prob(again) == prob(m)
    report = {(r.score, r.country): r for r in learning.report(m, table, truth, gts, a).collect()}
    assert report["matcher", "ALL"].f05 == pytest.approx(m.f05) and report["baseline", "ALL"].f05 == pytest.approx(m.baseline_f05)
    assert learning.by_country(m.predict(table), truth, gts, a, m.tau).count() == a.select("country").distinct().count()


@pytest.fixture(scope="module")
def entity_files(spark, tmp_path_factory):
    """Record files and truth whose pairs are copies with another spelling."""
    d = tmp_path_factory.mktemp("entities")
    words = ["amber", "birch", "cedar", "delta", "ember", "flint", "grove", "heron", "iris", "jade", "kite", "lotus"]
    name = lambda i: f"{words[i % 12]} {words[i // 12 % 12]} trading {i}"
    ids = range(400)
    head = "id\tname\taddress\tcountry\n"
    (d / "s1.tsv").write_text(head + "".join(f"S1-{i}\t{name(i)} ltd\t{i} main road\tUS\n" for i in ids))
    (d / "s2.tsv").write_text(head + "".join(f"S2-{i}\t{name(i)}\t{i} main rd\tUS\n" for i in ids if i % 5))
    (d / "s3.tsv").write_text(head + "".join(f"S3-{i}\t{name(i + 1)}\t{i} other street\tUS\n" for i in ids if i % 3))
    (d / "truth.tsv").write_text("s1\tids\n" + "".join(f"S1-{i}\t{f'S2-{i}' if i % 5 else ''}\n" for i in ids))
    return d


def test_from_files_to_a_bundle(spark, entity_files, tmp_path):
    s1, s2, s3, truth = (f"{entity_files}/{x}.tsv" for x in ("s1", "s2", "s3", "truth"))
    m = linkage.fit(spark, s1, s2, s3, truth, f"{tmp_path}/fit", BlockParams(val_mod=2), MatchParams(rounds=3, depth=2, min_leaf=2))
    assert spark.read.json(f"{tmp_path}/fit/matcher/report").where("country = 'ALL'").count() == 2
    assert "x" in tsv.read_meta(spark, f"{tmp_path}/fit/validation_tag")["tag"]
    out = f"{tmp_path}/out"
    report, code = linkage.link(spark, f"{tmp_path}/fit/matcher", s1, s2, s3, out, None)
    assert code == 0 and report.count() == 0
    before = {r.s1_id: set(filter(None, r["items"].split(","))) for r in tsv.read_lists(spark, f"{out}/candidate_pairs").collect()}
    scored = spark.read.parquet(f"{out}/scored.parquet")
    cut = scored.approxQuantile("total", [0.5], 0.0)[0] + 1e-9
    names = linkage.handoff(spark, out, f"{tmp_path}/fit/matcher", s1, str(tmp_path / "b.zip"), cutoff=cut, limit=1)
    assert any(n.startswith("matching_results/part-") for n in names) and any(n.startswith("matcher/meta/part-") for n in names)
    after = {r.s1_id: set(filter(None, r["items"].split(","))) for r in tsv.read_lists(spark, f"{out}/candidate_pairs").collect()}
    kept = {(r.s1_id, r.cand_id) for r in scored.where(F.col("total") >= cut).collect()}
    assert after.keys() == before.keys() and {(s, c) for s, x in after.items() for c in x} == kept and len(kept) < sum(map(len, before.values()))
    matched = {(r.s1_id, c) for r in tsv.read_lists(spark, f"{out}/matching_results").collect() for c in filter(None, r["items"].split(","))}
    assert matched == {(r.s1_id, r.cand_id) for r in scored.where((F.col("total") >= cut) & (F.col("prob") >= m.tau)).collect()}
    tsv.list_rows(spark.createDataFrame([("S1-1",)], "id string"), scored.limit(0), ["cand_id"]).select("s1_id").write.mode("overwrite").text(f"{out}/matching_results")
    with pytest.raises(ValueError):
        linkage.handoff(spark, out, f"{tmp_path}/fit/matcher", s1, str(tmp_path / "c.zip"))


def test_store_and_encoding(spark, files, tmp_path):
    tsv.write_store(tsv.read_records(spark, f"{files}/s2.tsv"), f"{tmp_path}/store")
    got = {r.id: r.name for r in tsv.lookup(tsv.read_store(spark, f"{tmp_path}/store"), spark.createDataFrame([("S2-202",), ("S2-0",)], "id string")).collect()}
    assert got == {"S2-202": "Beta Foods", "S2-0": None}
    (tmp_path / "latin.tsv").write_bytes("\t".join(tsv.MATCH_HEADER).encode() + b"\nS1-101\tS2-\xe9\n")
    ids = tsv.read_ids(spark, f"{files}/s1.tsv")
    assert [r.rule for r in validate.validate_file(spark, f"{tmp_path}/latin.tsv", tsv.MATCH_HEADER, ids).collect()] == ["not UTF-8"]


def test_package(tmp_path):
    (tmp_path / "src/target").mkdir(parents=True)
    (tmp_path / "src/target/x").write_text("1")
    (tmp_path / "src/a.py").write_text("1")
    (tmp_path / "r.txt").write_text("1")
    assert linkage.package(str(tmp_path / "o.zip"), [str(tmp_path / "r.txt")], str(tmp_path / "src")) == ["r.txt", "src/a.py"]
    with pytest.raises(FileNotFoundError):
        linkage.package(str(tmp_path / "o.zip"), [str(tmp_path / "no")], str(tmp_path / "src"))


def test_pairs_are_dealt_twice_for_features(spark, monkeypatch):
    """Once by S1 record and once by candidate, each with the records' attributes."""
    pairs = spark.range(50).selectExpr("concat('S1-', id % 9) AS s1_id", "concat('S2-', id) AS cand_id", *(f"double(id % 7) / {k} AS g{k - 1}" for k in (1, 2, 3, 4)), "double(id % 5) AS total", "int(id % 4) AS rank")
    records = lambda s, n: features.attributes(spark.range(n).selectExpr(f"concat('{s}-', id) AS id", "concat('name ', id) AS name", "concat(id, ' street') AS addr"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        made = features.pair_features(pairs, records("S1", 9), records("S2", 50), fuzzy=False)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == 50
    finally:
        spark.conf.set(key, before)
    assert plan.count("Exchange hashpartitioning(s1_id") == plan.count("Exchange hashpartitioning(cand_id") == 2


def _grouped(spark):
    """Two S1 records with one target each and none, and a group of 40 S1 records and 60 targets."""
    s1 = spark.range(42).selectExpr("concat('S1-', id) AS s1_id", "if(id < 40, 0L, id) AS grp", "if(id < 40, 60L, 1L) AS n_true")
    targets = spark.range(62).selectExpr("concat('S2-', id) AS cand_id", "if(id < 60, 0L, id - 20) AS grp")
    pairs = s1.join(targets, "grp").select("s1_id", "cand_id")
    cands = spark.range(0, 42).selectExpr("concat('S1-', id) AS s1_id", "explode(sequence(0, 61, 7)) AS j").selectExpr("s1_id", "concat('S2-', j) AS cand_id", "double(j) / 30 AS total", "int(j / 7) AS rank")
    return scoring.Groups(s1, targets), pairs, cands, spark.range(45).selectExpr("concat('S1-', id) AS s1_id", "if(id % 2 = 0, 'US', 'FR') AS country")


def test_truth_as_groups_and_as_pairs(spark):
    """All measures are those of the listed pairs."""
    groups, pairs, cands, ids = _grouped(spark)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    gts = scoring.gt_counts(ids.select("s1_id"), pairs)
    assert rows(scoring.gt_counts(ids.select("s1_id"), groups)) == rows(gts)
    assert rows(features.labels(cands, groups)) == rows(features.labels(cands, pairs)) and features.labels(cands, groups).where("y = 1").count() > 100
    assert features.labels(cands, groups).columns == features.labels(cands, pairs).columns
    for f in (lambda t: scoring.sweep(cands, t, gts, "total", [0.2, 0.9, 1.7]), lambda t: scoring.cutoff_sweep(cands, t, gts, "total", 0.9), lambda t: scoring.recall_at_k(cands, t, ids)):
        assert [tuple(map(lambda v: round(v, 9) if isinstance(v, float) else v, r)) for r in rows(f(groups))] == [tuple(map(lambda v: round(v, 9) if isinstance(v, float) else v, r)) for r in rows(f(pairs))]
    for few in (cands, cands.where("rank < 2")):
        assert rows(scoring.misses(few, groups, gts, None)) == rows(scoring.misses(few, pairs, gts, None))
        assert scoring.misses(few, groups, gts, 50).collect() == scoring.misses(few, pairs, gts, 50).collect()


def test_truth_of_a_run_grows_with_the_records(spark, tmp_path, monkeypatch):
    """300 copies on one side and 600 on the other are 180,000 true pairs, which are neither written nor shuffled; all misses are returned."""
    spark.range(900).selectExpr("id AS doc_id", "'en' AS lang", "'one two three four five six seven eight nine' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    run = surrogate.Run(spark, str(tmp_path))
    assert run.truth.s1.count() == 300 and run.truth.targets.count() == 600
    assert run.gts.where("gt_count = 600").count() == 300
    monkeypatch.setattr(queries, "Run", lambda *_: run)
    run.cands = run.truth.s1.selectExpr("s1_id", "'S2-1' AS cand_id", "0 AS rank")
    assert queries.q_misses(spark, "").count() == queries.q_misses_short(spark, "").count() == 300 * 599
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = features.labels(run.cands, run.truth)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "Exchange hashpartitioning(s1_id" in plan and ", cand_id" not in "".join(x for x in plan.split("\n") if "Exchange" in x)


@pytest.mark.parametrize("noise", [False, True], ids=["all rounds", "stops early"])
def test_both_fits_run_side_by_side(spark, monkeypatch, noise):
    """The second fit has begun when the first is asked for, and is that of the first one's number of trees."""
    begun, made, real = threading.Event(), [], learning._trees

    def trees(p, rounds, stop_early):
        if stop_early:
            assert begun.wait(60)
        begun.set()
        made.append((rounds, stop_early))
        return real(p, rounds, stop_early)

    monkeypatch.setattr(learning, "_trees", trees)
    y = "double(xxhash64(id) % 2 = 0)" if noise else "double(id % 10 > 4)"
    rows = spark.range(400).selectExpr("id", f"{y} AS y", "double(id % 10) AS f", "id % 4 = 3 AS held")
    data = learning._vectors(rows, ["f"]).select("features", "y", "held").persist()
    p = MatchParams(rounds=4, depth=2, min_leaf=2, step=0.3)
    first, again = learning._fit_twice(data, p)
    assert (first.getNumTrees < 4) == noise and again.getNumTrees == first.getNumTrees
    assert again.toDebugString.split("\n")[1:] == real(p, first.getNumTrees, False).fit(data).toDebugString.split("\n")[1:]
    assert made[-1] == ((first.getNumTrees, False) if noise else (4, True))
    data.unpersist()
