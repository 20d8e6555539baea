"""From files to outputs: candidate generation, training, prediction, pruning, checks and bundles."""

from __future__ import annotations

import zipfile
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import id_key
from ..operators import blocking, features, learning, scoring, validate
from ..params import BlockParams, MatchParams
from ..sources import tsv


def block(spark: SparkSession, s1_path: str, s2_path: str, s3_path: str, out_dir: str, p: BlockParams = BlockParams()) -> DataFrame:  # noqa: B008
    """Writes candidates, scored candidates and matches by score below out_dir; returns the candidates."""
    s1 = blocking.queries_of(tsv.read_records(spark, s1_path, 1), p)
    cands = blocking.block(s1, tsv.targets(spark, s2_path, s3_path), p)
    cands.write.mode("overwrite").parquet(f"{out_dir}/candidates.parquet")
    cands = spark.read.parquet(f"{out_dir}/candidates.parquet")
    tsv.write_block_outputs(s1, cands, p.tau, out_dir)
    return cands


def training_table(cands: DataFrame, s1: DataFrame, targets: DataFrame, truth: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:  # noqa: B008
    """Features and labels of all candidate pairs; every id must resolve."""
    lost = features.unresolved(cands, s1, targets)
    if not lost.isEmpty():
        raise ValueError(f"candidates without a record: {[r.id for r in lost.limit(5).collect()]}")
    return features.labels(features.pair_features(cands, features.attributes(s1), features.attributes(targets), p), truth)


def cache_tag(cands: DataFrame) -> str:
    """Distinct S1 ids x candidate ids, exactly."""
    r = cands.agg(F.countDistinct("s1_id").alias("a"), F.countDistinct("cand_id").alias("b")).first()
    return f"{r.a}x{r.b}"


def fit(spark: SparkSession, s1_path: str, s2_path: str, s3_path: str, truth_path: str, out_dir: str, p: BlockParams = BlockParams(), mp: MatchParams = MatchParams()) -> learning.Matcher:  # noqa: B008
    """Trains on the held-out S1 records. Writes candidates, the training table with its ids and tag, the matcher and its report below out_dir."""
    p = replace(p, val_only=True)
    cands = block(spark, s1_path, s2_path, s3_path, out_dir, p)
    s1 = blocking.queries_of(tsv.read_records(spark, s1_path, 1), p)
    truth, _ = tsv.read_truth(spark, truth_path)
    ids = scoring.gt_counts(s1.select(F.col("id").alias("s1_id")), truth).join(s1.select(F.col("id").alias("s1_id"), "country"), "s1_id")
    ids.withColumn("key", id_key(F.col("s1_id"))).write.mode("overwrite").parquet(f"{out_dir}/validation_ids.parquet")
    training_table(cands, s1, tsv.targets(spark, s2_path, s3_path), truth, mp).write.mode("overwrite").parquet(f"{out_dir}/training.parquet")
    tsv.write_meta(spark, f"{out_dir}/validation_tag", {"tag": cache_tag(cands)})
    pairs, ids = spark.read.parquet(f"{out_dir}/training.parquet"), spark.read.parquet(f"{out_dir}/validation_ids.parquet")
    gts = ids.select("s1_id", "gt_count")
    m = learning.train(pairs, truth, gts, mp)
    learning.save(m, f"{out_dir}/matcher")
    learning.report(m, pairs, truth, gts, ids.select(F.col("s1_id").alias("id"), "country")).coalesce(1).write.mode("overwrite").json(f"{out_dir}/matcher/report")
    return m


def link(spark: SparkSession, matcher_path: str, s1_path: str, s2_path: str, s3_path: str, out_dir: str, cutoff: float | None = 0.8, p: BlockParams = BlockParams(), mp: MatchParams = MatchParams()) -> tuple[DataFrame, int]:  # noqa: B008
    """From record files to checked lists with a saved matcher; the report on them and its exit code."""
    cands = block(spark, s1_path, s2_path, s3_path, out_dir, p)
    s1 = blocking.queries_of(tsv.read_records(spark, s1_path, 1), p)
    predict(learning.load(matcher_path), cands, s1, tsv.targets(spark, s2_path, s3_path), out_dir, cutoff, mp)
    return check(spark, out_dir, s1_path, [s2_path, s3_path])


def prune_outputs(spark: SparkSession, out_dir: str, s1_path: str, tau: float, cutoff: float = 0.8, p: BlockParams = BlockParams()) -> None:  # noqa: B008
    """Writes both lists of a finished run anew, without the pairs below a cutoff. They come from the scored pairs, so a stopped run can be repeated."""
    scored = spark.read.parquet(f"{out_dir}/scored.parquet")
    _write_lists(blocking.queries_of(tsv.read_records(spark, s1_path, 1), p), scored, tau, cutoff, out_dir)


def evaluate(cands: DataFrame, truth: DataFrame, s1: DataFrame) -> dict[str, DataFrame]:
    ids = s1.select(F.col("id").alias("s1_id"), "country")
    gts = scoring.gt_counts(ids.select("s1_id"), truth)
    return {"summary": scoring.summary(gts), "recall": scoring.recall_at_k(cands, truth, ids), "naive": scoring.sweep(cands, truth, gts, "total", blocking_taus()), "misses": scoring.misses(cands, truth, gts)}


def blocking_taus() -> list[float]:
    from ..params import NAIVE_TAUS

    return NAIVE_TAUS


def predict(m: learning.Matcher, cands: DataFrame, s1: DataFrame, targets: DataFrame, out_dir: str, cutoff: float | None = None, p: MatchParams = MatchParams()) -> DataFrame:  # noqa: B008
    """Scores all pairs, writes matches (and candidates, if a cutoff prunes them) for every S1 id, returns the scored pairs."""
    x = features.pair_features(cands, features.attributes(s1), features.attributes(targets), p)
    scored = m.predict(x).select("s1_id", "cand_id", F.col("sc_total").alias("total"), "prob")
    scored.write.mode("overwrite").parquet(f"{out_dir}/scored.parquet")
    scored = s1.sparkSession.read.parquet(f"{out_dir}/scored.parquet")
    _write_lists(s1, scored, m.tau, cutoff, out_dir)
    return scored


def _write_lists(s1: DataFrame, scored: DataFrame, tau: float, cutoff: float | None, out_dir: str) -> None:
    best = [F.col("prob").desc(), F.col("cand_id")]
    tsv.write_lists(tsv.list_rows(s1, learning.matches(scored, tau, cutoff), best), f"{out_dir}/matching_results", tsv.MATCH_HEADER)
    if cutoff is not None:
        tsv.write_lists(tsv.candidate_lists(s1, scoring.pruned(scored, cutoff)), f"{out_dir}/candidate_pairs", tsv.CANDIDATE_HEADER)


def check(spark: SparkSession, out_dir: str, s1_path: str, target_paths: list[str] | None = None) -> tuple[DataFrame, int]:
    known, _ = tsv.read_match_targets(spark, target_paths) if target_paths else (None, [])
    return validate.validate(spark, f"{out_dir}/matching_results", f"{out_dir}/candidate_pairs", tsv.read_ids(spark, s1_path), known)


SKIPPED = {"target", "__pycache__", ".git"}


def package(zip_path: str, required: list[str], sources: str) -> list[str]:
    """A zip of required files and a source tree, in a fixed order and without build folders. Local files, on the driver."""
    missing = [f for f in required if not Path(f).is_file()]
    if missing:
        raise FileNotFoundError(f"missing: {missing}")
    root = Path(sources)
    tree = sorted(f for f in root.rglob("*") if f.is_file() and f.suffix != ".pyc" and not SKIPPED & set(f.relative_to(root).parts))
    names = [(Path(f), Path(f).name) for f in required] + [(f, str(Path(root.name) / f.relative_to(root))) for f in tree]
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as z:
        for f, name in names:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, f.read_bytes())
    return [n for _, n in names]


#: Folders of a run that a bundle holds
BUNDLED = ("matching_results", "candidate_pairs")
#: Bytes of candidate lists above which a bundle prunes them first
BUNDLE_BYTES = 750_000_000


def handoff(spark: SparkSession, out_dir: str, matcher_path: str, s1_path: str, zip_path: str, cutoff: float = 0.8, limit: int = BUNDLE_BYTES) -> list[str]:
    """A zip, on the driver, of a run's lists and its matcher. Large candidate lists are pruned first; a run that breaks a rule gives none."""
    fs_of = lambda path: (at := spark._jvm.org.apache.hadoop.fs.Path(path), at.getFileSystem(spark._jsc.hadoopConfiguration()))
    at, fs = fs_of(f"{out_dir}/candidate_pairs")
    if fs.getContentSummary(at).getLength() > limit:
        prune_outputs(spark, out_dir, s1_path, learning.load(matcher_path).tau, cutoff)
    report, code = check(spark, out_dir, s1_path)
    if code:
        raise ValueError(f"the outputs break rules: {[r.rule for r in report.where("severity = 'error'").collect()]}")
    names = []
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        for folder in (*(f"{out_dir}/{x}" for x in BUNDLED), matcher_path):
            at, fs = fs_of(folder)
            root, files = fs.getFileStatus(at).getPath(), fs.listFiles(at, True)
            while files.hasNext():
                f = files.next().getPath()
                names.append(f"{root.getName()}/{f.toString()[len(root.toString()) + 1:]}")
                copied = Path(f"{zip_path}.part")
                fs.copyToLocalFile(False, f, spark._jvm.org.apache.hadoop.fs.Path(f"file://{copied.absolute()}"), True)
                z.write(copied, names[-1])
                copied.unlink()
    return names
