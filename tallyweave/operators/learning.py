"""Matching: boosted trees on pair features, a decision threshold, predictions and reports."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fold_of, id_key
from ..params import BASELINE_TAUS, MODEL_TAUS, MatchParams
from ..sources import tsv
from . import scoring
from .features import FEATURES

EVAL_FOLD, CALIBRATION_FOLD = 3, 4


@dataclass
class Matcher:
    model: GBTClassificationModel
    features: list[str]
    tau: float = 0.5
    f05: float = 0.0
    trees: int = 0
    baseline_tau: float = 0.0
    baseline_f05: float = 0.0

    def predict(self, pairs: DataFrame) -> DataFrame:
        """pairs with prob. The features must be those of training, in their order."""
        assert_features(pairs, self.features)
        made = self.model.transform(_vectors(pairs, self.features)).withColumn("prob", vector_to_array("probability")[1])
        return made.drop("features", "rawPrediction", "probability", "prediction")

    def importances(self, n: int = 15) -> list[tuple[str, float]]:
        return sorted(zip(self.features, self.model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])[:n]


def assert_features(pairs: DataFrame, features: list[str]) -> None:
    missing = [f for f in features if f not in pairs.columns]
    if missing or [c for c in pairs.columns if c in features] != features:
        raise ValueError(f"the features differ from the model's: {missing or 'another order'}")


def _vectors(pairs: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(pairs)


def with_fold(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("fold", fold_of(id_key(F.col("s1_id"))))


def _trees(p: MatchParams, rounds: int, stop_early: bool) -> GBTClassifier:
    t = GBTClassifier(labelCol="y", maxIter=rounds, stepSize=p.step, maxDepth=p.depth, minInstancesPerNode=p.min_leaf, subsamplingRate=p.subsample, featureSubsetStrategy=p.feature_share, seed=p.seed)
    return t.setValidationIndicatorCol("held") if stop_early else t


def _fit_twice(data: DataFrame, p: MatchParams) -> tuple[GBTClassificationModel, GBTClassificationModel]:
    """The model that stops early, and the one on both folds with as many trees. A round is some small jobs that leave most cores idle, so
    the second fit starts beside the first with all rounds; if the first stops before, it is given up and made anew."""
    sc, tag = data.sparkSession.sparkContext, f"all-rounds-{uuid.uuid4().hex}"
    made: list[GBTClassificationModel] = []
    failed: list[Exception] = []

    def ahead() -> None:
        sc.addJobTag(tag)
        try:
            made.append(_trees(p, p.rounds, False).fit(data))
        except Exception as e:
            failed.append(e)

    beside = InheritableThread(ahead, session=data.sparkSession)
    beside.start()
    try:
        first = _trees(p, p.rounds, True).fit(data)
        early = first.getNumTrees < p.rounds
    except BaseException:
        early = True
        raise
    finally:
        if early:
            while beside.is_alive():  # it may be between two jobs
                sc.cancelJobsWithTag(tag)
                beside.join(0.2)
        beside.join()
    if early:
        return first, _trees(p, first.getNumTrees, False).fit(data)
    if failed:
        raise failed[0]
    return first, made[0]


def train(pairs: DataFrame, truth: DataFrame, gts: DataFrame, p: MatchParams = MatchParams(), features: list[str] = FEATURES) -> Matcher:  # noqa: B008
    """Fit with early stopping on one fold, fit again on both with that many trees, choose tau on the calibration fold. pairs: s1_id, cand_id, features, y."""
    data = _vectors(with_fold(pairs), features).where(F.col("fold") != CALIBRATION_FOLD).select("features", F.col("y").cast("double").alias("y"), (F.col("fold") == EVAL_FOLD).alias("held")).persist()
    first, again = _fit_twice(data, p)
    data.unpersist()
    m = Matcher(again, list(features), trees=first.getNumTrees)
    held = m.predict(_calibration(pairs)).select("s1_id", "cand_id", "prob", "sc_total").persist()
    ids = _calibration(gts)
    best = scoring.best_tau(scoring.sweep(held, truth, ids, "prob", MODEL_TAUS)).first()
    if best is not None and best.f05 is not None:
        m.tau, m.f05 = best.tau, best.f05
    base = scoring.best_tau(scoring.sweep(held, truth, ids, "sc_total", BASELINE_TAUS)).first()
    if base is not None and base.f05 is not None:
        m.baseline_tau, m.baseline_f05 = base.tau, base.f05
    held.unpersist()
    return m


def _calibration(rows: DataFrame) -> DataFrame:
    return with_fold(rows).where(F.col("fold") == CALIBRATION_FOLD)


def save(m: Matcher, path: str) -> None:
    """The trees and what goes with them, in two folders below path."""
    m.model.write().overwrite().save(f"{path}/model")
    meta = {"features": m.features, "tau": m.tau, "f05": m.f05, "trees": m.trees, "baseline_tau": m.baseline_tau, "baseline_f05": m.baseline_f05}
    tsv.write_meta(SparkSession.active(), f"{path}/meta", meta)


def load(path: str) -> Matcher:
    return Matcher(GBTClassificationModel.load(f"{path}/model"), **tsv.read_meta(SparkSession.active(), f"{path}/meta"))


def report(m: Matcher, pairs: DataFrame, truth: DataFrame, gts: DataFrame, countries: DataFrame) -> DataFrame:
    """score, tau, country ('ALL' for all), ids, f05, prec, rec on the calibration fold: the matcher, and the blocking total alone."""
    held, ids = m.predict(_calibration(pairs)).select("s1_id", "cand_id", "prob", "sc_total"), _calibration(gts)
    every = countries.select("id", "country").unionByName(countries.select("id", F.lit("ALL").alias("country")))
    of = lambda name, score, tau: by_country(held.withColumn("prob", F.col(score)), truth, ids, every, tau).select(F.lit(name).alias("score"), F.lit(tau).alias("tau"), "country", "ids", "f05", "prec", "rec")
    return of("matcher", "prob", m.tau).unionByName(of("baseline", "sc_total", m.baseline_tau))


def matches(predicted: DataFrame, tau: float, cutoff: float | None = None) -> DataFrame:
    """Pairs of a probability of tau or more; below a cutoff of the blocking total a pair is neither candidate nor match."""
    kept = predicted if cutoff is None else scoring.pruned(predicted, cutoff)
    return kept.where(F.col("prob") >= tau)


def by_country(predicted: DataFrame, truth: DataFrame, gts: DataFrame, countries: DataFrame, tau: float) -> DataFrame:
    """country, ids, f05, prec, rec at tau."""
    hits = scoring.flagged(predicted.where(F.col("prob") >= tau), truth).groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_pred"), F.sum("hit").alias("tp"))
    rows = gts.join(countries.select(F.col("id").alias("s1_id"), "country"), "s1_id").join(hits, "s1_id", "left").na.fill(0, ["n_pred", "tp"])
    least1 = lambda c: F.greatest(F.sum(c), F.lit(1))
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("ids"), F.avg(scoring.f05(F.col("tp"), F.col("n_pred"), F.col("gt_count"))).alias("f05"), (F.sum("tp") / least1("n_pred")).alias("prec"), (F.sum("tp") / least1("gt_count")).alias("rec"))
