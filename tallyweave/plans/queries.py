"""Registered queries of the linkage operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import fold_of, id_key
from ..functions.similarity import cosine
from ..operators import blocking, features, learning, scoring, validate
from ..params import NAIVE_TAUS, BlockParams, MatchParams
from ..sources import tsv
from ..store import written
from . import surrogate
from .oracle import ORACLES
from .surrogate import Run

P = BlockParams()
Query = Callable[[SparkSession, str], DataFrame]


def r4(x: Column | str) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) * 10000.0 + 0.5) / 10000.0


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r4(c) for c in columns})


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return _table("part")(spark, sf).select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct()


def q_normalize(spark, sf):
    return _table("documents")(spark, sf).select("doc_id", X.normalize(F.col("text")).alias("norm"))


def q_normalize_matcher(spark, sf):
    return _table("documents")(spark, sf).select("doc_id", X.normalize(F.col("text"), True).alias("norm"))


def q_strip_web(spark, sf):
    return _table("pages")(spark, sf).select("page_id", X.strip_web(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1)).alias("host"))


def q_skeleton(spark, sf):
    return _words(spark, sf).select("w", X.skeleton(F.col("w")).alias("skeleton"))


def q_trigrams(spark, sf):
    return _words(spark, sf).select("w", F.posexplode(X.trigrams(F.col("w"))).alias("i", "gram")).select("w", (F.col("i") + 1).alias("i"), "gram")


def q_canon_addr(spark, sf):
    rows = [("L1", "05Th Floor, 0046"), ("L2", "01018 KENWOOD ST, HAMMOND, IN"), ("L3", "1018 Kenwood Street, Glenville, North Carolina"), ("L4", "null road 000 West Bengal"), ("L5", "00abc Goa na")]
    er = surrogate.entities(spark, sf).select("id", "addr").unionByName(spark.createDataFrame(rows, "id string, addr string"))
    return er.select("id", F.array_join(X.addr_words(F.col("addr")), " ").alias("addr"))


def q_name_core(spark, sf):
    nw = X.name_words(F.col("name"))
    return surrogate.entities(spark, sf).select("id", F.array_join(nw, " ").alias("words"), F.array_join(X.core_words(nw), " ").alias("core"))


def q_translit(spark, sf):
    rows = [("बालाजी",), ("अरिहंत",), ("Anitra Vásquez Money L.L.C.",), ("bethchapel.com",)]
    return spark.createDataFrame(rows, "name string").select("name", F.array_join(X.name_words(F.col("name")), " ").alias("words"))


def q_holdout(spark, sf):
    return surrogate.entities(spark, sf).where(blocking.is_holdout(F.col("id"))).select("id")


def q_folds(spark, sf):
    return surrogate.entities(spark, sf).select("id", id_key(F.col("id")).alias("key")).withColumn("fold", fold_of(F.col("key")))


def q_tokens(spark, sf):
    return blocking.tokens(surrogate.entities(spark, sf))


def _vocab(spark, sf):
    b = surrogate.sides(spark, sf)[1]
    toks, counts = blocking.tokens(b), blocking.country_counts(b)
    return toks, blocking.vocabulary(toks, counts), counts


def q_idf(spark, sf):
    return _round(_vocab(spark, sf)[1], "idf")


def q_doc_norm(spark, sf):
    return _round(blocking.weighted(*_vocab(spark, sf)), "w").select("id", "ch", "tag", "tok", "w")


def q_block_scores(spark, sf):
    return Run(spark, sf, P).scores


def q_rarest_fallback(spark, sf):
    return Run(spark, sf, BlockParams(max_df=3, max_df_trig=2)).scores


def _topk(i: int) -> Query:
    def run(spark, sf):
        x = Run(spark, sf, P)
        s = blocking.listed_pairs(x.a, x.b, i, P)
        key, k = blocking.rankings(s, P)[i]
        rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.col("key").desc(), "cand_id"))
        return s.withColumn("key", key).withColumn("r", rank).where((F.col("r") <= k) & (F.col("key") > 0)).select("s1_id", "cand_id", "r", r4("key").alias("score"))

    return run


def q_candidates(spark, sf):
    return _round(Run(spark, sf, P).cands, *blocking.GROUPS, "total")


def q_candidate_lists(spark, sf):
    x = Run(spark, sf, P)
    return tsv.candidate_lists(x.a, x.cands)


def q_scored_roundtrip(spark, sf):
    """Scored lists as text, and parsed again with their numbers of four decimals."""
    x = Run(spark, sf, P)
    return tsv.parse_scored(tsv.candidate_lists(x.a, x.cands, True)).select("s1_id", "cand_id", "rank")


def q_labels(spark, sf):
    x = Run(spark, sf, P)
    return features.labels(x.cands.select("s1_id", "cand_id"), x.truth)


def q_misses(spark, sf):
    x = Run(spark, sf, P)
    return scoring.misses(x.cands, x.truth, x.gts, limit=None)


def q_misses_short(spark, sf):
    """Misses of lists that keep the best two by total only."""
    x = Run(spark, sf, P)
    return scoring.misses(x.cands.where("rank < 2"), x.truth, x.gts, limit=None)


def q_summary(spark, sf):
    return _round(scoring.summary(Run(spark, sf, P).gts), "singleton_share")


def q_context(spark, sf):
    return _round(features.context(Run(spark, sf, P).cands), "best", "cand_sum", "cand_best", "cand_next").select("s1_id", "cand_id", "n_cands", "best", "row_n_high", "row_n_med", "claims", "cand_sum", "cand_best", "cand_next")


def _features(x: Run, fuzzy=False):
    return features.pair_features(x.cands, features.attributes(x.a), features.attributes(x.b), MatchParams(), fuzzy)


def _some(*columns: str) -> Query:
    return lambda spark, sf: _round(_features(Run(spark, sf, P)).select("s1_id", "cand_id", *columns), *columns)


def q_feat_lev(spark, sf):
    x = Run(spark, sf, P)
    plain = lambda df: features.attributes(df.withColumns({c: F.replace(F.col(c), F.lit("ß"), F.lit("ss")) for c in ("name", "addr")}))
    pairs = features.pair_features(x.cands, plain(x.a), plain(x.b), MatchParams(), False)
    return pairs.select("s1_id", "cand_id", r4("f_lev_name").alias("lev_name"), r4("f_lev_addr").alias("lev_addr"))


def q_features(spark, sf):
    return _round(_features(Run(spark, sf, P), True), *features.FEATURES)


def q_recall_at_k(spark, sf):
    x = Run(spark, sf, P)
    return _round(scoring.recall_at_k(x.cands, x.truth, x.ids), "pair_recall", "full_recall", "oracle_f05", "avg_cands")


def _swept(spark, sf):
    x = Run(spark, sf, P)
    swept = scoring.sweep(x.cands, x.truth, x.gts, "total", NAIVE_TAUS)
    return swept.withColumn("f05", F.floor(F.col("f05") * 1e8 + 0.5) / 1e8)  # so that equal thresholds tie


def q_f05_sweep(spark, sf):
    return _round(_swept(spark, sf), "f05", "prec", "rec")


def q_best_tau(spark, sf):
    return _round(scoring.best_tau(_swept(spark, sf)), "f05")


def q_bands(spark, sf):
    x = Run(spark, sf, P)
    return _round(scoring.bands(features.labels(x.cands, x.truth).withColumn("prob", F.col("total") / 4), 0.5), "mean_prob")


def q_cutoff_sweep(spark, sf):
    x = Run(spark, sf, P)
    return _round(scoring.cutoff_sweep(x.cands, x.truth, x.gts, "total", 1.6), "kept_share", "f05", "delta")


def q_prune(spark, sf):
    x = Run(spark, sf, P)
    return tsv.candidate_lists(x.a, scoring.pruned(x.cands, 0.8))


def q_counts(spark, sf):
    x = Run(spark, sf, P)
    return scoring.counts(x.ids.select("s1_id"), x.cands.where(F.col("total") >= 1.6))


def q_pair_cosine(spark, sf):
    e = _table("embeddings")(spark, sf)
    a, b = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"), (F.col("vec_id") + 1).alias("b_id")), e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return a.join(b, "b_id").select("a_id", "b_id", r4(cosine(F.col("a"), F.col("b"))).alias("cosine"))


def q_char_tfidf(spark, sf):
    return _round(features.char_tfidf(surrogate.entities(spark, sf), "name"), "w")


def q_validate(spark, sf):
    """Rules on candidate lists into which faults were put by id."""
    x = Run(spark, sf, P)
    lists = tsv.candidate_lists(x.a, x.cands).where("items <> ''").withColumn("bad", F.substring("s1_id", 4, 20).cast("long") % 20)
    items = F.when(F.col("bad") == 1, F.concat_ws(",", "items", F.split("items", ",")[0])).when(F.col("bad") == 2, F.lit("S1-1,X9-2")).otherwise(F.col("items"))
    lines = lists.where("bad <> 3").select(F.concat_ws("\t", "s1_id", items).alias("value"))
    return validate.list_rows_report(lines, x.a.select("id")).withColumn("examples", F.array_join("examples", ","))


def q_gbt_predict(spark, sf):
    """Trained on four folds, applied to all pairs."""
    x = Run(spark, sf, P)
    pairs = written(features.labels(_features(x), x.truth), "features")
    m = learning.train(pairs, x.truth, x.gts, MatchParams())
    return learning.matches(m.predict(pairs), m.tau).select("s1_id", "cand_id", r4("prob").alias("prob"))


QUERIES: dict[str, Query] = {name: f for name, f in globals().items() if name.startswith("q_")} | {
    **{f"q_topk_{n}": _topk(i) for i, n in enumerate(("total", "agree", "noaddr", "g0", "g1", "g2", "g3"))},
    "q_feat_overlap": _some("ninter", "njacc", "ncont_a", "ncont_b", "ainter", "ajacc", "acont_a", "acont_b"),
    "q_feat_numbers": _some("num_match", "num_first", "pin_eq", "pin_both"),
    "q_feat_lens": _some("name_eq", "addr_eq", "nlen_ratio", "alen_ratio", "ntok_a", "ntok_b", "atok_a", "atok_b", "has_addr_a", "has_addr_b", "cand_is_s3"),
}
ORACLES = {k: v for k, v in ORACLES.items() if k in QUERIES}
