"""Forty-four features of candidate pairs, in a fixed order.

candidates (s1_id, cand_id, g0..g3, total, rank) + records (id, name, addr) -> one row of doubles for each pair. Record attributes are
computed once per record and joined twice; context comes from windows over the S1 and the candidate side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.similarity import cosine, lev_sim, token_set_sim
from ..params import MatchParams
from . import scoring

# The columns of the feature matrix, in its order.
FEATURES = [
    "sc_total", "sc_name", "sc_join", "sc_fuzzy", "sc_addr", "agree", "rank", "n_cands", "rank_frac", "sc_rel_best", "sc_margin_best",
    "row_n_high", "row_n_med", "ninter", "njacc", "ncont_a", "ncont_b", "ainter", "ajacc", "acont_a", "acont_b", "num_match",
    "num_first", "pin_eq", "pin_both", "name_eq", "addr_eq", "nlen_ratio", "alen_ratio", "ntok_a", "ntok_b", "ntok_diff", "atok_a",
    "atok_b", "has_addr_a", "has_addr_b", "cand_is_s3", "cand_freq", "cand_best", "cand_mean", "cand_comp", "f_lev_name", "f_lev_addr", "f_tokset_name",
]
VECTOR_FEATURES = ["e_cos", "c_tfidf"]


def attributes(records: DataFrame) -> DataFrame:
    """id, nn, an (normalised texts), nt, at (distinct tokens), nums (the first four numbers), pin (0: none)."""
    nn, an = X.normalize(F.col("name"), True), X.normalize(F.col("addr"), True)
    made = records.select("id", nn.alias("nn"), an.alias("an"), X.name_words(F.col("name"), True).alias("nt"), X.addr_words(F.col("addr"), True).alias("at"))
    numbers = F.filter("at", lambda w: w.rlike("^[0-9]{1,10}$"))
    pin = F.try_element_at(F.filter(numbers, lambda w: F.length(w) >= 5), F.lit(1))
    return made.select("id", "nn", "an", F.array_distinct("nt").alias("nt"), F.array_distinct("at").alias("at"), F.slice(numbers, 1, 4).alias("nums"), F.coalesce(pin.cast("long").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0)).alias("pin"))


def _by_s1(pairs: DataFrame) -> DataFrame:
    row, t = Window.partitionBy("s1_id"), F.col("total")
    return pairs.withColumns({"n_cands": F.count(F.lit(1)).over(row), "best": F.max("total").over(row), "row_n_high": F.count_if(t >= 2.0).over(row), "row_n_med": F.count_if(t >= 1.5).over(row)})


def _by_candidate(pairs: DataFrame) -> DataFrame:
    cand, t = Window.partitionBy("cand_id"), F.col("total")
    pairs = pairs.withColumns({"claims": F.count(F.lit(1)).over(cand), "cand_sum": F.sum("total").over(cand), "cand_best": F.max("total").over(cand)})
    return pairs.withColumn("cand_next", F.coalesce(F.max(F.when(t < F.col("cand_best"), t)).over(cand), F.lit(0.0)))


def context(pairs: DataFrame) -> DataFrame:
    """pairs with list size, best total and counts by S1, and with claims, best, mean and next lower best by candidate."""
    return _by_candidate(_by_s1(pairs))


def _share(n: Column, of: Column) -> Column:
    return n / F.greatest(of, F.lit(1))


def _overlap(prefix: str, a: str, b: str) -> dict[str, Column]:
    both, na, nb = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return {f"{prefix}inter": both, f"{prefix}jacc": _share(both, na + nb - both), f"{prefix}cont_a": _share(both, na), f"{prefix}cont_b": _share(both, nb)}


def _length_gap(a: str, b: str) -> Column:
    la, lb = F.length(a), F.length(b)
    return F.abs(la - lb) / F.greatest(la, lb, F.lit(1))


def pair_features(pairs: DataFrame, attrs_a: DataFrame, attrs_b: DataFrame, p: MatchParams = MatchParams(), fuzzy: bool = True) -> DataFrame:  # noqa: B008
    """s1_id, cand_id, total and FEATURES. Edit distances are 0 below the gate; token sets are compared whole, only counts are capped."""
    side = lambda df, c, s: df.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{s}") for x in ("nn", "an", "nt", "at", "nums", "pin")))
    # windows and join of a side in turn, so that pairs are dealt twice only
    x = _by_candidate(_by_s1(pairs).join(side(attrs_a, "s1_id", "a"), "s1_id")).join(side(attrs_b, "cand_id", "b"), "cand_id")
    t, one = F.col("total"), lambda c: c.cast("double")
    equal_numbers = F.aggregate("nums_a", F.lit(0), lambda s, u: s + F.size(F.filter("nums_b", lambda v: v == u)))
    first = F.try_element_at("nums_a", F.lit(1)) == F.try_element_at("nums_b", F.lit(1))
    capped = lambda c, cap: F.least(F.size(c), F.lit(cap))
    gate = t >= p.gate
    columns = {
        "sc_total": t, "sc_name": F.col("g0"), "sc_join": F.col("g1"), "sc_fuzzy": F.col("g2"), "sc_addr": F.col("g3"), "agree": F.least((F.col("g0") + F.col("g1") + F.col("g2")) * 0.5, F.col("g3")),
        "rank": F.col("rank"), "n_cands": F.col("n_cands"), "rank_frac": (F.col("rank") + 1) / F.col("n_cands"), "sc_rel_best": t / F.greatest(F.col("best"), F.lit(1e-6)), "sc_margin_best": t - F.col("best"),
        "row_n_high": F.col("row_n_high"), "row_n_med": F.col("row_n_med"), **_overlap("n", "nt_a", "nt_b"), **_overlap("a", "at_a", "at_b"),
        "num_match": equal_numbers, "num_first": F.coalesce(first, F.lit(False)), "pin_eq": (F.col("pin_a") == F.col("pin_b")) & (F.col("pin_a") != 0), "pin_both": (F.col("pin_a") != 0) & (F.col("pin_b") != 0),
        "name_eq": F.col("nn_a") == F.col("nn_b"), "addr_eq": F.col("an_a") == F.col("an_b"), "nlen_ratio": _length_gap("nn_a", "nn_b"), "alen_ratio": _length_gap("an_a", "an_b"),
        "ntok_a": capped("nt_a", p.cap_name), "ntok_b": capped("nt_b", p.cap_name), "ntok_diff": F.abs(capped("nt_a", p.cap_name) - capped("nt_b", p.cap_name)), "atok_a": capped("at_a", p.cap_addr), "atok_b": capped("at_b", p.cap_addr),
        "has_addr_a": F.size("at_a") > 0, "has_addr_b": F.size("at_b") > 0, "cand_is_s3": F.col("cand_id").startswith("S3-"), "cand_freq": F.log1p("claims"), "cand_best": F.col("cand_best"),
        "cand_mean": F.col("cand_sum") / F.col("claims"), "cand_comp": t - F.col("cand_next"),
        "f_lev_name": F.when(gate, lev_sim(F.col("nn_a"), F.col("nn_b"))).otherwise(0.0), "f_lev_addr": F.when(gate, lev_sim(F.col("an_a"), F.col("an_b"))).otherwise(0.0),
        # the Python function gets nulls below the gate
        "f_tokset_name": token_set_sim(F.when(gate, F.col("nn_a")), F.when(gate, F.col("nn_b"))) if fuzzy else F.lit(0.0),
    }
    return x.select("s1_id", "cand_id", *([] if "total" in FEATURES else ["total"]), *(one(columns[f]).alias(f) for f in FEATURES))


def with_vector_cosine(pairs: DataFrame, vectors_a: DataFrame, vectors_b: DataFrame, name: str) -> DataFrame:
    """pairs with the cosine of two given vector columns (id, vector); 0 where a side has none."""
    a = vectors_a.select(F.col("id").alias("s1_id"), F.col("vector").alias("_va"))
    b = vectors_b.select(F.col("id").alias("cand_id"), F.col("vector").alias("_vb"))
    x = pairs.join(a, "s1_id", "left").join(b, "cand_id", "left")
    return x.withColumn(name, F.coalesce(cosine(F.col("_va"), F.col("_vb")), F.lit(0.0))).drop("_va", "_vb")


def labels(pairs: DataFrame, truth: scoring.Truth) -> DataFrame:
    return scoring.flagged(pairs, truth).withColumnRenamed("hit", "y")


def unresolved(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Ids of pairs that no record has: must be empty."""
    a = pairs.select(F.col("s1_id").alias("id")).distinct().join(s1.select("id"), "id", "left_anti")
    return a.unionByName(pairs.select(F.col("cand_id").alias("id")).distinct().join(targets.select("id"), "id", "left_anti"))


def char_tfidf(records: DataFrame, text_col: str, n: int = 3, vocab: int = 100_000) -> DataFrame:
    """id, vector (map of gram to weight, unit length): character n-gram TF-IDF with log-scaled counts and smoothed idf over the commonest grams.

    The reduced dense vectors of the optional column are those of this matrix; ``char_cosine`` compares the unreduced ones."""
    s = F.concat(F.lit(" "), X.normalize(F.col(text_col), True), F.lit(" "))
    texts, s = records.select("id", s.alias("s")), F.col("s")
    grams = texts.select("id", F.explode(F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n))))).alias("gram"))
    tf = grams.groupBy("id", "gram").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).orderBy(F.col("df").desc(), "gram").limit(vocab)
    count = records.agg(F.count(F.lit(1)).alias("n_docs"))
    w = tf.join(df, "gram").join(F.broadcast(count)).select("id", "gram", (F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return w.select("id", "gram", (F.col("w") / norm).alias("w"))


def char_cosine(pairs: DataFrame, grams_a: DataFrame, grams_b: DataFrame) -> DataFrame:
    """pairs with c_tfidf, the cosine of the sides' gram weights (char_tfidf), by a join on the pairs' own grams."""
    a = pairs.select("s1_id", "cand_id").join(grams_a.select(F.col("id").alias("s1_id"), "gram", F.col("w").alias("wa")), "s1_id")
    dot = a.join(grams_b.select(F.col("id").alias("cand_id"), "gram", F.col("w").alias("wb")), ["cand_id", "gram"]).groupBy("s1_id", "cand_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("c_tfidf"))
    return pairs.join(dot, ["s1_id", "cand_id"], "left").withColumn("c_tfidf", F.coalesce("c_tfidf", F.lit(0.0)))
