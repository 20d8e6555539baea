"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document may be taken 0, 1 or 2 times. Its base measure is Binomial(2, 1/2); the constraint of source s is that the
expected tokens of its documents equal the source's target. The dual of this maximum-entropy problem is convex with one
multiplier l_s for each source, and its optimum tilts every document exponentially: expected copies = 2 / (1 + exp(-l_s * z)),
z = the document's size over the source's mean size. Newton steps, kept inside a shrinking bracket, solve the dual; each
step is one aggregation over (source, size) classes, which are as many as there are distinct sizes, and not over documents.
After NEWTON steps the bracket is halved until it is closed, so the dual is solved to its tolerance however Newton's steps fall.

Rounding: documents of a source are ordered by falling size and the running sum of rates is rounded; a document takes the
difference of two neighbouring roundings, so copies are 0, 1 or 2 and a source's total misses its target by half of its
largest document at most. Ranks within a size class come from hash buckets, so that no task holds a whole hot class.

Defined results: a null text has size 0, takes nothing and counts as no words; null is a source of its own, last in
order; a source without words has target 0; repeated rows are separate documents (copies of equal rows are dealt among
them); an empty table gives an empty result. Reruns agree: the order within a class is a hash of id, text and source.
``mixed`` keeps the input's columns, whatever their names. Targets are windows over sources, of which a corpus has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh, own

WORD = r"[^\x20\x09-\x0D]+"
SOURCE_KEYS = ["_null", "_source"]
#: Steps after which only halving is left (a few are usual)
NEWTON = 60
ROWS_A_BUCKET = 20_000
#: Rates are whole multiples of 1 / UNITS, so that their running sums are exact
UNIT_BITS = 20
UNITS = 1 << UNIT_BITS


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """Per source: words, target. Targets above ``most`` times a source's words stop there; the excess goes to the others by weight."""
    per = sizes.groupBy(*SOURCE_KEYS).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    order = Window.orderBy("_null", "_source")  # over sources
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    fill = Window.orderBy("_full", "_null", "_source")
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    per = per.withColumn("_w", w).withColumn("_cap", (F.lit(most) * F.col("source_size")).cast("double"))
    per = per.withColumn("_full", F.col("_cap") / F.col("_w"))  # the level at which a source is full
    per = per.withColumn("_total", F.sum("source_size").over(every) * F.lit(percent) / F.lit(100.0))
    # With the sources before this one full, the level of this one and the rest; the first level that is not above its own
    # source's holds, and those after it are lower still.
    level = (F.col("_total") - (F.sum("_cap").over(upto) - F.col("_cap"))) / (F.sum("_w").over(every) - (F.sum("_w").over(upto) - F.col("_w")))
    per = per.withColumn("_level", level)
    per = per.withColumn("_mu", F.max(F.when(F.col("_level") <= F.col("_full"), F.col("_level"))).over(every))
    target = F.when(F.col("_mu").isNull() | (F.col("_full") <= F.col("_mu")), F.col("_cap")).otherwise(F.col("_mu") * F.col("_w"))
    return per.select(*SOURCE_KEYS, "source_size", "_docs", target.alias("target"))


def _rate(multiplier: str, z: str, most: int) -> Column:
    return F.lit(float(most)) / (F.lit(1.0) + F.exp(-F.col(multiplier) * F.col(z)))


def _exact_sum(x: Column) -> Column:
    """A sum that does not depend on the order of its terms, so that reruns take the same steps."""
    return F.sum(x.cast("decimal(28,8)")).cast("double")


def solve(classes: DataFrame, per: DataFrame, scratch: Scratch, most: int, tolerance: float = 1e-9) -> DataFrame:
    """Newton's method on the dual of each source: _l, within a bracket [_lo, _hi] that every step narrows."""
    data = classes.join(F.broadcast(per) if per.count() <= 10_000 else per, SOURCE_KEYS).where("source_size > 0").select(
        *SOURCE_KEYS, "_size", "_n", (F.col("_size") / (F.col("source_size") / F.col("_docs"))).alias("_z"), (F.col("_size") * F.col("_n")).cast("double").alias("_words"), "target", "source_size"
    )
    data = scratch.put("dual", data)
    state = scratch.put("l0", per.where("source_size > 0").select(*SOURCE_KEYS, "target", "source_size", F.lit(0.0).alias("_l"), F.lit(-1e6).alias("_lo"), F.lit(1e6).alias("_hi"), (F.col("target") >= F.lit(most) * F.col("source_size")).alias("_done")))
    k = 0
    while not state.where("not _done").isEmpty():
        r = _rate("_l", "_z", most)
        step = (
            data.drop("target", "source_size")
            .join(state, SOURCE_KEYS)
            .where("not _done")
            .groupBy(*SOURCE_KEYS)
            .agg(_exact_sum(F.col("_words") * r).alias("_g"), _exact_sum(F.col("_words") * F.col("_z") * r * (1.0 - r / F.lit(float(most)))).alias("_h"))
        )
        off = F.col("_g") - F.col("target")
        lo = F.when(off < 0, F.col("_l")).otherwise(F.col("_lo"))
        hi = F.when(off > 0, F.col("_l")).otherwise(F.col("_hi"))
        newton = F.col("_l") - off / F.col("_h")
        good = F.lit(k < NEWTON) & (F.col("_h") > 0) & (newton > lo) & (newton < hi)
        done = F.col("_done") | F.col("_g").isNull() | (F.abs(off) <= F.lit(tolerance) * F.greatest(F.col("target"), F.lit(1.0))) | (hi - lo < 1e-12)
        state = scratch.put(
            f"l{k + 1}",
            state.join(step, SOURCE_KEYS, "left").select(*SOURCE_KEYS, "target", "source_size", F.when(done, F.col("_l")).when(good, newton).otherwise((lo + hi) / 2).alias("_l"), lo.alias("_lo"), hi.alias("_hi"), done.alias("_done")),
        )
        scratch.drop(f"l{k}")
        k += 1
    return state


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, row_col: str | None = None) -> DataFrame:
    """Per document: id (and row_col if given), size, source_size, target, rate, copies, taken."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keep = [id_col, *([row_col] if row_col else [])]
    sizes = docs.select(
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), n_words(F.col(text_col).cast("string")).alias("_size"), F.xxhash64(F.col(text_col).cast("string")).alias("_text"), F.col(source_col).isNull().alias("_null"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source")
    )
    sizes = scratch.put("sizes", sizes)
    per = scratch.put("per", targets(sizes, weights, percent, most))
    key = [*SOURCE_KEYS, "_size"]
    classes = scratch.put("classes", sizes.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")))
    dual = solve(classes, per, scratch, most)
    by_source = per.join(dual.select(*SOURCE_KEYS, "_l"), SOURCE_KEYS, "left")
    before = Window.partitionBy(*SOURCE_KEYS).orderBy(F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rate = F.when(F.col("_size") == 0, F.lit(0.0)).when(F.col("target") >= F.lit(most) * F.col("source_size"), F.lit(float(most))).otherwise(_rate("_l", "_z", most))
    rated = (
        classes.join(by_source, SOURCE_KEYS)
        .withColumn("_z", F.when(F.col("source_size") > 0, F.col("_size") / (F.col("source_size") / F.col("_docs"))))
        .withColumn("_units", F.round(F.coalesce(rate, F.lit(0.0)) * UNITS).cast("long"))
        .withColumn("_sum", F.coalesce(F.sum(F.col("_units") * F.col("_n")).over(before), F.lit(0).cast("long")))
        .select(*key, "source_size", "target", (F.col("_units") / F.lit(float(UNITS))).alias("rate"), "_units", "_sum", F.ceil(F.col("_n") / ROWS_A_BUCKET).cast("long").alias("_buckets"))
    )
    rated = scratch.put("rated", rated)
    dealt = sizes.join(rated, key).withColumn("_hash", F.xxhash64("_k0", "_text", "_source", F.lit(17)))
    dealt = dealt.withColumn("_bucket", F.pmod(F.col("_hash"), F.col("_buckets")))
    heads = dealt.where("_buckets > 1").groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    offset = F.coalesce(F.sum("_in").over(Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(*key, "_bucket", offset.alias("_skip"))
    rank = F.row_number().over(Window.partitionBy(*key, "_bucket").orderBy("_hash", *(f"_k{i}" for i in range(len(keep)))))
    placed = dealt.join(heads, [*key, "_bucket"], "left").withColumn("_rank", F.coalesce("_skip", F.lit(0)) + rank)
    whole = [F.shiftright(F.col("_sum") + (F.col("_rank") - back) * F.col("_units") + UNITS // 2, UNIT_BITS) for back in (0, 1)]
    times = whole[0] - whole[1]
    return placed.select(
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.col("_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", "rate", times.alias("copies"), (times * F.col("_size")).alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """docs with each row repeated as often as the mix takes it."""
    row = fresh("_row", docs.columns)
    times = fresh("_times", docs.columns)
    rows = Scratch(docs.sparkSession).numbered(docs, row)
    parts = rows.select(F.col(row).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    taken = copies(parts, "_id", "_text", "_source", row_col="_row", **kw).where("copies > 0").select(F.col("_row").alias(row), F.col("copies").alias(times))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(fresh("_copy", docs.columns))
    return rows.join(taken, row).select(*own(docs), each).select(*own(docs))
