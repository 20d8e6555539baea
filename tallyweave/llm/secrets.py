"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by Java patterns inside Spark expressions. One pattern call gives the gaps and the matches of a text in turn, so that
offsets are running sums of their lengths. Base kinds (assign, access, hex) always stay. Further kinds (bearer, url, mixed) are candidates only:
each distinct value is hashed, hashes are aggregated over the whole corpus by distinct repository and owner, and a value becomes a
span if it belongs to few of them (``own`` repositories and owners at most). Values found more widely are copied examples. A table without a repository column has
each different text for a repository: copies of one document count once, and a value in many texts of one owner is still an example. The same figures
split base spans into ``n_live`` and ``n_example``.

A hot value (an example in a third of all documents) is reduced to distinct (value, repository, owner) before the shuffle, and the join back
is an ordinary skewed join. Defined results: a null text is empty; offsets are code points, ends exclusive; a null repository or owner is
one of its own; repeated rows are separate documents with equal results; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

# Kind, pattern, group of the value, least length of the value.
BASE = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
]
MORE = [
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,}=*)", 1, 20),
    ("url", r"[a-z][a-z0-9+]{1,15}://[^\s:/@]++:([^\s:/@]{6,}+)@", 1, 6),
    ("mixed", r"(?<![A-Za-z0-9+/_-])(?=[a-z+/_-]*+[A-Za-z0-9])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])([A-Za-z0-9+/_-]{24,}+={0,2})", 1, 24),
]
ORDER = [k for k, *_ in BASE + MORE]
EMPTY = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"


def found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, value>> of the leftmost non-overlapping matches whose value is long enough."""
    both = F.lit(rf"(?s)(.*?)({pattern}|\z)")  # the end of the text is the last match, or each place behind it would be tried up to there
    part = lambda g: F.regexp_extract_all(text, both, F.lit(g))
    zipped = F.arrays_zip(part(1).alias("gap"), part(2).alias("all"), part(2 + group).alias("value"))
    item = "struct<start:int,kind:int,end:int,value:string>"
    start = F.struct(F.lit(0).alias("at"), F.expr(EMPTY).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["all"])
        one = F.struct(a.alias("start"), F.lit(ORDER.index(kind)).alias("kind"), b.alias("end"), x["value"].alias("value")).cast(item)
        return F.struct(b.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    named = F.transform(zipped, lambda z: F.struct(z["gap"].alias("gap"), z["all"].alias("all"), z["value"].alias("value")))
    return F.when(text.rlike(pattern), F.aggregate(named, start, step, lambda acc: acc["out"])).otherwise(F.expr(EMPTY))


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str | None, owner_col: str | None) -> DataFrame:
    """_row, _id, _repo, _owner, base and more (sorted by start and kind; more does not overlap base)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    by = lambda c: F.to_json(F.struct(F.col(c).cast("string").alias("v")))
    who = [by(repo_col) if repo_col else F.xxhash64(text).cast("string"), by(owner_col) if owner_col else F.lit("")]
    rows = docs.select("_row", F.col(id_col).alias("_id"), who[0].alias("_repo"), who[1].alias("_owner"), text.alias("_text"))
    every = lambda kinds: F.array_sort(F.concat(*(found(F.col("_text"), *k) for k in kinds)))
    rows = rows.select("_row", "_id", "_repo", "_owner", every(BASE).alias("base"), every(MORE).alias("more"))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return rows.withColumn("more", F.filter("more", apart))


def ownership(values: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners of each distinct value (hash, _repo, _owner)."""
    single = values.select("hash", "_repo", "_owner").distinct()
    repos = single.select("hash", "_repo").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"))
    owners = single.select("hash", "_owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "hash")


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str | None = "source", own: int = 2) -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put("candidates", candidates(scratch.numbered_once(docs), id_col, text_col, repo_col, owner_col))
    some = rows.where(F.size("base") + F.size("more") > 0)
    values = some.select("_row", "_repo", "_owner", F.explode(F.concat("base", "more")).alias("s")).withColumn("hash", F.sha2("s.value", 256)).drop("_text")
    values = scratch.put("values", values)
    known = values.join(ownership(values), "hash").withColumn("live", (F.col("n_repos") <= own) & (F.col("n_owners") <= own))
    extra = F.col("s.kind") >= len(BASE)
    per = known.groupBy("_row").agg(
        F.collect_list(F.when(extra & F.col("live"), F.col("s"))).alias("added"), F.count_if(F.col("live")).alias("n_live"), F.count_if(~F.col("live")).alias("n_example")
    )
    out = rows.join(per, "_row", "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == ORDER.index(k))).cast("long").alias(f"n_{k}")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.expr(EMPTY))))
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("_id").alias(id_col), *(count(k) for k, *_ in BASE), F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(every).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"),
    )
