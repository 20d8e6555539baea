"""Rules for result files: one row for each broken rule, with a count and the first offending ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tsv import CANDIDATE_HEADER, MATCH_HEADER

EXAMPLES = 5
SCHEMA = "rule string, severity string, n long, examples array<string>"


def _found(bad: DataFrame, rule: str, severity: str = "error") -> DataFrame:
    """bad: one string column. Count and the first five in order; no row if there are none."""
    c = bad.columns[0]
    bad = bad.select(F.col(c).alias("x"))
    first = bad.orderBy("x").limit(EXAMPLES).agg(F.array_sort(F.collect_list("x")).alias("examples"))
    return bad.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(first)).where("n > 0").select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")


def list_rows_report(lines: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rules on rows (value: a line after the header). required: id; known: id of records that may be listed."""
    blank = F.trim("value") == ""
    rows = lines.where(~blank)
    untabbed = rows.where(F.instr("value", "\t") == 0).select("value")
    parts = F.split("value", "\t")
    rows = rows.where(F.instr("value", "\t") > 0).select(parts[0].alias("s1_id"), F.filter(F.transform(F.split(F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != "").alias("ids"))
    listed = rows.select(F.explode("ids").alias("id")).distinct()
    ids = rows.select("s1_id").distinct()
    found = [
        _found(untabbed, "row without tab"),
        _found(rows.groupBy("s1_id").count().where("count > 1").select("s1_id"), "repeated row"),
        _found(rows.where(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1_id"), "repeated id in a list"),
        _found(listed.where(F.col("id").startswith("S1-")).select("id"), "S1 id in a list"),
        _found(listed.where(~F.col("id").rlike("^S[123]-")).select("id"), "unknown prefix"),
        _found(required.select("id").distinct().join(ids, F.col("id") == F.col("s1_id"), "left_anti").select("id"), "missing row"),
        _found(ids.join(required.select("id").distinct(), F.col("id") == F.col("s1_id"), "left_anti").select("s1_id"), "row of an unknown S1 id"),
    ]
    if known is not None:
        found.append(_found(listed.where(F.col("id").rlike("^S[23]-")).join(known, "id", "left_anti").select("id"), "unknown id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def unmatched_candidates(matches: DataFrame, cands: DataFrame) -> DataFrame:
    """A warning with the S1 ids that have a match which is no candidate."""
    return _found(matches.join(cands, ["s1_id", "cand_id"], "left_anti").select("s1_id").distinct(), "match that is no candidate", "warning")


def list_counts(lines: DataFrame) -> DataFrame:
    rows = lines.where(F.instr("value", "\t") > 0)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.trim(F.try_element_at(F.split("value", "\t"), F.lit(2))) == "").alias("empty"))


def header_error(line: str | None, header: tuple[str, str]) -> str | None:
    if not line:
        return "empty file"
    if "\t" not in line:
        return "the header has commas and no tab" if "," in line else "the header has no tab"
    return None if tuple(x.strip().lower() for x in line.split("\t")) == header else "unknown header"


def validate_file(spark: SparkSession, path: str, header: tuple[str, str], required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All rules on one file; what stops reading (no file, a wrong header) is the only row then. Part files may each have the header."""
    stop = lambda rule: spark.createDataFrame([(rule, "error", 1, [path])], SCHEMA)
    try:
        lines = spark.read.text(path)
        first = lines.first()
    except Exception as e:  # the path may not exist
        return stop(f"unreadable: {type(e).__name__}")
    if not lines.where(~F.is_valid_utf8("value")).isEmpty():
        return stop("not UTF-8")
    if why := header_error(first.value if first else None, header):
        return stop(why)
    return list_rows_report(lines.where(F.col("value") != F.lit(first.value)), required, known)


def validate(spark: SparkSession, matches_path: str, candidates_path: str | None, required: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The report on both files, and an exit code (1 with any error)."""
    out = validate_file(spark, matches_path, MATCH_HEADER, required, known)
    if known is None:
        out = out.unionByName(spark.createDataFrame([("ids are not checked", "warning", 1, [])], SCHEMA))
    if candidates_path is None:
        out = out.unionByName(spark.createDataFrame([("no candidate file", "warning", 1, [])], SCHEMA))
    else:
        out = out.unionByName(validate_file(spark, candidates_path, CANDIDATE_HEADER, required, known))
        from ..sources.tsv import read_lists

        pairs = lambda p: read_lists(spark, p).select("s1_id", F.explode(F.split("items", ",")).alias("cand_id")).where("cand_id <> ''")
        if out.where("rule like 'unreadable%' or rule = 'not UTF-8'").isEmpty():
            out = out.unionByName(unmatched_candidates(pairs(matches_path), pairs(candidates_path)))
    out = out.persist()
    return out, int(not out.where("severity = 'error'").isEmpty())
