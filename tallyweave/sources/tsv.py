"""Tab-separated files: record tables, scored candidate lists, truth lists, and their writers.

Files have a header that is not interpreted, no quoting, and lists as comma-separated text. Reading is by file splits.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ID_HEADER = "source1_entity_id"
CANDIDATE_HEADER = (ID_HEADER, "candidate_entity_ids")
MATCH_HEADER = (ID_HEADER, "matched_entity_ids")


def _tsv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.csv(path, sep="\t", quote="", header=True, enforceSchema=True, schema=schema, mode="PERMISSIVE")


def read_records(spark: SparkSession, path: str | list[str], src: int | None = None) -> DataFrame:
    """id, name, addr, country (and src). Missing fields are empty; rows without an id go."""
    df = _tsv(spark, path, ["id", "name", "addr", "country"])
    df = df.select(F.trim(F.coalesce("id", F.lit(""))).alias("id"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "addr", "country"))).where("id <> ''")
    return df.withColumn("src", F.lit(src)) if src else df


def targets(spark: SparkSession, s2: str, s3: str) -> DataFrame:
    """Records of both sources, repeats included."""
    return read_records(spark, s2, 2).unionByName(read_records(spark, s3, 3))


def read_ids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_records(spark, path).select("id").distinct()


def read_match_targets(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """All ids that may be matched, or None and a warning for each file that can't be read."""
    found, warnings = [], []
    for path in paths:
        try:
            found.append(read_ids(spark, path))
        except Exception as e:  # the path may not exist
            warnings.append(f"{path} can't be read ({type(e).__name__}); ids are not checked")
    if warnings:
        return None, warnings
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct(), []


def countries(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id"), "id", "left_semi").select("id", "country")


def parse_scored(lists: DataFrame) -> DataFrame:
    """s1_id, cand_id, total, g0..g3, rank from rows (s1_id, items); a row without items gives none."""
    item = F.split("item", ":")
    num = lambda i: F.try_element_at(item, F.lit(i)).cast("double")
    rows = lists.where("items <> ''").select("s1_id", F.posexplode(F.split("items", ",")).alias("rank", "item"))
    return rows.select("s1_id", item[0].alias("cand_id"), num(2).alias("total"), *(num(3 + g).alias(f"g{g}") for g in range(4)), "rank")


def read_lists(spark: SparkSession, path: str | list[str]) -> DataFrame:
    df = _tsv(spark, path, ["s1_id", "items"])
    return df.select(F.trim("s1_id").alias("s1_id"), F.coalesce("items", F.lit("")).alias("items")).where("s1_id <> ''")


def read_scored(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_scored(read_lists(spark, path))


def read_truth(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs (s1_id, cand_id), and gt_count of every S1 id (0 for an empty list)."""
    lists = read_lists(spark, path).withColumn("ids", F.array_distinct(F.filter(F.transform(F.split("items", ","), lambda x: F.trim(x)), lambda x: x != "")))
    return lists.select("s1_id", F.explode("ids").alias("cand_id")), lists.select("s1_id", F.size("ids").alias("gt_count"))


def sample_names(records: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n records without replacement, the same ones for a seed."""
    return records.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def list_rows(s1: DataFrame, pairs: DataFrame, order: list[Column], item: Column | None = None) -> DataFrame:
    """One row for every S1 id: s1_id, items (comma-separated, in the given order; empty without a pair)."""
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(*order))
    listed = pairs.select("s1_id", rank.alias("r"), (item if item is not None else F.col("cand_id")).alias("i"))
    lists = listed.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "i"))), lambda x: x["i"]), ",").alias("items"))
    return s1.select(F.col("id").alias("s1_id")).join(lists, "s1_id", "left").select("s1_id", F.coalesce("items", F.lit("")).alias("items"))


def scored_item() -> Column:
    return F.concat_ws(":", "cand_id", *(F.format_string("%.4f", F.col(c)) for c in ("total", "g0", "g1", "g2", "g3")))


def candidate_lists(s1: DataFrame, cands: DataFrame, scores: bool = False) -> DataFrame:
    return list_rows(s1, cands, [F.col("total").desc(), F.col("cand_id")], scored_item() if scores else None)


def write_lists(rows: DataFrame, path: str, header: tuple[str, str]) -> None:
    """A folder of part files, each with the header; rows as they are partitioned."""
    line = rows.select(F.col("s1_id").alias(header[0]), F.col("items").alias(header[1]))
    line.write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", True).option("emptyValue", "").csv(path)


def write_block_outputs(s1: DataFrame, cands: DataFrame, tau: float, out_dir: str) -> None:
    """Candidates, scored candidates and matches by score, from one cached table."""
    cands = cands.persist()
    write_lists(candidate_lists(s1, cands), f"{out_dir}/candidate_pairs", CANDIDATE_HEADER)
    write_lists(candidate_lists(s1, cands, True), f"{out_dir}/candidates_scored", CANDIDATE_HEADER)
    write_lists(candidate_lists(s1, cands.where(F.col("total") >= tau)), f"{out_dir}/matching_results", MATCH_HEADER)
    cands.unpersist()


def write_store(records: DataFrame, path: str) -> None:
    """Records by key, as Parquet."""
    from ..functions.hashing import id_key

    records.withColumn("key", id_key(F.col("id"))).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(store: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (id) with the fields of their records; nulls and no key where the store has none."""
    return ids.select("id").join(store, "id", "left")


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """A small JSON document through Spark's writer, so that any store works."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)
