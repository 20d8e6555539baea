"""A stand-in for entity records: names and addresses cut from documents. It shows that operators are right, not that entities are found."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, scoring
from ..params import BlockParams
from ..store import written


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, name, addr, country."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # twelve words are used; a split into more parts (the first can be empty, the last is the rest) would be thrown away
    w = docs.selectExpr("doc_id", "lang", r"filter(slice(split(lower(text), '[^\\p{L}\\p{N}]+', 14), 1, 13), x -> x <> '') AS w")
    return w.selectExpr("concat('S', 1 + doc_id % 3, '-', doc_id) AS id", "1 + doc_id % 3 AS src", "array_join(slice(w, 1, 4), ' ') AS name", "array_join(slice(w, 5, 8), ' ') AS addr", "lang AS country")


def _sides(er: DataFrame) -> tuple[DataFrame, DataFrame]:
    return er.where("src = 1"), er.where("src <> 1")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _sides(entities(spark, sf_dir))


class Run:
    """What one query reads more than once, written once: records of both sides, candidates and the groups of the truth."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: BlockParams = BlockParams()):  # noqa: B008
        # the records are few bytes, their tokens much work: a task for each core
        er = entities(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
        self.a, self.b = _sides(written(er, "entities"))
        self.params = params

    @cached_property
    def scores(self) -> DataFrame:
        """All pairs, with scores of four decimals."""
        return blocking.scored_pairs(self.a, self.b, self.params, 4)

    @cached_property
    def cands(self) -> DataFrame:
        return written(blocking.block(self.a, self.b, self.params), "candidates")

    @cached_property
    def truth(self) -> scoring.Groups:
        """Same country, name and address, in groups with records of both sides."""
        same = ["country", "name", "addr"]
        a = self.a.where("addr <> ''")
        groups = self.b.groupBy(*same).agg(F.count(F.lit(1)).alias("n_true")).join(a.select(*same).distinct(), same)
        groups = written(groups.withColumn("grp", F.monotonically_increasing_id()), "groups")
        s1 = a.join(groups, same).select(F.col("id").alias("s1_id"), "grp", "n_true")
        return scoring.Groups(written(s1, "grouped_s1"), written(self.b.join(groups, same).select(F.col("id").alias("cand_id"), "grp"), "grouped_targets"))

    @property
    def ids(self) -> DataFrame:
        return self.a.select(F.col("id").alias("s1_id"), "country")

    @property
    def gts(self) -> DataFrame:
        return scoring.gt_counts(self.ids.select("s1_id"), self.truth)
