"""Written intermediate tables: the way lineage is cut in this package.

Every table goes below ``spark.checkpoint.dir``, the folder that driver and executors share, so that a
lost executor costs a reread and not a recomputation. Only in local mode, where one machine is all there is, is a temporary
one made if the session names no such folder; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh(name: str, columns: Iterable[str]) -> str:
    """name, with as many underscores before it as no column of these has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own(docs: DataFrame) -> list[Column]:
    """All columns of docs, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


#: Rows of an Arrow batch: whole documents of some kilobytes each, in two Python workers of an executor
BATCH_ROWS = 1000


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema), with batches small enough that idle workers hold little memory. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


class Scratch:
    """Tables of one run of an operator; ``drop`` frees those that later steps no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/tallyweave-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def numbered(self, docs: DataFrame, name: str = "_row") -> DataFrame:
        """docs with a number that each row has in every job, however many cores there are then.

        Rows of Parquet files are known by their file and their place in it, which no split of the files changes, so nothing is copied.
        Rows of any other plan are written with their number, and all jobs read that copy.
        """
        if (placed := _placed(docs)) is not None:
            files = docs.select(F.col("_metadata.file_path").alias("_file")).distinct()
            files = self.put(f"files{name}", files.select("_file", F.row_number().over(Window.orderBy("_file")).cast("long").alias("_number")))  # a row for each file
            files = F.broadcast(files) if files.count() <= FILES_SENT else files
            row = F.col("_number") * F.lit(1 << INDEX_BITS) + F.col("_index")
            return placed.join(files, "_file").select(*own(docs), row.alias(name))
        copy = self.numbered_once(docs, name)
        copy.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.base}/rows{name}")
        return self.spark.read.schema(copy.schema).parquet(f"{self.base}/rows{name}")

    @staticmethod
    def numbered_once(docs: DataFrame, name: str = "_row") -> DataFrame:
        """docs with a number for a single job, whose written result is all that later jobs read."""
        return docs.withColumn(name, F.monotonically_increasing_id())


#: Rows of one file take this many bits of a row's number, files the rest
INDEX_BITS = 36
#: Files whose names (about 100 bytes each) are sent to all executors
FILES_SENT = 100_000


def _nodes(plan) -> Iterator[str]:
    yield plan.nodeName()
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _placed(docs: DataFrame) -> DataFrame | None:
    """docs with _file and _index, if each of its rows is one row of a file."""
    if {"_metadata", "_file", "_index", "_number"} & {c.lower() for c in docs.columns}:
        return None
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic() or not set(_nodes(plan)) <= {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}:
        return None
    try:
        return docs.select(*own(docs), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException:
        return None
