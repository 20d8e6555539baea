"""Tables written between the steps of a plan: what is read more than once is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without a setting, only local mode has one: a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df, read back from a table of its own below the shared folder, with a folder for each value of the columns by."""
    at = f"{shared_dir(df.sparkSession)}/tallyweave-{uuid.uuid4().hex}/{name}"
    df.write.partitionBy(*by).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
