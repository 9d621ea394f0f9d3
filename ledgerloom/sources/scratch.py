"""A folder for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which executors share; where it is unset, a local one (tests)."""
    conf = spark.sparkContext.getConf()
    if conf.contains("spark.checkpoint.dir"):
        base = conf.get("spark.checkpoint.dir").rstrip("/")
    elif conf.get("spark.master", "").startswith("local"):
        base = "file://" + tempfile.gettempdir()
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again, for plans that read it several times."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def apart(df: DataFrame) -> DataFrame:
    """df as it is, with a bound that filters do not pass: what stands above a distinct() is computed once a distinct row, not once a row below it."""
    return df.withColumn("__at", F.monotonically_increasing_id()).where("__at >= 0").select(*[F.col(c) for c in df.columns])
