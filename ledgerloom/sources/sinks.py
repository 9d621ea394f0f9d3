"""Sinks. Writes are idempotent: a table partition or key is replaced whole, so a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import nonzero


def stored_lines(lines: DataFrame) -> DataFrame:
    """SNK1: decimals as doubles, zero as null."""
    kinds = dict(lines.dtypes)
    return lines.select(*[nonzero(c).cast("double").alias(c) if kinds[c].startswith("decimal") else F.col(c) for c in lines.columns])


def nested_results(verdicts: DataFrame, results: DataFrame) -> DataFrame:
    """SNK2: one row a job with its line verdicts in order."""
    per = verdicts.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "ref_produit", "verdict", "confidence", "match_layer", "notes"))).alias("line_verdicts"))
    return results.join(per, "job_id", "left")


def audit_event(job_id: Column, event_type: str, actor: Column, created_at: Column, **payload: Column) -> Column:
    """SNK3: an event row; the payload becomes JSON."""
    return F.struct(job_id.alias("job_id"), F.lit(event_type).alias("event_type"), F.to_json(F.struct(*[v.alias(k) for k, v in payload.items()])).alias("event_data"), actor.alias("actor"), created_at.alias("created_at"))


def append_events(events: DataFrame, path: str) -> None:
    """SNK3: appended, never changed."""
    events.write.mode("append").partitionBy("event_type").parquet(path)


def replace_keys(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after replacing all rows of the keys that new has."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def job_status(has_unknown_page: Column, extracted: Column, verdict: Column, has_order: Column) -> Column:
    """SNK4: the status that the stages reached so far imply."""
    return (
        F.when(verdict.isNotNull(), F.when(verdict.isin("REVIEW", "INCOMPLETE"), "REVIEW_REQUIRED").otherwise("COMPLETED"))
        .when(has_order == F.lit(False), "FAILED").when(extracted, "MATCHING").when(has_unknown_page.isNotNull(), "EXTRACTING").otherwise("PROCESSING")
    )


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """bucket, version of the last complete batch; None before the first."""
    try:
        every = spark.read.schema("bucket int, version long, batch long").parquet(f"{path}/manifest")
        last = every.agg(F.max("batch")).first()[0]
    except AnalysisException:
        return None
    return None if last is None else every.where(F.col("batch") == last)


def current_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a table of merge_by_key() holds: of every bucket the version that the last complete batch names."""
    known = _manifest(spark, path)
    if known is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, version long, bucket int").parquet(f"{path}/rows")
    # a row a bucket, whose number is fixed
    return rows.join(F.broadcast(known.select("bucket", "version")), ["bucket", "version"], "left_semi").drop("bucket", "version")


def merge_by_key(new: DataFrame, path: str, keys: list[str], order: list[str], batch: int, buckets: int = 64) -> None:
    """STR2, SNK5: a batch merged into a table with one row a key: that with the greatest order, of equal ones the one of the later batch.

    Rows lie in a fixed number of buckets of the keys. A batch reads and writes only the buckets of its keys, each as a new version, and then names the version of every bucket in one manifest
    file. Readers follow the last manifest, so a batch that is killed anywhere leaves the table as it was, and may be run again; one that is complete changes
    nothing when it is repeated. Old versions stay until they are removed by age."""
    spark = new.sparkSession
    known = _manifest(spark, path)
    if known is not None and known.first()["batch"] >= batch:
        return
    schema = ", ".join(f"`{n}` {t}" for n, t in new.dtypes)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = new.select(bucket.alias("bucket")).distinct()
    rows = new.withColumn("__new", F.lit(1)).withColumn("bucket", bucket)
    if known is not None:
        old = spark.read.schema(f"{schema}, version long, bucket int").parquet(f"{path}/rows").join(F.broadcast(known.select("bucket", "version")), ["bucket", "version"], "left_semi")
        old = old.join(F.broadcast(touched), "bucket", "left_semi").drop("version").withColumn("__new", F.lit(0))
        rows = rows.unionByName(old)
    best = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*new.columns), F.struct(*order, "__new")).alias("r")).select("r.*", "bucket", F.lit(batch).cast("long").alias("version"))
    best.repartition("bucket").write.mode("overwrite").partitionBy("version", "bucket").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/rows")
    names = touched.select("bucket", F.lit(batch).cast("long").alias("version"))
    if known is not None:
        names = names.unionByName(known.select("bucket", "version").join(touched, "bucket", "left_anti"))
    names.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")
