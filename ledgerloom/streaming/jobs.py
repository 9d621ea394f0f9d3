"""Streaming forms of the batch functions (STR1-STR6).

Sources are file streams. Sinks take micro-batches by batch id and replace what an earlier attempt of the same batch wrote, which
with the checkpoint makes results exactly-once. Learning never feeds back inside a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.suppliers import KEEP, PROMOTE_AT
from ledgerloom.sources.scratch import stored
from ledgerloom.sources.sinks import merge_by_key


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """STR1: new Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_batches(stream: DataFrame, batch: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """STR1, STR2: the batch function over each micro-batch, written under the batch's own partition."""

    def write(df: DataFrame, batch_id: int) -> None:
        batch(df).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserts(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 64) -> StreamingQuery:
    """STR2, SNK5: each micro-batch merged into a table with one row a key, whatever batch a key comes in; see merge_by_key()."""

    def write(df: DataFrame, batch_id: int) -> None:
        merge_by_key(df, target, keys, order, batch_id, buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _with_state(stream: DataFrame, step: Callable[[DataFrame, DataFrame, int], DataFrame], result: Callable[[DataFrame, int], DataFrame], schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """STR4: keyed state as a table of its own for each micro-batch, which its batch functions read and write: step(rows, state, batch) is the state after a batch, result(state, batch)
    what the batch writes. A batch begins with the state of the one before it, so a batch that is killed and run again ends as it would have. The state before that one is removed."""
    def write(df: DataFrame, batch: int) -> None:
        spark, at = df.sparkSession, lambda n: f"{checkpoint}/keyed/state-{n}"
        before = spark.read.schema(schema).parquet(at(batch - 1)) if batch else spark.createDataFrame([], schema)
        step(df, before, batch).write.mode("overwrite").parquet(at(batch))
        result(spark.read.schema(schema).parquet(at(batch)), batch).write.mode("overwrite").parquet(f"{target}/batch={batch}")
        if batch > 1:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at(batch - 2))
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def promoted_patterns(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """AGG13, STR4: evidence (supplier_key, pattern, doc_id) counted across micro-batches by keyed state; a pattern is written once, when its
    PROMOTE_AT-th document is seen. State is at most PROMOTE_AT document ids a pattern."""
    keys = ["supplier_key", "pattern"]
    once = stream.dropna(subset=[*keys, "doc_id"]).select(F.col("supplier_key").cast("string").alias("supplier_key"), "pattern", F.col("doc_id").cast("long").alias("doc_id"))

    def step(rows: DataFrame, state: DataFrame, batch: int) -> DataFrame:
        first = rows.repartition(*keys).dropDuplicates([*keys, "doc_id"]).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id")))
        new = first.where(F.col("n") <= PROMOTE_AT).groupBy(*keys).agg(F.collect_list("doc_id").alias("new"))
        none = F.array().cast("array<long>")
        docs = F.slice(F.array_sort(F.array_union(F.coalesce("docs", none), F.coalesce("new", none))), 1, PROMOTE_AT)
        at = new.join(state, keys, "full").select(*keys, docs.alias("docs"), "promoted_in")
        return at.withColumn("promoted_in", F.coalesce("promoted_in", F.when(F.size("docs") >= PROMOTE_AT, F.lit(batch).cast("long"))))

    def result(state: DataFrame, batch: int) -> DataFrame:
        return state.where(F.col("promoted_in") == batch).select(*keys, F.size("docs").cast("long").alias("documents"))

    return _with_state(once, step, result, "supplier_key string, pattern string, docs array<long>, promoted_in long", target, checkpoint)


#: A row a pattern with its counts (kind SEEN) or its place (KEPT), and a row a supplier with the number of its changes (CHANGES). batch is the batch of the last change.
_STATE = "kind string, supplier_key string, pattern string, documents long, last long, promoted_by long, place int, changes long, raised timestamp, batch long"


def profiles(stream: DataFrame, target: str, checkpoint: str, promote_at: int = PROMOTE_AT, keep: int = KEEP, start: float = 0.4, step: float = 0.05, ttl_ms: int | None = None) -> StreamingQuery:
    """AGG13, STR4: evidence (supplier_key, pattern, doc_id, pos) into profiles: a row for each pattern in the order of its promotion, the first keep of them, and a row with the
    number of changes and the confidence for each micro-batch that raises it. As the batch forms promoted_patterns() and raised_confidence(), for documents that come in the order
    of their ids; the rows of a document come in one micro-batch. Counts that nothing raises for ttl_ms are forgotten."""
    keys, own = ["supplier_key", "pattern"], [c.split()[0] for c in _STATE.split(", ")]
    once = stream.dropna(subset=[*keys, "doc_id"]).select(F.col("supplier_key").cast("string").alias("supplier_key"), "pattern", F.col("doc_id").cast("long").alias("doc_id"), F.col("pos").cast("int").alias("pos"))

    def shaped(df: DataFrame, kind: str, batch: int) -> DataFrame:
        at = df.withColumn("kind", F.lit(kind)).withColumn("raised", F.current_timestamp()).withColumn("batch", F.lit(batch).cast("long"))
        kinds = dict(c.split() for c in _STATE.split(", "))
        return at.select(*[(F.col(c) if c in at.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in own])

    def after(rows: DataFrame, state: DataFrame, batch: int) -> DataFrame:
        if ttl_ms:
            fresh = F.unix_millis("raised") > F.unix_millis(F.current_timestamp()) - ttl_ms
            state = state.where((F.col("kind") != "SEEN") | fresh)
        per_pattern = state.where("kind <> 'CHANGES'").select(*keys, (F.col("kind") == "KEPT").alias("kept"), F.col("documents").alias("n0"), "last")
        full = state.where("kind = 'KEPT'").groupBy("supplier_key").agg(F.count(F.lit(1)).alias("full"))
        at = rows.repartition("supplier_key").groupBy(*keys, "doc_id").agg(F.min("pos").alias("pos"))
        # a kept pattern counts no more, nor does a document twice
        at = at.join(per_pattern, keys, "left").where(~F.coalesce("kept", F.lit(False)) & ~F.coalesce(F.col("last") == F.col("doc_id"), F.lit(False)))
        at = at.withColumn("n", F.coalesce("n0", F.lit(0)) + F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id")))
        most = F.max("n").over(Window.partitionBy(*keys))
        at = at.withColumn("most", most).join(full, "supplier_key", "left")
        # one promotion a pattern: the row that reaches promote_at; places go by its document
        order = Window.partitionBy("supplier_key").orderBy(F.when(F.col("n") == promote_at, 0).otherwise(1), "doc_id", F.asc_nulls_last("pos"), "pattern")
        place = F.coalesce("full", F.lit(0)) + F.row_number().over(order)
        at = at.withColumn("place", F.when((F.col("n") == promote_at) & (place <= keep), place))
        at = at.withColumn("now", F.max("place").over(Window.partitionBy(*keys)))
        at = stored(at.where((F.col("n") == F.col("most")) | (F.col("n") >= promote_at)).select(*keys, "doc_id", "n", "most", "place", "now"), "evidence")
        kept = at.where("place is not null").select(*keys, F.col("n").alias("documents"), F.col("doc_id").alias("promoted_by"), "place")
        seen = at.where("now is null and n = most").select(*keys, F.col("n").alias("documents"), F.col("doc_id").alias("last"))
        raising = at.where((F.col("n") == promote_at) | ((F.col("n") > promote_at) & F.col("now").isNull()))
        more = raising.groupBy("supplier_key").agg(F.countDistinct("doc_id").alias("more"))
        were = state.where("kind = 'CHANGES'").select("supplier_key", F.col("changes").alias("were"))
        changed = more.join(were, "supplier_key", "left").select("supplier_key", (F.col("more") + F.coalesce("were", F.lit(0))).alias("changes"))
        touched = shaped(kept, "KEPT", batch).unionByName(shaped(seen, "SEEN", batch)).unionByName(shaped(changed, "CHANGES", batch))
        new = touched.select("supplier_key", F.coalesce("pattern", F.lit("")).alias("p"), (F.col("kind") == "CHANGES").alias("c"))
        old = state.withColumn("p", F.coalesce("pattern", F.lit(""))).withColumn("c", F.col("kind") == "CHANGES")
        return old.join(new, ["supplier_key", "p", "c"], "left_anti").select(*own).unionByName(touched)

    def result(state: DataFrame, batch: int) -> DataFrame:
        confidence = F.when(F.col("kind") == "CHANGES", F.round(F.least(F.lit(1.0), start + step * F.col("changes")), 9))
        at = state.where((F.col("batch") == batch) & (F.col("kind") != "SEEN"))
        return at.select(*keys, "documents", "promoted_by", "place", "changes", confidence.alias("confidence"))

    return _with_state(once, after, result, _STATE, target, checkpoint)


def with_dimension(stream: DataFrame, load: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """STR5: the dimension is loaded anew for each micro-batch, so edits between batches take effect."""
    return run_batches(stream, lambda df: apply(df, load()), target, checkpoint)


def audit_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Additional to the reference: hourly event counts by type, late events dropped after delay."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Additional to the reference: sessions of an actor."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def finished(query: StreamingQuery, seconds: int | None = None) -> bool:
    """STR6: waits for a bounded query, however long it takes where no time is given."""
    return query.awaitTermination(seconds) if seconds is not None else query.awaitTermination() is None


__all__ = ["KEEP", "PROMOTE_AT", "audit_counts", "file_stream", "finished", "profiles", "promoted_patterns", "run_batches", "sessions", "upserts", "with_dimension"]
