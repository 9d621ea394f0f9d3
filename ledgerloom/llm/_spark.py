"""Shared Spark helpers: stored intermediates, bounded broadcasts and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side with at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
BATCH_ROWS = 1_000
#: A node with more rows than this is salted where its rows meet; so many salted nodes are broadcast at most.
HUB = 256
HUBS = 2_000_000
#: Pairs of nodes in a file of intermediate pairs, about.
PAIRS = 5_000


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediates: spark.checkpoint.dir, or, where it is unset, a local one (tests)."""
    conf = spark.sparkContext.getConf()
    if conf.contains("spark.checkpoint.dir"):
        return conf.get("spark.checkpoint.dir").rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_ledgerloom_scratch", None)
    if own is None:
        own = spark._ledgerloom_scratch = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return own


def lean(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from here on in this session: texts are large, and the JVM and the Python
    worker each hold a batch or two per task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there, so lost executors cost
    only the reads in flight. The folder is the cluster's to empty, as for checkpoints."""
    lean(df.sparkSession)
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_counted(df: DataFrame, name: str, **aggregates) -> tuple[DataFrame, dict]:
    """As store(), with aggregates observed during the write."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = store(df.observe(seen, *[c.alias(k) for k, c in aggregates.items()]), name)
    return out, seen.get


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the known number of rows is within the limit, otherwise df as it is."""
    return F.broadcast(df) if rows <= limit else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _meet(rows: DataFrame, per: DataFrame, hubs: DataFrame, many: int) -> DataFrame:
    """rows (u, v) joined with per (u, m). The rows of hubs (u, n; many of them), nodes with n rows, are dealt to several keys by a hash of v, and
    the hub's row of per is repeated for each, so no hub meets its row in one task."""
    if not many:
        return rows.join(per, "u").select("u", "v", "m")
    k = small(hubs.select("u", F.ceil(F.col("n") / F.lit(HUB)).cast("int").alias("k")), many, HUBS)
    dealt = rows.join(k, "u", "left").withColumn("s", F.pmod(F.xxhash64("v"), F.coalesce("k", F.lit(1))).cast("int"))
    every = per.join(k, "u", "left").withColumn("s", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
    return dealt.drop("k").join(every.drop("k"), ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars: (node, component) for each node of an edge, the
    component being the smallest node of its set.

    edges has long columns a and b. Pairs (u, v) have u > v. A round takes the least v of each u. For the large star a pair moves down from v to v's own
    least neighbour; only nodes that are both some pair's u and another's v have one, so stars that are settled meet nothing. For the small star all v of
    a u are tied to the least of them; nodes with many are salted. When no such nodes are left and each u has one v, pairs are the components. Rounds
    grow with the logarithm of the longest path. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    pairs = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    pairs, now = store_counted(pairs, f"{name}-pairs", n=F.count(F.lit(1)))
    if not now["n"]:
        return spark.createDataFrame([], "node long, component long")
    for _ in range(rounds):
        low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        below = pairs.select(F.col("v").alias("w")).distinct()
        low = low.join(below, F.col("u") == F.col("w"), "left").select("u", "m", "n", F.col("w").isNotNull().alias("inner"))
        files = -(-now["n"] // PAIRS)
        low, seen = store_counted(low.coalesce(files), f"{name}-low", n=F.count(F.lit(1)), inner=F.count_if("inner"), hubs=F.count_if(F.col("n") > HUB))
        if not seen["inner"] and seen["n"] == now["n"]:
            break
        inner = low.where("inner").select(F.col("u").alias("v"), F.col("m").alias("lower"))
        large = pairs.join(small(inner, seen["inner"], HUBS), "v", "left").select("u", F.coalesce("lower", "v").alias("v"))
        per = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = _meet(large, per, low.where(F.col("n") > HUB).select("u", "n"), seen["hubs"])
        pairs = (
            linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(per.select("u", F.col("m").alias("v"))).distinct()
        )
        pairs, now = store_counted(pairs.coalesce(files), f"{name}-pairs", n=F.count(F.lit(1)))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
