"""From raw documents to sharded training data, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Nulls: a null text carries no evidence of quality and has no words, so the first three stages keep it and mixing, which takes words, drops it with other texts
without words. Rows with a null doc_id are kept by the stages that name documents to drop. Repeated rows stay together: what drops a doc_id drops all its rows, and
mixing repeats each of them. An empty table stays empty. Columns besides those of documents pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, minhash, mixing, quality, sharding
from ledgerloom.llm._spark import small, store, store_counted


#: Near copies go from this Jaccard similarity of word shingles; 32 bands of 6 registers find its pairs.
NEAR, BAND_ROWS = (80, 100), 6


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _without(docs: DataFrame, lost: DataFrame, name: str) -> DataFrame:
    """docs without the doc_ids of lost; they are broadcast only if few. Rows with a null doc_id stay."""
    lost, seen = store_counted(lost, name, n=F.count(F.lit(1)))
    return docs.join(small(lost, seen["n"]), "doc_id", "left_anti").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    found = minhash.near_duplicates(docs, threshold=NEAR, band_rows=BAND_ROWS)
    return _without(docs, found.where(~F.col("kept")).select("doc_id").distinct(), "duplicates")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated").select("doc_id").distinct(), "contaminated")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix begins to take it: once for each epoch, whole or begun. Texts stay whole; a
    document that the mix takes no word of goes, and so do those without words."""
    plan = mixing.mix(docs, mixing.label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    plan = plan.select(F.col("doc_id").alias("id"), times.alias("times")).where("times > 0").groupBy("id").agg(F.max("times").alias("times"))
    plan, seen = store_counted(plan, "times", n=F.count(F.lit(1)))
    # the document's columns travel as one, whatever their names
    whole = docs.select(F.col("doc_id").alias("own"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    out = whole.join(small(plan, seen["n"]), F.col("own").eqNullSafe(F.col("id")))
    return out.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document row."""
    return sharding.shard(docs)


STAGES = [
    ("quality", classify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The classifier is a fitted model, and near-duplicate groups are connected components: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
