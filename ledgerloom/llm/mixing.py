"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame operations only.

Sources ordered by code point, null last, weigh 5, 2, 1 and again. Together they take 150% of all sizes. Each one's
target stops at twice its size; what is cut off is shared among the others by weight until none is above: the water
level L with sum(min(2 * size, L * weight)) = total, found from the sources ordered by 2 * size / weight.

A source takes as many complete epochs as its target holds, then a weighted sample without replacement for the rest:
documents in the order of the exponential keys -ln(u) / quality, u uniform from a digest of the doc_id, up to the
budget. The document at the budget's end is taken in part, so a source takes its target to the word (rounded down).

A source may hold any share of the rows. Its running sums go over cells of the key's distribution: cells of about
CELL_ROWS documents are summed on their own and their totals give each cell its offset, so no task holds a source.

Null texts have size 0 and take 0 words. Null sources are one source. Sources without words have target 0. A null
quality, and a quality that is not positive, weighs 1. Rows with equal keys follow doc_id, then size; fully equal
rows share a place in either order with the same multiset of results. A null doc_id is a value like any other. Repeated label rows of a
document count as one with the largest quality. All rows of one doc_id have one key and so one cell: a doc_id is taken to name a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._spark import small, store, store_counted

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
CELL_ROWS = 1024
WORD = "[^\\x20\\x09-\\x0D]+"
#: Quality weights of labels: good, bad; documents without a label weigh 1.
GOOD, BAD = 2.0, 0.5


def word_count(text: Column) -> Column:
    """Words of a text; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(value: Column) -> Column:
    """In (0, 1), from the first 52 bits of the md5 digest of the value as text; null as the text null."""
    digits = F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("null"))), 1, 13), 16, 10)
    return (digits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """source, n, source_size, target of a table with one row per source (source, n, source_size).

    One task orders the sources, a row each; documents are not in it. A source is a dimension of the mix with a weight of its own, thousands of
    them at most; hosts or other keys that grow with the documents have to be mapped to sources first.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.pmod(F.col("rank"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    at = sizes.withColumn("rank", rank).withColumn("w", w).withColumn("cap", F.col("source_size") * LIMIT)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = (
        at.withColumn("total", F.sum("source_size").over(every) * SHARE)
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(every))
    )
    target = F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return at.select("source", "n", "source_size", target.alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for docs (doc_id, source, text); quality: doc_id, weight."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    if quality is not None:
        one = quality.where("doc_id is not null").groupBy("doc_id").agg(F.max("weight").alias("weight"))
        rows = rows.join(one, "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    good = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    rows = store(rows.select("doc_id", "source", "size", (-F.log(uniform(F.col("doc_id"))) / good).alias("key")), "mix")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    sizes, seen = store_counted(targets(sizes), "targets", n=F.count(F.lit(1)))
    placed = rows.join(small(sizes.withColumnRenamed("source", "s"), seen["n"]), F.col("source").eqNullSafe(F.col("s")))
    cells = F.ceil(F.col("n") / F.lit(CELL_ROWS))
    placed = placed.drop("s").withColumn("cell", F.floor((1 - F.exp(-F.col("key"))) * cells).cast("long"))
    totals = placed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    run = run.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("offset") - F.col("before")
    part = F.greatest(F.lit(0), F.least(left, F.col("size")))
    return run.select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights of the labels table: doc_id, weight; of repeated rows the largest quality counts."""
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, BAD).otherwise(1.0)
    return labels.select(F.col("doc_id"), weight.alias("weight"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(docs, label_weights(labels)).drop("source")


SQL = r"""
with rows as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
      / coalesce(case when l.quality = 1 then 2.0 when l.quality = 0 then 0.5 end, 1.0) as key
  from documents d left join (select doc_id, max(quality) quality from labels group by doc_id) l on d.doc_id = l.doc_id
), sizes as (
  select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 as rank from rows group by source
), weighed as (
  select *, case rank % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double w, 2.0::double * source_size cap from sizes
), levels as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0)) as level from weighed
), filled as (
  select source, source_size, least(cap, coalesce((select max(level) from levels where level * w <= cap) * w, cap)) target from levels
), run as (
  select r.doc_id, r.size, f.source_size, f.target,
    coalesce(sum(r.size) over (partition by r.source order by r.key, r.doc_id, r.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from rows r join filled f on r.source is not distinct from f.source
), epochs as (
  select *, floor(target)::bigint budget, case when source_size > 0 then floor(target)::bigint // source_size else 0 end ep from run
)
select doc_id, size, source_size, target, (ep * size + greatest(0, least(budget - ep * source_size - before, size)))::bigint taken from epochs
"""
