"""The procurement projection of the driver tables: orders as jobs, line items as order lines, and derived invoices,
deliveries and aliases. Deterministic integer arithmetic, mirrored by the SQL fragments, so both engines agree exactly.

Money is BIGINT millimes here; exact decimals are made from it where operators want them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ALL = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over the session's partitions: a small file is read in one task, whatever is done with its rows."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, ord, part, supp, ref, designation, qty, price_m, tva, ship, h."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    at = lines.withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ALL)))
    price = F.floor(F.col("l_extendedprice") * 1000 / F.col("l_quantity")).cast("long")
    return at.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("job_id"), "ord", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("ref"), F.upper("p_name").alias("designation"),
        F.col("l_quantity").cast("long").alias("qty"), price.alias("price_m"), F.floor(F.col("l_tax") * 100 + 0.5).cast("int").alias("tva"),
        F.col("l_shipdate").cast("date").alias("ship"), F.pmod(F.col("l_orderkey") * 31 + F.col("ord") * 7, F.lit(20)).cast("int").alias("h"),
    )


def invoice_lines(orders: DataFrame) -> DataFrame:
    """job_id, ord, ref, designation, qty, price_m, tva, h: order lines with seeded slips; h = 7 adds a line of its own."""
    h = F.col("h")
    kept = orders.where("h <> 0").select(
        "job_id", "ord", "part", F.when(h == 4, F.concat(F.lit("X"), F.col("part").cast("string"))).otherwise(F.col("ref")).alias("ref"),
        F.when(h == 5, F.replace("designation", F.lit("O"), F.lit("0"))).otherwise(F.col("designation")).alias("designation"),
        (F.col("qty") + F.when(h == 1, 1).when(h == 2, -1).otherwise(0)).alias("qty"),
        F.when(h == 3, F.floor(F.col("price_m") / 10).cast("long")).when(h == 8, F.col("price_m") + 1000).otherwise(F.col("price_m")).alias("price_m"),
        (F.col("tva") + F.when(h == 6, 1).otherwise(0)).alias("tva"), "h",
    )
    extra = orders.where("h = 7").select(
        "job_id", (F.col("ord") + 1000).alias("ord"), "part", F.concat(F.lit("E"), F.col("part").cast("string")).alias("ref"),
        F.lit("FRAIS").alias("designation"), F.lit(1).cast("long").alias("qty"), F.lit(5000).cast("long").alias("price_m"), "tva", "h",
    )
    return kept.unionByName(extra)


def delivery_lines(orders: DataFrame) -> DataFrame:
    """job_id, doc_ord, ord, ref, designation, qty: even lines delivered in two parts."""
    one = orders.select("job_id", F.lit(1).alias("doc_ord"), "ord", "ref", "designation", F.when(F.col("ord") % 2 == 0, F.col("qty") - F.floor(F.col("qty") / 2).cast("long")).otherwise(F.col("qty")).alias("qty"))
    two = orders.where("ord % 2 = 0 and qty > 1").select("job_id", F.lit(2).alias("doc_ord"), "ord", "ref", "designation", F.floor(F.col("qty") / 2).cast("long").alias("qty"))
    return one.unionByName(two)


def dec(millimes: Column | str) -> Column:
    """Millimes as DECIMAL(18,4)."""
    return (F.col(millimes) if isinstance(millimes, str) else millimes).cast("decimal(18,0)").__truediv__(F.lit(1000).cast("decimal(5,0)")).cast("decimal(18,4)")


LINES = """
base as (
  select l_orderkey job_id, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity,
    l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as ord, * from lineitem
), orders_ as (
  select job_id, ord, l_partkey part, l_suppkey supp, 'P' || lpad(l_partkey::varchar, 9, '0') as ref, upper(p_name) designation,
    l_quantity::bigint qty, floor(l_extendedprice * 1000 / l_quantity)::bigint price_m, floor(l_tax * 100 + 0.5)::int tva,
    l_shipdate::date ship, ((job_id * 31 + ord * 7) % 20)::int h
  from base join part on l_partkey = p_partkey
), fac as (
  select job_id, ord, part, case when h = 4 then 'X' || part else ref end as ref,
    case when h = 5 then replace(designation, 'O', '0') else designation end designation,
    (qty + case h when 1 then 1 when 2 then -1 else 0 end)::bigint qty,
    case when h = 3 then floor(price_m / 10)::bigint when h = 8 then price_m + 1000 else price_m end::bigint price_m,
    tva + case when h = 6 then 1 else 0 end tva, h from orders_ where h <> 0
  union all
  select job_id, ord + 1000, part, 'E' || part, 'FRAIS', 1::bigint, 5000::bigint, tva, h from orders_ where h = 7
), bl as (
  select job_id, 1 doc_ord, ord, ref, designation, case when ord % 2 = 0 then qty - qty // 2 else qty end::bigint qty from orders_
  union all
  select job_id, 2, ord, ref, designation, (qty // 2)::bigint from orders_ where ord % 2 = 0 and qty > 1
)"""
