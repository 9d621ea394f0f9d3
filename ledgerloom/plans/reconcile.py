"""Queries over reconciliation: registry entries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import guards as G
from ledgerloom.functions import text as X
from ledgerloom.functions.similarity import pair_score_columns
from ledgerloom.operators import matching as M
from ledgerloom.plans import projection as P
from ledgerloom.registry import register

WITH = "with " + P.LINES

_EXACT = WITH + """, n_bc as (select *, row_number() over (partition by job_id, ref order by ord) occ from orders_),
n_fac as (select *, row_number() over (partition by job_id, ref order by ord) occ from fac),
lines as (
  select coalesce(b.job_id, f.job_id) job_id, coalesce(b.ref, f.ref) as ref, coalesce(b.ord, f.ord) as ord,
    b.qty qty_bc, f.qty qty_fac, b.price_m price_bc, f.price_m price_fac, b.tva tva_bc, f.tva tva_fac,
    case when f.job_id is null then 'MISSING' when b.job_id is null then 'EXTRA'
      when abs(b.price_m - f.price_m) > 100 and not shifted or abs(b.tva - f.tva) > 0.25 and b.tva <> 0 and f.tva <> 0 then 'MISMATCH'
      when f.qty < b.qty and f.qty > 0 then 'PARTIAL_MATCH' when shifted then 'LOW_CONFIDENCE' else 'MATCH' end verdict
  from (select *, 0 as z from n_bc) b full join n_fac f on b.job_id = f.job_id and b.ref = f.ref and b.occ = f.occ
  left join lateral (select coalesce(f.price_m > 0 and abs(b.price_m::double / f.price_m - 10) < 0.5, false) shifted) on true
), jobs as (
  select job_id, count(*)::bigint total_lines, sum((verdict = 'MATCH')::int)::bigint match_count, sum((verdict = 'MISMATCH')::int)::bigint mismatch_count,
    sum((verdict = 'MISSING')::int)::bigint missing_count, sum((verdict = 'EXTRA')::int)::bigint extra_count,
    sum((verdict in ('LOW_CONFIDENCE', 'PARTIAL_DATA', 'PARTIAL_MATCH'))::int)::bigint low_confidence_count,
    case when not bool_or(qty_fac is not null) then 'INCOMPLETE' when bool_or(verdict = 'MISMATCH') then 'REJECTED'
      when bool_or(verdict in ('PARTIAL_MATCH', 'LOW_CONFIDENCE')) then 'REVIEW' when bool_or(verdict = 'MISSING') then 'PARTIAL'
      when bool_or(verdict = 'EXTRA') then 'REVIEW' else 'VALIDATED' end global_verdict
  from lines group by job_id
)"""


def _exact_lines(spark, sf_dir: str) -> DataFrame:
    """Lines paired by exact reference and occurrence, with verdicts; the solver restricted to layer 1."""
    bc = P.order_lines(spark, sf_dir)
    fac = P.invoice_lines(bc)
    occ = F.row_number().over(Window.partitionBy("job_id", "key").orderBy("ord"))
    a = bc.withColumn("key", X.match_key("ref")).withColumn("occ", occ).select("job_id", "key", "occ", "ord", "ref", *[F.col(c).alias(f"{c}_bc") for c in ("qty", "price_m", "tva")])
    b = fac.withColumn("key", X.match_key("ref")).withColumn("occ", occ).select("job_id", "key", "occ", F.col("ord").alias("ord_f"), F.col("ref").alias("ref_f"), *[F.col(c).alias(f"{c}_fac") for c in ("qty", "price_m", "tva")])
    at = a.join(b, ["job_id", "key", "occ"], "full")
    price, fac_price = P.dec("price_m_bc"), P.dec("price_m_fac")
    shift = X.shift_repaired(price, fac_price)
    shifted = F.coalesce(shift != fac_price, F.lit(False))
    ok, warning = M.compare_quantities(X.nonzero("qty_bc"), X.nonzero("qty_fac"), F.lit(0), True)
    bad_rate = F.coalesce((F.col("tva_bc") != 0) & (F.col("tva_fac") != 0), F.lit(False)) & ~M.rates_agree(F.col("tva_bc").cast("decimal(9,4)"), F.col("tva_fac").cast("decimal(9,4)"), M.DEFAULT)
    bad = F.size(F.array_compact(F.array(F.when(~ok, 1), F.when(F.abs(price - shift) > 0.1, 1), F.when(bad_rate, 1))))
    verdict = F.when(F.col("ord_f").isNull(), "MISSING").when(F.col("ord").isNull(), "EXTRA").otherwise(
        M.line_verdict(F.lit(True), bad, F.coalesce(warning == "PARTIAL_DELIVERY", F.lit(False)), F.lit(1.0), F.when(shifted, 0.65).otherwise(1.0))
    )
    return at.select(
        "job_id", F.coalesce("ref", "ref_f").alias("ref"), F.coalesce("ord", "ord_f").alias("ord"), "qty_bc", "qty_fac",
        F.col("price_m_bc").alias("price_bc"), F.col("price_m_fac").alias("price_fac"), "tva_bc", "tva_fac", verdict.alias("verdict"),
    )


def _exact_jobs(spark, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    lines = _exact_lines(spark, sf_dir) if lines is None else lines
    jobs = lines.groupBy("job_id").agg(F.bool_or(F.col("qty_fac").isNotNull()).alias("has_invoice")).select(
        "job_id", F.lit(True).alias("has_order"), "has_invoice", F.lit(0).alias("n_warnings")
    )
    return M.match_results(lines, jobs)


@register("verdict_exact_match", "VRD2 VRD3 AGG1 AGG3", _EXACT + " select global_verdict, count(*)::bigint jobs, sum(total_lines)::bigint n_lines from jobs group by 1")
def verdict_exact_match(spark, sf_dir):
    jobs = _exact_jobs(spark, sf_dir)
    return jobs.groupBy("global_verdict").agg(F.count(F.lit(1)).alias("jobs"), F.sum("total_lines").alias("n_lines"))


@register("line_verdicts", "VRD2 VRD3 NUM5", _EXACT + " select job_id, ref, ord, qty_bc, qty_fac, price_bc, price_fac, tva_bc, tva_fac, verdict from lines")
def line_verdicts(spark, sf_dir):
    return _exact_lines(spark, sf_dir)


@register("global_verdict", "AGG1 AGG2 AGG3 VRD7", _EXACT + """ select job_id, global_verdict, case when global_verdict in ('REVIEW', 'INCOMPLETE')
  then 'REVIEW_REQUIRED' else 'COMPLETED' end status, total_lines, match_count, mismatch_count, missing_count, extra_count, low_confidence_count from jobs""")
def global_verdict(spark, sf_dir):
    return _exact_jobs(spark, sf_dir)


@register("verdict_distribution", "AGG1", _EXACT + " select verdict, count(*)::bigint n from lines group by verdict")
def verdict_distribution(spark, sf_dir):
    return _exact_lines(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@register("quality_metrics", "AGG16", _EXACT + """, c as (select job_id, match_count m, mismatch_count x, extra_count e, missing_count s, low_confidence_count r from jobs)
select job_id, case when m + x + e + r > 0 then floor(100.0::double * m / (m + x + e + r) + 0.5)::int end validated_pct,
  case when m + x + s + r > 0 then floor(100.0::double * (m + x + r) / (m + x + s + r) + 0.5)::int end coverage_pct from c""")
def quality_metrics(spark, sf_dir):
    from ledgerloom.operators.review import quality_rates

    return quality_rates(_exact_jobs(spark, sf_dir)).select("job_id", "validated_pct", "coverage_pct")


@register("missing_lines", "JN9", WITH + """ select o.job_id, o.ref, o.ord from orders_ o where not exists (select 1 from fac f where f.job_id = o.job_id and f.ref = o.ref)""")
def missing_lines(spark, sf_dir):
    bc = P.order_lines(spark, sf_dir)
    return bc.join(P.invoice_lines(bc).select("job_id", "ref"), ["job_id", "ref"], "left_anti").select("job_id", "ref", "ord")


@register("extra_lines", "SET4", WITH + """ select f.job_id, f.ref, f.ord from fac f where not exists (select 1 from orders_ o where f.job_id = o.job_id and f.ref = o.ref)""")
def extra_lines(spark, sf_dir):
    bc = P.order_lines(spark, sf_dir)
    return P.invoice_lines(bc).join(bc.select("job_id", "ref"), ["job_id", "ref"], "left_anti").select("job_id", "ref", "ord")


@register("bl_aggregate", "JN7", WITH + """ select job_id, (row_number() over (partition by job_id order by min((doc_ord, ord))) - 1)::int idx, ref, sum(qty)::bigint qty,
  arg_min(designation, (doc_ord, ord)) designation from bl group by job_id, ref""")
def bl_aggregate(spark, sf_dir):
    bl = P.delivery_lines(P.order_lines(spark, sf_dir)).select(
        "job_id", "doc_ord", F.col("ord").alias("idx"), "ref", "designation", "qty", F.lit(None).cast("decimal(18,4)").alias("price"),
        F.lit(None).cast("decimal(9,4)").alias("tva"), F.lit(None).cast("decimal(18,4)").alias("total"), F.lit(1.0).alias("confidence"), F.lit(False).alias("low"),
    )
    return M.merge_deliveries(bl).select("job_id", "idx", "ref", "qty", "designation")


@register("bc_consolidate", "JN8", WITH + """, g as (select job_id, ref, price_m, min(ord) first, arg_min(case when ord % 5 = 0 then -1 else qty end, ord) q0,
  sum(case when ord % 5 = 0 then null else qty end)::bigint q from orders_ group by all)
  select job_id, ref, price_m, case when q0 >= 0 then q end qty, (row_number() over (partition by job_id order by first) - 1)::int idx from g""")
def bc_consolidate(spark, sf_dir):
    """Every fifth line has no quantity, to exercise the first-null rule."""
    bc = P.order_lines(spark, sf_dir).select("job_id", F.col("ord").alias("idx"), "ref", "designation", F.when(F.col("ord") % 5 != 0, F.col("qty")).alias("qty"), F.col("price_m").alias("price"))
    return M.consolidate_orders(bc).select("job_id", "ref", F.col("price").alias("price_m"), "qty", "idx")


@register("link_documents", "JN5", """with k as (select o_orderkey job_id, 'BC2024' || lpad(o_orderkey::varchar, 8, '0') a,
  case o_orderkey % 6 when 0 then null when 1 then 'BC-2024/' || lpad(o_orderkey::varchar, 8, '0') when 2 then 'BC2O24' || lpad(o_orderkey::varchar, 8, '0')
    when 3 then 'BC2O24' || lpad(o_orderkey::varchar, 8, '0') || 'Z' when 4 then 'ZZ2024' || lpad(o_orderkey::varchar, 8, '0') || 'Z' else 'BC2024' || lpad(o_orderkey::varchar, 8, '0') end b from orders),
n as (select *, regexp_replace(a, '[^A-Z0-9]', '', 'g') x, regexp_replace(coalesce(b, ''), '[^A-Z0-9]', '', 'g') y from k),
d as (select *, levenshtein(x, y) d from n)
select job_id, (b is null or d <= 2) linked, case when b is null then 0.7::double when d = 0 then 1.0::double when d <= 2 then 1 - d / greatest(len(x), len(y))::double end confidence,
  (b is not null and d between 1 and 2) used_fuzzy from d""")
def link_documents(spark, sf_dir):
    key = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    r = F.col("o_orderkey") % 6
    other = (
        F.when(r == 1, F.concat(F.lit("BC-2024/"), key)).when(r == 2, F.concat(F.lit("BC2O24"), key)).when(r == 3, F.concat(F.lit("BC2O24"), key, F.lit("Z")))
        .when(r == 4, F.concat(F.lit("ZZ2024"), key, F.lit("Z"))).when(r == 5, F.concat(F.lit("BC2024"), key))
    )
    linked, confidence, fuzzy = M.link_references(F.concat(F.lit("BC2024"), key), other)
    return P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), linked.alias("linked"), confidence.alias("confidence"), fuzzy.alias("used_fuzzy"))


@register("alias_lookup", "JN12 JN13 JN14", WITH + """ select f.job_id, f.ord, f.ref, 'P' || lpad(f.part::varchar, 9, '0') alias_target from fac f
  where f.h = 4 and f.part % 3 <> 0""")
def alias_lookup(spark, sf_dir):
    """Aliases exist under two keys of the same supplier with conflicting targets; the id key has priority."""
    fac = P.invoice_lines(P.order_lines(spark, sf_dir))
    parts = P.table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select("p_partkey")
    external = F.concat(F.lit("X"), F.col("p_partkey").cast("string"))
    good = parts.select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("id"), F.lit("id:1").alias("supplier_key"), external.alias("external_ref"), F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("internal_ref"), F.lit(True).alias("is_active"))
    other = parts.select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("id"), F.lit("name:ACME").alias("supplier_key"), external.alias("external_ref"), F.lit("OTHER").alias("internal_ref"), F.lit(True).alias("is_active"))
    keys = fac.select("job_id").distinct().select("job_id", F.explode(F.array(F.struct(F.lit("id:1").alias("supplier_key"), F.lit(0).alias("priority")), F.struct(F.lit("name:ACME").alias("supplier_key"), F.lit(2).alias("priority")))).alias("k")).select("job_id", "k.*")
    return M.alias_targets(fac.where("h = 4"), good.unionByName(other), keys).where("alias_target is not null").select("job_id", "ord", "ref", "alias_target")


@register("alias_mine_range", "", WITH + """, p as (select o.job_id, o.ref, o.ord, f.ref external_ref, f.ord ord_f, abs(o.qty - f.qty) dq, abs(o.price_m - f.price_m) dp
  from orders_ o join fac f on o.job_id = f.job_id and o.designation = f.designation and abs(o.qty - f.qty) <= 0.5 and abs(o.price_m - f.price_m) <= 20),
r as (select *, row_number() over (partition by job_id, ord order by dq, dp, ord_f) as k from p)
select ref internal_ref, external_ref, count(*)::bigint n from r where k = 1 and ref <> external_ref group by all""")
def alias_mine_range(spark, sf_dir):
    bc = P.order_lines(spark, sf_dir)
    fac = P.invoice_lines(bc).select("job_id", "designation", F.col("ref").alias("external_ref"), F.col("ord").alias("ord_f"), F.col("qty").alias("q"), F.col("price_m").alias("p"))
    near = bc.join(fac, ["job_id", "designation"]).where("abs(qty - q) <= 0.5 and abs(price_m - p) <= 20")
    best = F.row_number().over(Window.partitionBy("job_id", "ord").orderBy(F.abs(F.col("qty") - F.col("q")), F.abs(F.col("price_m") - F.col("p")), "ord_f"))
    return near.withColumn("k", best).where("k = 1 and ref <> external_ref").groupBy(F.col("ref").alias("internal_ref"), "external_ref").agg(F.count(F.lit(1)).alias("n"))


@register("ref_overlap", "JN19 SET2", WITH + """, a as (select job_id, list(distinct ref) r from orders_ group by 1), b as (select job_id, list(distinct ref) r from fac group by 1)
select a.job_id, len(list_intersect(a.r, b.r))::int common, (len(list_intersect(a.r, b.r)) > 0.5 * greatest(len(a.r), len(b.r))) suspicious from a join b using (job_id)""")
def ref_overlap(spark, sf_dir):
    bc = P.order_lines(spark, sf_dir)
    a = bc.groupBy("job_id").agg(F.collect_set("ref").alias("a"))
    b = P.invoice_lines(bc).groupBy("job_id").agg(F.collect_set("ref").alias("b"))
    n = F.size(F.array_intersect("a", "b"))
    return a.join(b, "job_id").select("job_id", n.alias("common"), (n > 0.5 * F.greatest(F.size("a"), F.size("b"))).alias("suspicious"))


@register("decimal_shift", "NUM5", WITH + """, p as (select o.job_id, o.ord, o.price_m bc, f.price_m fac, case when f.price_m > 0 then o.price_m::double / f.price_m end r from orders_ o join fac f on o.job_id = f.job_id and o.ord = f.ord)
select job_id, ord, fac * case when abs(r - 10) / 10 < 0.05 then 10 when abs(r - 100) / 100 < 0.05 then 100 when abs(r - 1000) / 1000 < 0.05 then 1000 else 1 end repaired from p""")
def decimal_shift(spark, sf_dir):
    bc = P.order_lines(spark, sf_dir)
    fac = P.invoice_lines(bc).select("job_id", "ord", F.col("price_m").alias("fac"))
    return bc.join(fac, ["job_id", "ord"]).select("job_id", "ord", X.shift_repaired(F.col("price_m"), F.col("fac")).alias("repaired"))


@register("scale_correct", "NUM4", WITH + """, p as (select job_id, ord, qty, price_m * case when ord % 4 = 0 then 1000 when ord % 4 = 1 then 10 else 1 end price, qty * price_m total from orders_),
q as (select *, case when total > 0 then qty::double * price / total end r from p)
select job_id, ord, price::double / case when abs(r - 1000) <= 200 then 1000 when abs(r - 100) <= 20 then 100 when abs(r - 10) <= 2 then 10 else 1 end corrected from q""")
def scale_correct(spark, sf_dir):
    m = F.when(F.col("ord") % 4 == 0, 1000).when(F.col("ord") % 4 == 1, 10).otherwise(1)
    return P.order_lines(spark, sf_dir).select("job_id", "ord", X.scale_corrected(F.col("qty"), (F.col("price_m") * m).cast("double"), F.col("qty") * F.col("price_m")).alias("corrected"))


@register("line_math_check", "", """select l_orderkey job_id, l_linenumber line, l_quantity qty,
  (abs(floor(l_extendedprice * (1 - l_discount) * 1000) - floor(l_extendedprice * 1000)) <= greatest(20, 0.01::double * floor(l_extendedprice * 1000))) ok from lineitem""")
def line_math_check(spark, sf_dir):
    from ledgerloom.operators.validation import line_math

    li = P.table(spark, sf_dir, "lineitem")
    total, expected = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 1000), F.floor(F.col("l_extendedprice") * 1000)
    return li.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), line_math(total, expected, F.lit(20)).alias("ok"))


@register("dominant_rate", "AGG4 AGG5", WITH + """, c as (select job_id, tva, count(*) n, min(ord) first from fac where tva between 0 and 30 group by all),
r as (select *, sum(n) over (partition by job_id) total, row_number() over (partition by job_id order by n desc, first) as k from c)
select job_id, tva::double rate from r where k = 1 and n >= 2 and n >= 0.6 * total""")
def dominant_rate(spark, sf_dir):
    fac = P.invoice_lines(P.order_lines(spark, sf_dir)).select("job_id", F.col("ord").alias("idx"), F.col("tva").cast("decimal(9,4)").alias("tva"))
    return M.dominant_rate(fac).select("job_id", F.col("rate").cast("double").alias("rate"))


@register("total_reconcile_gate", "AGG6 REC3", WITH + """, p as (select f.job_id, f.qty * f.price_m cur, o.qty * o.price_m bc from fac f left join orders_ o on f.job_id = o.job_id and f.ord = o.ord),
t as (select job_id, sum(qty * price_m) total from orders_ group by 1),
s as (select job_id, sum(cur) cur, sum(coalesce(bc, cur)) cand, sum((bc is not null and abs(cur - bc) > greatest(100, abs(cur) / 1000.0::double, abs(bc) / 1000.0::double))::int) changed, count(bc) n from p group by 1)
select job_id, (n > 0 and changed > 0 and abs(cand - total) <= tol and abs(cur - total) > tol and abs(cand - total) + tol < abs(cur - total)) force
from (select s.*, t.total, greatest(100, total / 1000.0::double, cand / 1000.0::double) tol from s join t using (job_id))""")
def total_reconcile_gate(spark, sf_dir):
    bc = P.order_lines(spark, sf_dir)
    fac = P.invoice_lines(bc)
    shape = lambda df: df.select("job_id", F.col("ord").alias("idx"), F.col("qty").cast("decimal(10,0)").alias("qty"), P.dec("price_m").alias("price"), F.lit(None).cast("decimal(18,4)").alias("total"))
    totals = bc.groupBy("job_id").agg(P.dec(F.sum(F.col("qty") * F.col("price_m"))).alias("total_ht"))
    pairs = fac.join(bc.select("job_id", "ord"), ["job_id", "ord"]).select("job_id", F.col("ord").alias("bc_idx"), F.col("ord").alias("doc_idx"))
    return M.total_gate(shape(bc), shape(fac), pairs, totals)


@register("line_reconcile", "REC1 REC2", WITH + """, p as (select o.job_id, o.ord, o.qty * o.price_m bc, f.qty * f.price_m own, case when o.h in (1, 3) then o.qty * o.price_m when o.h = 2 then 0 else f.qty * f.price_m end declared
  from orders_ o join fac f on o.job_id = f.job_id and o.ord = f.ord),
q as (select *, greatest(100, bc / 1000.0::double, declared / 1000.0::double) t1, greatest(100, own / 1000.0::double, declared / 1000.0::double) t2 from p)
select job_id, ord, (declared > 0 and abs(declared - bc) <= t1 and abs(own - declared) > t2) copied from q""")
def line_reconcile(spark, sf_dir):
    bc = P.order_lines(spark, sf_dir)
    fac = P.invoice_lines(bc).select("job_id", "ord", F.col("qty").alias("q"), F.col("price_m").alias("p"))
    at = bc.join(fac, ["job_id", "ord"])
    declared = F.when(F.col("h").isin(1, 3), F.col("qty") * F.col("price_m")).when(F.col("h") == 2, 0).otherwise(F.col("q") * F.col("p"))
    qty = lambda c: F.col(c).cast("decimal(10,0)")
    copied, _ = M.invoice_reconciled(qty("qty"), P.dec("price_m"), qty("q"), P.dec("p"), P.dec(declared), F.lit(False))
    return at.select("job_id", "ord", copied.alias("copied"))


@register("tva_slip", "REC4", WITH + """, m as (select job_id, max(tva) trusted from orders_ group by 1), p as (select o.job_id, o.ord, o.tva bc, f.tva fac, trusted t from orders_ o join fac f on o.job_id = f.job_id and o.ord = f.ord join m on m.job_id = o.job_id)
select job_id, ord, case when abs(bc - fac) <= 0.25 then bc when abs(fac - t) <= 0.25 and abs(bc - t) <= 4 and bc // 10 = t // 10 then t when abs(bc - t) <= 0.25 and abs(fac - t) <= 4 and fac // 10 = t // 10 then t else bc end::double tva_bc,
  case when abs(bc - fac) <= 0.25 then fac when abs(fac - t) <= 0.25 and abs(bc - t) <= 4 and bc // 10 = t // 10 then t when abs(bc - t) <= 0.25 and abs(fac - t) <= 4 and fac // 10 = t // 10 then t else fac end::double tva_fac from p""")
def tva_slip(spark, sf_dir):
    bc = P.order_lines(spark, sf_dir)
    at = bc.join(P.invoice_lines(bc).select("job_id", "ord", F.col("tva").alias("fac")), ["job_id", "ord"]).join(bc.groupBy("job_id").agg(F.max("tva").alias("trusted")), "job_id")
    rate = lambda c: F.col(c).cast("decimal(9,4)")
    b, f, _ = M.reconcile_rates(rate("tva"), rate("fac"), rate("trusted"), M.DEFAULT)
    return at.select("job_id", "ord", b.cast("double").alias("tva_bc"), f.cast("double").alias("tva_fac"))


@register("qty_compare", "VRD2", WITH + """ select o.job_id, o.ord, (f.qty = o.qty or f.qty < o.qty or f.qty > o.qty) ok_partial, (f.qty = o.qty) ok_strict,
  case when f.qty = o.qty then null when f.qty < o.qty then 'PARTIAL_DELIVERY' else 'OVER_DELIVERY' end warning from orders_ o join fac f on o.job_id = f.job_id and o.ord = f.ord""")
def qty_compare(spark, sf_dir):
    bc = P.order_lines(spark, sf_dir)
    at = bc.join(P.invoice_lines(bc).select("job_id", "ord", F.col("qty").alias("q")), ["job_id", "ord"])
    ok, warning = M.compare_quantities(F.col("qty"), F.col("q"), F.lit(0), True)
    strict, _ = M.compare_quantities(F.col("qty"), F.col("q"), F.lit(0), False)
    return at.select("job_id", "ord", ok.alias("ok_partial"), strict.alias("ok_strict"), warning.alias("warning"))


@register("fuzzy_pair_score", "JN2 JN3 JN4")
def fuzzy_pair_score(spark, sf_dir):
    """Distinct normalised pairs of the jobs' lines, scored once each."""
    bc = P.order_lines(spark, sf_dir)
    fac = P.invoice_lines(bc)
    side = lambda df, s: df.select("job_id", X.match_key("ref").alias(f"ref_{s}"), X.description("designation").alias(f"desc_{s}"))
    pairs = side(bc, "a").join(side(fac, "b"), "job_id").drop("job_id").distinct()
    return pairs.withColumn("s", pair_score_columns("ref_a", "desc_a", "ref_b", "desc_b")).select("ref_a", "desc_a", "ref_b", "desc_b", "s.confidence", "s.layer")


def _sides(spark, sf_dir):
    bc0 = P.order_lines(spark, sf_dir)
    fac0, bl0 = P.invoice_lines(bc0), P.delivery_lines(bc0)
    shape = lambda df, idx: df.select(
        "job_id", idx.cast("int").alias("idx"), "ref", "designation", F.col("qty").cast("decimal(18,4)").alias("qty"), P.dec("price_m").alias("price"),
        F.col("tva").cast("decimal(9,4)").alias("tva"), F.lit(None).cast("decimal(18,4)").alias("total"), F.lit(1.0).alias("confidence"),
    )
    seq = F.row_number().over(Window.partitionBy("job_id").orderBy("ord")) - 1
    aliased = shape(fac0, seq).withColumn("alias_target", F.when(F.col("ref").startswith("X"), F.concat(F.lit("P"), F.lpad(F.substring("ref", 2, 12), 9, "0"))))
    bl = bl0.select(
        "job_id", "doc_ord", F.col("ord").alias("idx"), "ref", "designation", F.col("qty").cast("decimal(18,4)").alias("qty"), F.lit(None).cast("decimal(18,4)").alias("price"),
        F.lit(None).cast("decimal(9,4)").alias("tva"), F.lit(None).cast("decimal(18,4)").alias("total"), F.lit(1.0).alias("confidence"), F.lit(False).alias("low"),
    )
    totals = bc0.groupBy("job_id").agg(P.dec(F.sum(F.col("qty") * F.col("price_m"))).alias("total_ht"), F.max("tva").cast("decimal(9,4)").alias("tva_rate"))
    return shape(bc0, seq), M.merge_deliveries(bl), aliased, totals


@register("three_way_match", "JN1 JN2 JN3 JN7 JN11 VRD1 VRD3 VRD4 SET1")
def three_way_match(spark, sf_dir):
    bc, bl, fac, totals = _sides(spark, sf_dir)
    return M.three_way_match(bc, bl, fac, totals).withColumn("mismatch_fields", F.array_join("mismatch_fields", ","))


@register("three_way_results", "AGG1 AGG2 AGG3 VRD7")
def three_way_results(spark, sf_dir):
    bc, bl, fac, totals = _sides(spark, sf_dir)
    jobs = totals.select("job_id", F.lit(True).alias("has_order")).join(fac.select("job_id", F.lit(True).alias("i")).distinct(), "job_id", "left")
    jobs = jobs.select("job_id", "has_order", F.coalesce("i", F.lit(False)).alias("has_invoice"), F.lit(0).alias("n_warnings"))
    return M.match_results(M.three_way_match(bc, bl, fac, totals), jobs)


@register("alias_mine_fuzzy", "JN21")
def alias_mine_fuzzy(spark, sf_dir):
    """The range join with a fuzzy description: distinct description pairs are scored once and joined back."""
    from ledgerloom.operators.suppliers import mine_aliases

    bc = P.order_lines(spark, sf_dir)
    fac = P.invoice_lines(bc)
    shape = lambda df: df.select("job_id", "ord", "ref", "designation", F.col("qty").cast("double").alias("qty"), (F.col("price_m") / 1000).alias("price"))
    return mine_aliases(shape(bc), shape(fac))


@register("recent_jobs", "SRT1", "select o_orderkey job_id, o_orderdate created_at from orders order by o_orderdate desc, o_orderkey desc limit 20")
def recent_jobs(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"))
    return o.orderBy(F.desc("created_at"), F.desc("job_id")).limit(20)


@register("job_page", "SRT7", """select job_id, place from (select o_orderkey job_id, row_number() over (order by o_orderdate desc, o_orderkey desc)::int place from orders
  where o_orderstatus = 'F') where place between 21 and 40""")
def job_page(spark, sf_dir):
    """The second page of 20: a top-k of the pages so far, numbered, so no task sorts all jobs."""
    top = P.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(40)
    place = F.row_number().over(Window.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return top.select(F.col("o_orderkey").alias("job_id"), place.alias("place")).where("place between 21 and 40")


@register("job_search", "FLT21", """select o_orderkey job_id from orders where contains('commande_' || o_orderkey || '.pdf', 'e_77') or contains(strftime(o_orderdate, '%d/%m/%Y'), 'e_77')
  or contains(case o_orderstatus when 'F' then 'terminé' when 'O' then 'en attente' else 'en cours' end, 'e_77')""")
def job_search(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("PROCESSING")
    name = F.concat(F.lit("commande_"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    return o.where(G.job_matches("e_77", name, G.status_label(status), X.shown_date("o_orderdate"))).select(F.col("o_orderkey").alias("job_id"))


@register("audit_trail", "SRT2", """select event_id, user_id actor, event_type, ts created_at, row_number() over (partition by user_id order by ts, event_id)::int as seq,
  cast(json_extract_string(props, '$.k') as bigint) page_number from events""")
def audit_trail(spark, sf_dir):
    e = P.table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", F.col("user_id").alias("actor"), "event_type", F.col("ts").alias("created_at"), seq.alias("seq"), F.get_json_object("props", "$.k").cast("long").alias("page_number"))


@register("job_progress", "AGG17", """select user_id job_id, floor(100.0::double * count(distinct event_type) / (select count(distinct event_type) from events) + 0.5)::int progress from events group by 1""")
def job_progress(spark, sf_dir):
    e = P.table(spark, sf_dir, "events")
    steps = e.agg(F.countDistinct("event_type").alias("steps"))
    done = e.groupBy(F.col("user_id").alias("job_id")).agg(F.countDistinct("event_type").alias("done"))
    return done.crossJoin(F.broadcast(steps)).select("job_id", F.floor(100.0 * F.col("done") / F.col("steps") + 0.5).cast("int").alias("progress"))


@register("human_review", "VRD8", _EXACT + """, s as (select job_id, global_verdict, case when global_verdict in ('REVIEW', 'INCOMPLETE') then 'REVIEW_REQUIRED' else 'COMPLETED' end status,
  case when job_id % 3 = 0 then 'approve' when job_id % 3 = 1 then 'reject' end d from jobs)
select job_id, case when status = 'REVIEW_REQUIRED' and d = 'approve' then 'COMPLETED' when status = 'REVIEW_REQUIRED' and d = 'reject' then 'FAILED' else status end new_status,
  case when status = 'REVIEW_REQUIRED' and d = 'approve' then 'VALIDATED' when status = 'REVIEW_REQUIRED' and d = 'reject' then 'REJECTED' else global_verdict end new_verdict from s""")
def human_review(spark, sf_dir):
    jobs = _exact_jobs(spark, sf_dir)
    decision = F.when(F.col("job_id") % 3 == 0, "approve").when(F.col("job_id") % 3 == 1, "reject")
    status, verdict = M.reviewed(F.col("status"), F.coalesce(decision, F.lit("")), F.col("global_verdict"))
    return jobs.select("job_id", status.alias("new_status"), verdict.alias("new_verdict"))


@register("best_documents", "AGG9", """with d as (select l_orderkey job_id, l_returnflag doc, count(*) n from lineitem group by all)
select job_id, arg_max(doc, (n, -ascii(doc))) best_invoice, arg_max(doc, (n, ascii(doc))) best_order from d group by 1""")
def best_documents(spark, sf_dir):
    """Documents of a job with most lines: the first among equals for invoices, the last for orders."""
    d = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("doc")).agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("job_id").agg(F.max_by("doc", F.struct("n", -F.ascii("doc"))).alias("best_invoice"), F.max_by("doc", F.struct("n", F.ascii("doc"))).alias("best_order"))
