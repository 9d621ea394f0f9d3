"""Queries over sources, sinks, review steps, nested results and streams: registry entries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import pair_score_columns
from ledgerloom.operators import documents as D
from ledgerloom.operators import matching as M
from ledgerloom.operators import review as R
from ledgerloom.operators import tables as B
from ledgerloom.plans import pages as G
from ledgerloom.plans import projection as P
from ledgerloom.plans import reconcile as C
from ledgerloom.plans import texts as W
from ledgerloom.registry import register
from ledgerloom.sources import readers, sinks
from ledgerloom.sources.scratch import folder, stored
from ledgerloom.streaming import jobs


def _str(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@register("alias_csv", "SRC12", "select 'P' || p_partkey internal_ref, 'X,' || p_partkey external_ref, p_name designation, p_size::double qty, p_retailprice::double prix, (p_partkey % 100)::int match_score from part")
def alias_csv(spark, sf_dir):
    """Written and read as comma-separated values."""
    at = folder(spark, "aliases")
    p = P.table(spark, sf_dir, "part")
    p.select(
        F.lit("f.pdf").alias("pdf"), F.concat(F.lit("P"), _str("p_partkey")).alias("internal_ref"), F.concat(F.lit("X,"), _str("p_partkey")).alias("external_ref"), F.col("p_name").alias("designation"),
        F.col("p_size").cast("double").alias("qty"), F.col("p_retailprice").alias("prix"), (F.col("p_partkey") % 100).cast("int").alias("match_score"),
    ).write.csv(at, header=True)
    return readers.mined_aliases(spark, at).drop("pdf")


@register("alias_statements", "SRC13", "select 'X''' || p_partkey external_ref, 'P' || p_partkey internal_ref from part")
def alias_statements(spark, sf_dir):
    """Alias rows of INSERT statements, with comments between them."""
    at = folder(spark, "statements")
    k = _str("p_partkey")
    row = F.concat(F.lit("('X''"), k, F.lit("', 'P"), k, F.lit("'),"))
    p = P.table(spark, sf_dir, "part")
    p.select(F.explode(F.array(F.lit("-- 'no', 'row'"), F.lit("INSERT INTO t (a, b) VALUES"), row)).alias("value")).write.text(at)
    return readers.seed_aliases(spark, at).select(F.element_at("values", 1).alias("external_ref"), F.element_at("values", 2).alias("internal_ref"))


@register("job_files", "SRC14 SRT4", """select l_orderkey::varchar job_id, 'BC' doc_type, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) - 1)::int idx, l_linenumber::int line_number, 'P' || l_partkey ref_produit, l_quantity::double qty from lineitem""")
def job_files(spark, sf_dir):
    """Nested job results as JSON lines; their lines by line number."""
    at = folder(spark, "jobs")
    line = F.struct(F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("qty"), F.concat(F.lit("P"), _str("l_partkey")).alias("ref_produit"))
    per = P.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    per.select(_str("l_orderkey").alias("id"), F.lit("COMPLETED").alias("status"), F.array(F.struct(F.lit("d").alias("id"), F.lit("BC").alias("doc_type"), F.col("lines"))).alias("documents")).write.json(at)
    return readers.job_lines(readers.job_documents(spark, at, lines=True)).select("job_id", "doc_type", "idx", "line_number", "ref_produit", "qty")


@register("stored_lines", "SNK1", "with " + P.LINES + " select job_id, ord, case when ord % 5 <> 0 then qty end::double qty, nullif(price_m / 1000.0, 0)::double price, ref from orders_")
def stored_lines(spark, sf_dir):
    """Lines as they are stored: written and read again."""
    bc = P.order_lines(spark, sf_dir)
    lines = bc.select("job_id", "ord", F.when(F.col("ord") % 5 == 0, 0).otherwise(F.col("qty")).cast("decimal(18,4)").alias("qty"), P.dec("price_m").alias("price"), "ref")
    at = folder(spark, "lines")
    sinks.stored_lines(lines).write.parquet(at)
    return spark.read.parquet(at)


_NESTED = C._EXACT + ", o as (select job_id, (ord, ref) o, verdict from lines), n as (select job_id, count(*)::int n, arg_min(verdict, o) first_verdict, arg_max(verdict, o) last_verdict from o group by job_id) "


@register("nested_results", "SNK2", _NESTED + "select job_id, global_verdict, n, first_verdict, last_verdict from jobs join n using (job_id)")
def nested_results(spark, sf_dir):
    # the lines are paired once, for the counts of a job and for its nested lines
    lines = stored(C._exact_lines(spark, sf_dir).select("job_id", "ord", "ref", "verdict", "qty_fac"), "exact-lines")
    verdicts = lines.select("job_id", F.lit(0).alias("part"), "ord", F.col("ref").alias("ref_produit"), "verdict", F.lit(1.0).alias("confidence"), F.lit(1).alias("match_layer"), F.lit(None).cast("string").alias("notes"))
    v = F.col("line_verdicts")
    return sinks.nested_results(verdicts, C._exact_jobs(spark, sf_dir, lines)).select(
        "job_id", "global_verdict", F.size(v).alias("n"), F.element_at(v, 1)["verdict"].alias("first_verdict"), F.element_at(v, -1)["verdict"].alias("last_verdict")
    )


@register("event_log", "SNK3", """select o_orderkey job_id, 'status_changed' event_type, '{"status":"' || o_orderstatus || '","page":' || (o_orderkey % 9) || '}' event_data, 'system' actor from orders union all
select o_orderkey, 'reviewed', '{"ok":true}', 'u' || o_custkey from orders where o_orderkey % 4 = 0""")
def event_log(spark, sf_dir):
    """Events appended in two writes to a partitioned log."""
    o, at = P.table(spark, sf_dir, "orders"), folder(spark, "events")
    k = F.col("o_orderkey")
    first = sinks.audit_event(k, "status_changed", F.lit("system"), F.col("o_orderdate"), status=F.col("o_orderstatus"), page=k % 9)
    second = sinks.audit_event(k, "reviewed", F.concat(F.lit("u"), _str("o_custkey")), F.col("o_orderdate"), ok=F.lit(True))
    sinks.append_events(o.select(first.alias("e")).select("e.*"), at)
    sinks.append_events(o.where(k % 4 == 0).select(second.alias("e")).select("e.*"), at)
    return spark.read.parquet(at).select("job_id", "event_type", "event_data", "actor")


@register("job_statuses", "SNK4", """select o_orderkey job_id, case when v is not null then case when v in ('REVIEW', 'INCOMPLETE') then 'REVIEW_REQUIRED' else 'COMPLETED' end when o = 0 then 'FAILED' when x then 'MATCHING' when u is not null then 'EXTRACTING' else 'PROCESSING' end status
from (select o_orderkey, case o_orderkey % 7 when 0 then 'REVIEW' when 1 then 'VALIDATED' when 2 then 'INCOMPLETE' end v, case when o_orderkey % 3 = 0 then null else (o_orderkey % 3 - 1)::int end o, o_orderkey % 5 = 0 x, case when o_orderkey % 2 = 0 then false end u from orders)""")
def job_statuses(spark, sf_dir):
    k = F.col("o_orderkey")
    verdict = F.when(k % 7 == 0, "REVIEW").when(k % 7 == 1, "VALIDATED").when(k % 7 == 2, "INCOMPLETE")
    status = sinks.job_status(F.when(k % 2 == 0, False), k % 5 == 0, verdict, F.when(k % 3 != 0, (k % 3) == 2))
    return P.table(spark, sf_dir, "orders").select(k.alias("job_id"), status.alias("status"))


@register("alias_usage", "SNK7", """with u as (select l_partkey id, count(*) n, max(l_shipdate) used from lineitem where l_linenumber = 1 group by 1)
select p_partkey id, (p_partkey % 5 + coalesce(n, 0))::bigint usage_count, used last_used_at from part left join u on id = p_partkey""")
def alias_usage(spark, sf_dir):
    aliases = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("usage_count"), F.lit(None).cast("timestamp").alias("last_used_at"))
    used = P.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("alias_id"), F.col("l_shipdate").alias("used_at"))
    return R.count_usage(aliases, used)


@register("alias_approvals", "VRD10", """with k as (select p_partkey, case p_partkey % 3 when 0 then 'A' else 'B' end old, p_partkey % 2 = 0 act, case p_partkey % 4 when 0 then 'A' when 1 then 'B' end new from part),
j as (select *, p_partkey % 5 <> 0 known, new is not null asked from k)
select p_partkey, known and asked and old <> new clash, case when known then old else new end internal_ref, case when asked and not (known and old <> new) then true else act end active from j where known or asked""")
def alias_approvals(spark, sf_dir):
    k = F.col("p_partkey")
    p = P.table(spark, sf_dir, "part")
    cols = lambda ref, active: [F.lit("id:1").alias("supplier_key"), F.concat(F.lit("x-"), _str(k)).alias("external_ref"), ref.alias("internal_ref"), active.alias("is_active"), F.lit(1).alias("usage_count")]
    known = p.where(k % 5 != 0).select(*cols(F.when(k % 3 == 0, "A").otherwise("B"), k % 2 == 0))
    asked = p.where((k % 4).isin(0, 1)).select(*cols(F.when(k % 4 == 0, "a").otherwise("b"), F.lit(True)))
    kept, clashes = R.approve_aliases(known, asked)
    bad = clashes.select("external_ref", F.lit(True).alias("clash"))
    return kept.join(bad, "external_ref", "left").select(
        F.substring("external_ref", 3, 20).cast("long").alias("p_partkey"), F.coalesce("clash", F.lit(False)).alias("clash"), F.upper("internal_ref").alias("internal_ref"), F.col("is_active").alias("active")
    )


@register("edited_lines", "VRD11", """select l_orderkey job_id, l_linenumber line, l_partkey part, max(case when l_linenumber = 2 and l_orderkey % 2 = 0 then 99 else l_quantity end)::double qty, any_value(case when l_linenumber = 2 and l_orderkey % 3 = 0 and l_orderkey % 2 = 0 then 'E' else 'P' end) as ref from lineitem group by all""")
def edited_lines(spark, sf_dir):
    rows = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")).agg(F.max("l_quantity").alias("qty")).withColumn("ref", F.lit("P"))
    edits = rows.where("line = 2 and job_id % 2 = 0").select("job_id", "line", "part", F.lit(99.0).alias("qty"), F.when(F.col("job_id") % 3 == 0, "E").alias("ref"))
    return R.edited(rows, edits, ["job_id", "line", "part"])


@register("job_tree", "JN20 VRD12", """with d as (select l_orderkey job_id, l_returnflag doc_id, count(*) n, min(l_linenumber)::int first_line from lineitem group by all), j as (select job_id, count(*)::int n_docs, sum(n)::int n_lines, arg_min(first_line, doc_id)::int first_line from d group by 1)
select job_id, case when job_id % 3 = 0 then 'MATCHING' else 'COMPLETED' end status, case when job_id % 3 <> 0 then n_docs end n_docs, case when job_id % 3 <> 0 then n_lines end n_lines, case when job_id % 3 <> 0 then first_line end first_line, case when job_id % 3 = 0 then 'not complete' end message from j""")
def job_tree(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("doc_id"), F.col("l_linenumber").alias("line_number"), F.lit("P").alias("ref_produit"), F.col("l_quantity").alias("qty"))
    documents = li.select("job_id", "doc_id").distinct().withColumn("doc_type", F.lit("BC"))
    results = li.select("job_id").distinct().withColumn("status", F.when(F.col("job_id") % 3 == 0, "MATCHING").otherwise("COMPLETED"))
    docs = F.col("documents")
    n = F.aggregate(docs, F.lit(0), lambda a, d: a + F.size(d["lines"]))
    return R.assembled(documents, li, results).select(
        "job_id", "status", F.when(docs.isNotNull(), F.size(docs)).alias("n_docs"), F.when(docs.isNotNull(), n).alias("n_lines"),
        F.element_at(F.element_at(docs, 1)["lines"], 1)["line_number"].alias("first_line"), "message",
    )


@register("alias_order", "SRT5", """with a as (select p_partkey id, case p_partkey % 3 when 0 then 'id:1' when 1 then 'name:A' else 'code:Z' end k from part where p_partkey % 4 <> 0), j as (select s_suppkey job_id, unnest([('id:1', 0), ('name:A', 1 + s_suppkey % 2)]) z from supplier)
select job_id, id, k supplier_key, z[2]::int priority, row_number() over (partition by job_id order by z[2], id)::int place from j join a on a.k = z[1]""")
def alias_order(spark, sf_dir):
    k = F.col("p_partkey")
    aliases = P.table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 == 0, "id:1").when(k % 3 == 1, "name:A").otherwise("code:Z").alias("supplier_key"), (k % 4 != 0).alias("is_active"))
    two = F.array(F.struct(F.lit("id:1").alias("supplier_key"), F.lit(0).alias("priority")), F.struct(F.lit("name:A").alias("supplier_key"), (1 + F.col("s_suppkey") % 2).cast("int").alias("priority")))
    keys = P.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("job_id"), F.explode(two).alias("k")).select("job_id", "k.*")
    return R.alias_order(aliases, keys)


@register("extraction_report", "AGG18", """with e as (select l_orderkey doc_id, count(*) n, sum(floor(l_extendedprice)) t from lineitem group by 1), f as (select l_orderkey doc_id, count(*) n, sum(floor(l_extendedprice)) + 10 t from lineitem where l_linenumber <> 2 and l_orderkey % 5 <> 0 group by 1)
select doc_id, least(1.0::double, coalesce(f.n, 0)::double / e.n) recall, abs(f.t - e.t)::double / e.t error, case when f.n is not null then 0.8::double end confidence from e left join f using (doc_id)""")
def extraction_report(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey"))
    count, total = F.count(F.lit(1)).alias("n_lines"), F.sum(F.floor("l_extendedprice")).cast("double")
    expected = li.groupBy("doc_id").agg(count, total.alias("total_ttc"))
    found = li.where("l_linenumber <> 2 and doc_id % 5 <> 0").groupBy("doc_id").agg(count, (total + 10).alias("total_ttc")).withColumn("confidence", F.lit(0.8))
    return R.extraction_report(found, expected)


@register("mined_types", "AGG21", "select l_returnflag doc_type, count(*)::bigint n from lineitem group by 1")
def mined_types(spark, sf_dir):
    return D.lines_by_type(P.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("doc_type")))


@register("attached_pages", "JN22", f"with {G._PAGES} select job_id, page_number // 2 group_no, page_number, len(text)::int n from p where page_number <> 3")
def attached_pages(spark, sf_dir):
    pages = G._pages(spark, sf_dir)
    two = F.array(F.struct(F.lit(0).alias("group_no"), F.array(F.lit(0), F.lit(1)).alias("pages")), F.struct(F.lit(1).alias("group_no"), F.array(F.lit(2), F.lit(9)).alias("pages")))
    groups = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.explode(two).alias("g")).select("job_id", "g.*")
    return D.attach_pages(groups, pages).select("job_id", "group_no", "page_number", F.length("text").alias("n"))


@register("document_lines", "EXT8", f"""with {G._LINES}, b as (select l_orderkey doc_id, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) as i, l_partkey, l_quantity from lineitem)
select doc_id, i::int line_number, 'P' || l_partkey as ref, l_quantity::bigint::double qty, 'SPATIAL' as by from b where doc_id % 2 = 0 union all select doc_id, (line_no - 1)::int, ref, qty::double, 'TEXT' from t where doc_id % 2 = 1""")
def document_lines(spark, sf_dir):
    """Word boxes are known of every second document."""
    spatial = stored(B.table_lines(G._boxes(spark, sf_dir).where("doc_id % 2 = 0"), ["doc_id"], F.lit(1000.0)), "spatial-lines").select("doc_id", F.col("row").alias("line_number"), F.col("ref_produit").alias("ref"), F.col("qty").cast("double").alias("qty"))
    text = D.text_items(G._text_lines(spark, sf_dir)).select("doc_id", "line_number", "ref", F.col("qty").cast("double").alias("qty"))
    return D.spatial_or_text(spatial, text)


@register("pair_scores", "JN2 JN4", """with p as (select p_partkey, p_partkey % 8 as k from part)
select p_partkey, case k when 0 then 1.0 when 1 then 0.85 when 2 then 0.65 when 3 then 0.75 when 4 then 0.55 when 5 then 0.75 when 6 then 0.0 else 0.85 end::double confidence, case k when 0 then 1 when 1 then 2 when 2 then 2 when 3 then 3 when 4 then 3 when 5 then 4 when 6 then 0 else 2 end::int as layer from p""")
def pair_scores(spark, sf_dir):
    """Pairs whose similarity follows from how they are made: a reference of ten distinct characters with n replaced by strange ones has the ratio 100 - 10 n,
    words in another order have 100, six of ten characters in common have 60."""
    k = F.col("p_partkey") % 8
    own = F.translate(F.lpad(_str("p_partkey"), 6, "0"), "0123456789", "ABCDEFGHIJ")
    ref = F.concat(F.lit("WXYZ"), own)
    ref_b = F.when(k == 0, ref).when(k == 1, F.concat(F.lit("W7YZ"), own)).when(k == 2, F.concat(F.lit("78YZ"), own)).when(k == 5, F.concat(F.repeat(F.lit("9"), F.lit(80)), ref)).when(k == 7, F.concat(F.lit("WXY1"), own)).otherwise("0000000000")
    desc_a = F.when(k == 3, "vis acier m8").when(k == 4, "abcdefghij").otherwise("xxxx")
    desc_b = F.when(k == 3, "m8 vis acier").when(k == 4, "abcdef1234").otherwise("9999")
    at = P.table(spark, sf_dir, "part").select("p_partkey", ref.alias("a"), desc_a.alias("b"), ref_b.alias("c"), desc_b.alias("d"))
    return at.withColumn("s", pair_score_columns("a", "b", "c", "d")).select("p_partkey", "s.confidence", "s.layer")


_WAY = """l as (select l_orderkey job_id, (row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) - 1)::int idx, l_quantity::bigint qty, (floor(l_extendedprice) + 1)::bigint price from lineitem),
w as (select *, ((job_id * 31 + idx * 7) % 10)::int h from l),
v as (select *, h <> 0 has_fac, h not in (1, 6) has_bl, case when h = 2 then qty - 1 when h = 3 then qty + 2 else qty end fq, case when h = 4 then price * 10 when h = 5 then price + 5 else price end::double bcp, case when idx % 2 = 0 and qty > 1 then qty - 1 else qty end lq from w),
x as (select *, bool_or(has_bl) over (partition by job_id) any_bl from v),
y as (select *, has_fac and h = 4 shifted, has_fac and h = 5 and 5 > 0.1 bad_price, has_bl and lq < qty or has_fac and nullif(fq, 0) < qty partial from x),
z as (select *, case when not has_fac and not any_bl or any_bl and not has_bl and not has_fac then 'MISSING' when bad_price and h = 5 and not (abs(bcp / price - 10) / 10 < 0.05) then 'MISMATCH' when partial then 'PARTIAL_MATCH' when shifted then 'LOW_CONFIDENCE' else 'MATCH' end verdict from y)"""


@register("three_way_verdicts", "JN1 JN3 JN7 JN10 JN11 VRD1 VRD2 VRD3 VRD4 VRD5 SET1", f"""with {_WAY}
select job_id, 0 part, idx as ord, verdict, case when verdict = 'MISSING' then 0 when h = 6 then 6 else 1 end::int match_layer, h = 6 reference_alias_applied from z
union all select job_id, 1, 1000, 'EXTRA', 0, false from z where idx = 0 and job_id % 3 = 0 union all select job_id, 2, idx + 1000, 'EXTRA', 0, false from z where h = 7""")
def three_way_verdicts(spark, sf_dir):
    """Jobs whose references share no character, so that the best assignment is the pairing of equal references and aliases, which SQL can state. Delivery
    and invoice lines are absent, short, over, shifted in price, wrong in price, aliased or additional by a hash of job and line."""
    li = P.table(spark, sf_dir, "lineitem")
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")) - 1
    at = li.select(F.col("l_orderkey").alias("job_id"), seq.alias("idx"), F.col("l_quantity").cast("long").alias("qty"), (F.floor("l_extendedprice") + 1).cast("long").alias("price"))
    at = at.withColumn("h", ((F.col("job_id") * 31 + F.col("idx") * 7) % 10).cast("int"))
    h, letter = F.col("h"), lambda i: F.repeat(F.char(65 + i), F.lit(8))
    ref, qty, price = letter(F.col("idx")), F.col("qty"), F.col("price")

    def lines(df: DataFrame, idx, ref_, qty_, price_, **more) -> DataFrame:
        return df.select(
            "job_id", idx.cast("int").alias("idx"), ref_.alias("ref"), F.lit(None).cast("string").alias("designation"), qty_.cast("decimal(18,4)").alias("qty"), price_.cast("decimal(18,4)").alias("price"),
            F.lit(None).cast("decimal(9,4)").alias("tva"), F.lit(None).cast("decimal(18,4)").alias("total"), F.lit(1.0).alias("confidence"), *[c.alias(n) for n, c in more.items()],
        )

    none = F.lit(None)
    bc = lines(at, F.col("idx"), ref, qty, F.when(h == 4, price * 10).when(h == 5, price + 5).otherwise(price))
    short = F.when((F.col("idx") % 2 == 0) & (qty > 1), qty - 1).otherwise(qty)
    two = at.where(~h.isin(1, 6))
    part = lambda df, doc, q: lines(df, F.col("idx"), ref, q, none, doc_ord=F.lit(doc), low=F.lit(False))
    bl = part(two, 1, F.lit(1)).unionByName(part(two.where(short > 1), 2, short - 1))
    bl = bl.unionByName(lines(at.where("idx = 0 and job_id % 3 = 0"), F.lit(1000), F.lit("zz zz"), F.lit(3), none, doc_ord=F.lit(3), low=F.lit(False)))
    aliased = F.when(h == 6, ref)
    own = F.when(h == 6, F.concat(F.lit("77"), _str("idx"))).otherwise(ref)
    fac = lines(at.where(h != 0), F.col("idx"), own, F.when(h == 2, qty - 1).when(h == 3, qty + 2).otherwise(qty), price, alias_target=aliased)
    fac = fac.unionByName(lines(at.where(h == 7), F.col("idx") + 1000, F.repeat(F.lit("9"), F.lit(8)), F.lit(1), F.lit(7), alias_target=none.cast("string")))
    merged = M.merge_deliveries(bl)
    invoices = at.select("job_id").distinct().select("job_id", none.cast("decimal(18,4)").alias("total_ht"), none.cast("decimal(9,4)").alias("tva_rate"))
    none_same = at.select("job_id", F.col("idx").alias("bc_idx"), F.lit(True).alias("same"), F.lit(0.9).alias("confidence"))
    out = M.three_way_match(bc, merged, fac, invoices, arbitration=none_same)
    ord_ = F.when(F.col("part") == 1, 1000).otherwise(F.col("ord"))
    return out.select("job_id", "part", ord_.cast("int").alias("ord"), "verdict", "match_layer", "reference_alias_applied")


@register("stream_promotions", "STR1 STR4", """select supplier_key, pattern, 3::bigint documents from (select l_suppkey::varchar supplier_key, l_returnflag || (l_partkey % 50) pattern, l_orderkey doc_id from lineitem) group by all having count(distinct doc_id) >= 3""")
def stream_promotions(spark, sf_dir):
    """Evidence read as a stream of files; a pattern is written in the batch that promotes it."""
    at = folder(spark, "evidence")
    e = P.table(spark, sf_dir, "lineitem").select(_str("l_suppkey").alias("supplier_key"), F.concat("l_returnflag", _str(F.col("l_partkey") % 50)).alias("pattern"), F.col("l_orderkey").alias("doc_id"))
    e.repartition(3).write.parquet(f"{at}/in")
    stream = jobs.file_stream(spark, f"{at}/in", "supplier_key string, pattern string, doc_id long", 2)
    assert jobs.finished(jobs.promoted_patterns(stream, f"{at}/out", f"{at}/checkpoint"))
    return spark.read.parquet(f"{at}/out").select("supplier_key", "pattern", "documents")


@register("stream_lines", "STR2 STR5 STR6", """select l_orderkey job_id, l_linenumber line, p_name designation, l_quantity qty from lineitem join part on p_partkey = l_partkey where l_quantity > 10""")
def stream_lines(spark, sf_dir):
    """Lines read as a stream and joined batch by batch with a dimension that is loaded anew."""
    at = folder(spark, "stream-lines")
    li = P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    li.repartition(3).write.parquet(f"{at}/in")
    stream = jobs.file_stream(spark, f"{at}/in", "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double", 2)
    parts = lambda: P.table(spark, sf_dir, "part").select("p_partkey", "p_name")

    def joined(lines: DataFrame, dimension: DataFrame) -> DataFrame:
        return lines.where("l_quantity > 10").join(dimension, F.col("p_partkey") == F.col("l_partkey"))

    assert jobs.finished(jobs.with_dimension(stream, parts, joined, f"{at}/out", f"{at}/checkpoint"))
    return spark.read.parquet(f"{at}/out").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.col("p_name").alias("designation"), F.col("l_quantity").alias("qty"))


@register("user_sessions", "STR3", """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) s from e)
select user_id, min(ts) \"start\", max(ts) + interval 30 minute as \"end\", count(*)::bigint n from s group by user_id, s""")
def user_sessions(spark, sf_dir):
    return jobs.sessions(P.table(spark, sf_dir, "events"))
