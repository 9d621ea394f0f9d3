"""Queries over pages, headers, tables, validation and streams: registry entries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import guards as G
from ledgerloom.functions import text as X
from ledgerloom.operators import documents as D
from ledgerloom.operators import suppliers as S
from ledgerloom.operators import tables as B
from ledgerloom.operators import validation as V
from ledgerloom.plans import projection as P
from ledgerloom.registry import register
from ledgerloom.sources.readers import page_counts as count_pages
from ledgerloom.sources.scratch import stored
from ledgerloom.streaming.jobs import audit_counts

_PAGES = """p as (select o_orderkey job_id, n page_number, case when n = 0 then 'BON DE COMMANDE N°' || o_orderkey || chr(10) || 'BC-2024-' || lpad(o_orderkey::varchar, 6, '0') || chr(10) || 'DATE: ' || strftime(o_orderdate, '%d/%m/%Y') || chr(10) || 'Lignes' || chr(10) || 'Fin'
  when n = 1 then case o_orderkey % 3 when 0 then 'PAGE 2 SUR 2' || chr(10) || 'BON DE COMMANDE suite' when 1 then 'BON DE LIVRAISON N°12' || chr(10) || 'BL-2024-' || lpad(o_orderkey::varchar, 6, '0') || chr(10) || 'a' else 'RECEPTION' || chr(10) || 'DATE REÇU' || chr(10) || 'b' end
  when n = 2 then 'FACTURE N°7' || chr(10) || 'FAC/2024/' || lpad(o_orderkey::varchar, 6, '0') || chr(10) || 'TOTAL HT: ' || replace(o_totalprice::decimal(18, 3)::varchar, '.', ',') || chr(10) || 'TVA 19%' || chr(10) || 'x' else 'page vide sans mots' end as text
  from orders, (select unnest(range(0, 4))::int n))"""


def _pages(spark, sf_dir) -> DataFrame:
    """Four rendered pages an order."""
    key = F.col("o_orderkey").cast("string")
    k6, nl = F.lpad(key, 6, "0"), F.lit("\n")
    first = F.concat(F.lit("BON DE COMMANDE N°"), key, nl, F.lit("BC-2024-"), k6, nl, F.lit("DATE: "), F.date_format("o_orderdate", "dd/MM/yyyy"), nl, F.lit("Lignes"), nl, F.lit("Fin"))
    r = F.col("o_orderkey") % 3
    second = F.when(r == 0, F.lit("PAGE 2 SUR 2\nBON DE COMMANDE suite")).when(r == 1, F.concat(F.lit("BON DE LIVRAISON N°12\nBL-2024-"), k6, F.lit("\na"))).otherwise(F.lit("RECEPTION\nDATE REÇU\nb"))
    total = F.replace(F.col("o_totalprice").cast("decimal(18,3)").cast("string"), F.lit("."), F.lit(","))
    third = F.concat(F.lit("FACTURE N°7\nFAC/2024/"), k6, F.lit("\nTOTAL HT: "), total, F.lit("\nTVA 19%\nx"))
    orders = P.spread(P.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"))
    return orders.select(F.col("o_orderkey").alias("job_id"), F.posexplode(F.array(first, second, third, F.lit("page vide sans mots"))).alias("page_number", "text"))


def _sql_regex(p: str) -> str:
    """A pattern for RE2: its word boundary knows ASCII only, so a boundary after ° or É is spelt out."""
    return "'" + p.replace("''", "'").replace("'", "''") + "'"


_KINDS = ("BC", "BL", "FACTURE", "RECEPTION")
#: The rendered pages contain only the keywords below; the SQL side scores those.
_SIMPLE = {
    "BC": (r"\bBON\s+DE\s+COMMANDE\b", r"\bCOMMANDE\s+N°\d", r"\bBC[-/]\d{4}"), "BL": (r"\bBON\s+DE\s+LIVRAISON\b", r"\bLIVRAISON\s+N°\d", r"\bBL[-/]\d{4}"),
    "FACTURE": (r"\bFACTURE\b", r"\bFACTURE\s+N°\d", r"\bFAC[-/]\d{4}"), "RECEPTION": (r"\bRECEPTION\b", r"\bRECEPTION\b", r"\bDATE\s+REÇU"),
}
_SCORES = ", ".join("least(1.0::double, " + " + ".join(f"case when regexp_matches(top, {_sql_regex(p)}) then 0.4::double when regexp_matches(up, {_sql_regex(p)}) then 0.15::double else 0::double end" for p in ps) + f") s{i}" for i, ps in enumerate(_SIMPLE.values()))
_CLASS = f"""{_PAGES}, u as (select job_id, page_number, upper(text) up, array_to_string(list_slice(string_split(upper(text), chr(10)), 1, greatest(1, len(string_split(text, chr(10))) * 4 // 10)), chr(10)) top from p),
s as (select *, {_SCORES} from u), b as (select *, greatest(s0, s1, s2, s3) best, list_sort([s0, s1, s2, s3], 'DESC')[2] runner_up from s),
c as (select job_id, page_number, up, case when best < 0.15 then 'UNKNOWN' when s0 = best then 'BC' when s1 = best then 'BL' when s2 = best then 'FACTURE' else 'RECEPTION' end doc_type,
  case when best < 0.15 then 0::double when best - runner_up < 0.10 then best * 0.70::double else best end confidence from b)"""


def _classified(spark, sf_dir) -> DataFrame:
    return _pages(spark, sf_dir).withColumn("c", D.classify(F.col("text"))).select("job_id", "page_number", "text", F.col("c.type").alias("doc_type"), F.col("c.confidence").alias("confidence"))


@register("classify_rule", "CLS1", f"with {_CLASS} select job_id, page_number, doc_type, confidence from c")
def classify_rule(spark, sf_dir):
    return _classified(spark, sf_dir).select("job_id", "page_number", "doc_type", "confidence")


@register("classify_cascade", "CLS2 CLS3", f"""with {_CLASS} select job_id, page_number, case when confidence >= 0.9 then doc_type when job_id % 2 = 0 then 'BC' else 'UNKNOWN' end final_type,
  case when confidence >= 0.9 then 1 when job_id % 2 = 0 then 2 else 3 end tier from c""")
def classify_cascade(spark, sf_dir):
    at = _pages(spark, sf_dir).withColumn("c", D.cascade(D.classify(F.col("text")), F.lit("BC"), F.when(F.col("job_id") % 2 == 0, 0.8).otherwise(0.3)))
    return at.select("job_id", "page_number", F.col("c.type").alias("final_type"), F.col("c.tier").alias("tier"))


@register("continuation_pages", "FLT9", f"with {_PAGES} select job_id, page_number from p where regexp_matches(upper(text), 'PAGE\\s+\\d+\\s+(OF|SUR|DE)\\s+\\d+|\\bSUITE\\b|(^|\\W)\\d{{1,2}}\\s*/\\s*\\d{{1,2}}([^\\w\\s]|$)')")
def continuation_pages(spark, sf_dir):
    return _pages(spark, sf_dir).where(G.is_continuation("text")).select("job_id", "page_number")


@register("ref_hint", "CLS4", f"""with {_PAGES} select job_id, page_number, coalesce(nullif(regexp_extract(up, '(?:N[°o]?\\s*)?BC[-\\s/]?\\d{{2,4}}[-\\s/]?\\d{{2,6}}'), ''), nullif(regexp_extract(up, '(?:N[°o]?\\s*)?BL[-\\s/]?\\d{{2,4}}[-\\s/]?\\d{{2,6}}'), ''),
  nullif(regexp_extract(up, '(?:N[°o]?\\s*)?FAC[-\\s/]?\\d{{2,4}}[-\\s/]?\\d{{2,6}}'), ''), nullif(regexp_extract(up, '\\d{{4}}[-/]\\d{{3,6}}'), ''), '') hint from (select *, upper(text) up from p)""")
def ref_hint(spark, sf_dir):
    return _pages(spark, sf_dir).select("job_id", "page_number", D.reference_hint(F.col("text")).alias("hint"))


def _header(patterns: tuple[str, ...], x: str = "upper(text)") -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({x}, {_sql_regex(p)}, 1)), '')" for p in patterns) + ")"


_HEADS = ", ".join(f"{_header(ps)} {name}" for name, ps in D.HEADERS.items() if name in ("ref_bc", "ref_bl", "ref_facture", "ref_bc_linked", "date"))


@register("header_extract", "EXT1 EXT2", f"""with {_PAGES}, h as (select job_id, {_HEADS} from p where page_number = 0)
select job_id, ref_bc ref_document, strptime(\"date\", '%d/%m/%Y')::date document_date, case when \"date\" is null then 0 else 0.85 end::double confidence from h where ref_bc is not null""")
def header_extract(spark, sf_dir):
    docs = _pages(spark, sf_dir).where("page_number = 0").select(F.col("job_id").alias("doc_id"), "text")
    return D.extract_header(docs, "BC").select(F.col("doc_id").alias("job_id"), "ref_document", "document_date", "confidence")


@register("aliased_header", "EXT9", f"""with {_PAGES}, a as (select job_id, replace(replace(upper(text), 'LIGNES', 'N°BC: Z9-77'), 'BON DE COMMANDE N°', 'PIECE ') as t from p where page_number = 0)
select job_id, {_header(D.HEADERS["ref_bc"], "t")} ref_document from a""")
def aliased_header(spark, sf_dir):
    """A supplier that names the order's number otherwise."""
    text = D.with_aliases(F.col("text"), {"Lignes": "N°BC: Z9-77", "bon de commande n°": "piece "})
    return _pages(spark, sf_dir).where("page_number = 0").select("job_id", D.header_field(text, D.HEADERS["ref_bc"])["value"].alias("ref_document"))


@register("invoice_header", "EXT4", f"""with {_PAGES}, h as (select job_id, {_HEADS} from p where page_number = 2)
select job_id, ref_facture ref_document, ref_bc_linked, (o_totalprice::decimal(18, 3) * case when o_totalprice >= 10000 then 1000 else 1 end)::double total_ht, 19::double tva_rate, 0::double confidence from h join orders on o_orderkey = job_id""")
def invoice_header(spark, sf_dir):
    docs = _pages(spark, sf_dir).where("page_number = 2").select(F.col("job_id").alias("doc_id"), "text")
    return D.extract_header(docs, "FACTURE").select(F.col("doc_id").alias("job_id"), "ref_document", "ref_bc_linked", F.col("total_ht").cast("double").alias("total_ht"), F.col("tva_rate").cast("double").alias("tva_rate"), "confidence")


@register("delivery_header", "EXT3", f"""with {_PAGES}, h as (select job_id, {_HEADS} from p where page_number = 1)
select job_id doc_id, ref_bl ref_document, case when ref_bl is null or \"date\" is null then 0 else 0.85 end::double confidence from h""")
def delivery_header(spark, sf_dir):
    docs = _pages(spark, sf_dir).where("page_number = 1").select(F.col("job_id").alias("doc_id"), "text")
    return D.extract_header(docs, "BL").select("doc_id", "ref_document", "confidence")


_LINES = """t as (select l_orderkey doc_id, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) + 1 as line_no, 'P' || lpad(l_partkey::varchar, 9, '0') as ref, l_quantity::bigint qty, floor(l_extendedprice)::bigint total, l_partkey % 4 as kind from lineitem)"""


def _text_lines(spark, sf_dir) -> DataFrame:
    """Rendered text tables: a caption, a header, a caption of totals without a number, one line an item in four layouts, a totals line and a line after it."""
    from pyspark.sql import Window

    li = P.table(spark, sf_dir, "lineitem")
    no = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")) + 1
    gap = F.lit("   ")
    s = lambda c: c.cast("string")
    ref, qty, total = F.concat(F.lit("P"), F.lpad(s(F.col("l_partkey")), 9, "0")), s(F.col("l_quantity").cast("long")), s(F.floor("l_extendedprice").cast("long"))
    kind = F.col("l_partkey") % 4
    item = (
        F.when(kind == 0, F.concat(ref, gap, F.lit("ARTICLE DIVERS"), gap, qty, gap, F.lit("2,500"), gap, total, gap, F.lit("19%")))
        .when(kind == 1, F.concat(F.lit("  "), ref, F.lit("\t"), F.lit("ARTICLE DIVERS"), gap, qty, gap, F.lit("2,500"), gap, total))
        .when(kind == 2, F.concat(F.lit("7 %"), gap, ref, gap, F.lit("ARTICLE"), gap, qty, gap, F.lit("2,500"), gap, F.lit("TYPE B"), gap, total))
        .otherwise(F.concat(ref, gap, qty))
    )
    items = li.select(F.col("l_orderkey").alias("doc_id"), (no + 2).alias("line_no"), item.alias("line"))
    ends = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    row = lambda at, text: ends.select("doc_id", at.cast("int").alias("line_no"), F.lit(text).alias("line"))
    out = items
    for at, text in ((F.lit(1), "QTE 2024"), (F.lit(2), "CODE   DÉSIGNATION   QTE   P.U"), (F.lit(3), "TOTAL TTC"), (F.col("n") + 4, "TOTAL HT : 1 000,000"), (F.col("n") + 5, "P1   APRES   5   6")):
        out = out.unionByName(row(at, text))
    return out


@register("text_table", "EXT5 WIN5 WIN7 FLT7 FLT13", f"with {_LINES} select doc_id, (line_no - 1)::int line_number, ref, case kind when 2 then 'ARTICLE TYPE B' when 3 then null else 'ARTICLE DIVERS' end designation, qty::double qty, case when kind < 3 then 2.5::double end price, case when kind < 3 then total::double end total, case kind when 0 then 19 when 2 then 7 end::double tva_rate, 0.75::double confidence from t")
def text_table(spark, sf_dir):
    d = lambda c: F.col(c).cast("double").alias(c)
    return D.text_items(_text_lines(spark, sf_dir)).select("doc_id", "line_number", "ref", "designation", d("qty"), d("price"), d("total"), d("tva_rate"), "confidence")


_BOX = """b as (select l_orderkey doc_id, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) as i, l_partkey, l_quantity, l_extendedprice from lineitem)"""


def _boxes(spark, sf_dir) -> DataFrame:
    """Word boxes of a table: a header row, then a row an item; words of a row differ in y by up to 5."""
    from pyspark.sql import Window

    li = P.table(spark, sf_dir, "lineitem")
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    at = li.select(F.col("l_orderkey").alias("doc_id"), i.alias("i"), "l_partkey", "l_quantity", "l_extendedprice")

    def word(text, x, dy):
        return F.struct(text.cast("string").alias("text"), F.lit(x).alias("x"), F.lit(dy).alias("dy"))

    items = at.select("doc_id", "i", F.posexplode(F.array(
        word(F.concat(F.lit("P"), F.col("l_partkey").cast("string")), 10, 0), word(F.lit("VIS"), 110, 2), word(F.col("l_quantity").cast("long"), 210, 4), word(F.lit("PCE"), 310, 1), word(F.floor("l_extendedprice").cast("long"), 410, 5),
    )).alias("k", "w"))
    head = at.select("doc_id").distinct().select("doc_id", F.lit(0).alias("i"), F.posexplode(F.array(word(F.lit("REF"), 10, 0), word(F.lit("DESIGNATION"), 110, 0), word(F.lit("QTE"), 210, 0), word(F.lit("UNITE"), 310, 0), word(F.lit("MONTANT HT"), 410, 0))).alias("k", "w"))
    return items.unionByName(head).select(
        "doc_id", (F.col("i") * 10 + F.col("k")).alias("ord"), "w.text", "w.x", (F.col("i") * 20 + F.col("w.dy")).alias("y"), F.lit(50).alias("w"), F.lit(15).alias("h"), F.lit(85.0).alias("conf")
    )


@register("word_rows", "WIN2", f"with {_BOX} select doc_id, i * 10 + k as \"ord\", i::int as \"row\" from b, (select unnest(range(0, 5)) k) union all select distinct doc_id, k, 0 from b, (select unnest(range(0, 5)) k)")
def word_rows(spark, sf_dir):
    return B.word_rows(_boxes(spark, sf_dir), ["doc_id"]).select("doc_id", F.col("ord").cast("long").alias("ord"), "row")


@register("column_bounds", "WIN3 WIN4", f"""with {_BOX}, c as (select distinct doc_id, unnest([('ref_produit', 10), ('designation', 110), ('qty', 210), ('unit', 310), ('total_ligne_ht', 410)]) z from b)
select doc_id, z[1] as \"name\", coalesce((lag(z[2] + 50) over w + z[2]) / 2.0, 0)::double low, coalesce((z[2] + 50 + lead(z[2]) over w) / 2.0, 1000)::double high from c window w as (partition by doc_id order by z[2])""")
def column_bounds(spark, sf_dir):
    at = B.with_columns(B.page_rows(_boxes(spark, sf_dir), ["doc_id"]), F.lit(1000.0))
    return at.select("doc_id", F.explode("columns").alias("c")).select("doc_id", "c.name", "c.low", "c.high")


@register("spatial_table", "EXT6 EXT7 AGG20 FLT11 FLT12", f"with {_BOX} select doc_id, i::int as \"row\", 'P' || l_partkey ref_produit, 'VIS' designation, l_quantity::bigint::double qty, 'PCE' unit, floor(l_extendedprice)::double total_ligne_ht, 0.85::double confidence from b")
def spatial_table(spark, sf_dir):
    out = B.table_lines(_boxes(spark, sf_dir), ["doc_id"], F.lit(1000.0))
    return out.select("doc_id", "row", "ref_produit", "designation", F.col("qty").cast("double").alias("qty"), "unit", F.col("total_ligne_ht").cast("double").alias("total_ligne_ht"), "confidence")


@register("page_sources", "SRC2 SRC4 AGG19", "select o_custkey job_id, count(*)::bigint n_pages, sum((o_orderkey % 100 > 50 and o_shippriority_ < 0.3)::int)::bigint native, sum((not (o_orderkey % 100 > 50 and o_shippriority_ < 0.3))::int)::bigint scanned from (select *, (o_orderkey % 7) / 10.0 as o_shippriority_ from orders) group by 1")
def page_sources(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), D.page_source(F.col("o_orderkey") % 100, (F.col("o_orderkey") % 7) / 10).alias("source"))
    return count_pages(o)


@register("text_source", "SRC7 SRC8", """select doc_id, case when doc_id % 3 = 0 and (doc_id % 10) / 10.0 < 0.7 then 'TRANSCRIPTION' else 'OCR' end as "source", case when doc_id % 3 = 0 and (doc_id % 10) / 10.0 < 0.7 then 1 else len(text) end::int n from documents""")
def text_source(spark, sf_dir):
    c = D.chosen_text(F.col("text"), (F.col("doc_id") % 10) / 10, F.when(F.col("doc_id") % 3 == 0, F.lit("t")))
    return P.table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.source", F.length("c.text").alias("n"))


_DOCS = "d as (select o_orderkey doc_id, case when o_orderkey % 11 = 0 then '' else 'R' || o_orderkey end r, case when o_orderkey % 13 <> 0 then o_orderdate::date end dt from orders)"


def _validated(spark, sf_dir, kind: str) -> DataFrame:
    o, li = P.table(spark, sf_dir, "orders"), P.table(spark, sf_dir, "lineitem")
    docs = o.select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.concat(F.lit("R"), F.col("o_orderkey").cast("string"))).alias("ref_document"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate").cast("date")).alias("document_date"), F.lit(None).cast("double").alias("total_ht"), F.lit(None).cast("double").alias("total_ttc"), F.lit(None).cast("double").alias("tva_rate"),
    )
    n = F.col("l_linenumber")
    lines = li.select(
        F.col("l_orderkey").alias("doc_id"), F.when(n == 3, F.lit(None).cast("string")).otherwise(F.lit("P")).alias("ref"), F.when(n == 5, 0.0).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(n == 6, F.lit(None).cast("double")).otherwise(2.0).alias("price"), F.when(n == 2, F.col("l_quantity") * 2 + 1).otherwise(F.col("l_quantity") * 2).alias("total"),
    )
    return V.validate(docs, lines, kind)


def _validation_sql(kind: str) -> str:
    price_error = "bp" if kind == "FACTURE" else "0"
    price_warning = "0" if kind == "FACTURE" else "bp" if kind == "BC" else "0"
    bp = "sum((l_linenumber = 6)::int)" if kind != "BL" else "0"
    bm = "sum((l_linenumber = 2)::int)" if kind == "BC" else "0"
    return f"""with {_DOCS}, l as (select l_orderkey doc_id, count(*) n, sum((l_linenumber = 5)::int) bq, sum((l_linenumber = 3)::int) nr, {bp} bp, {bm} bm from lineitem group by 1),
j as (select d.*, coalesce(n, 0) n, coalesce(bq, 0) bq, coalesce(nr, 0) nr, coalesce(bp, 0) bp, coalesce(bm, 0) bm from d left join l using (doc_id)),
e as (select *, ((r = '')::int + (n = 0)::int + bq + {price_error})::bigint n_errors, ((dt is null)::int + nr + {price_warning} + bm)::bigint n_warnings from j)
select doc_id, n_errors, n_warnings, n_errors = 0 is_valid, array_to_string(list_filter([case when dt is null then 'document_date' end, case when n = 0 then 'lines' end, case when bp > 0 then 'prix_unitaire' end,
  case when bq > 0 then 'qty' end, case when r = '' then 'ref_document' end, case when nr > 0 then 'ref_produit' end, case when bm > 0 then 'total_ligne_ht' end], lambda x: x is not null), ',') findings from e"""


@register("validate_order", "VAL1", _validation_sql("BC"))
def validate_order(spark, sf_dir):
    return _validated(spark, sf_dir, "BC")


@register("validate_delivery", "VAL2", _validation_sql("BL"))
def validate_delivery(spark, sf_dir):
    return _validated(spark, sf_dir, "BL")


@register("validate_invoice", "VAL3 AGG7", _validation_sql("FACTURE"))
def validate_invoice(spark, sf_dir):
    return _validated(spark, sf_dir, "FACTURE")


@register("date_order", "VAL4 AGG8", """with b as (select l_orderkey job_id, l_shipdate::date dt from lineitem), i as (select o_orderkey job_id, o_orderdate::date + 60 dt from orders where o_orderkey % 5 <> 0),
s as (select o_orderkey job_id, count(case when b.dt < o_orderdate::date + 20 then 1 end)::bigint early_deliveries, max(b.dt) latest, o_orderdate::date + 20 od from orders left join b on b.job_id = o_orderkey group by o_orderkey, o_orderdate)
select s.job_id, early_deliveries, coalesce(i.dt < coalesce(latest, od), false) invoice_early from s left join i using (job_id)""")
def date_order(spark, sf_dir):
    o, li = P.table(spark, sf_dir, "orders"), P.table(spark, sf_dir, "lineitem")
    day = F.col("o_orderdate").cast("date")
    orders = o.select(F.col("o_orderkey").alias("job_id"), F.date_add(day, 20).alias("document_date"))
    invoices = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("job_id"), F.date_add(day, 60).alias("document_date"))
    deliveries = li.select(F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").cast("date").alias("document_date"), F.col("l_linenumber").cast("string").alias("ref"))
    return V.date_warnings(orders, deliveries, invoices)


@register("audit_hourly", "STR3", "select date_trunc('hour', ts) as \"hour\", event_type, count(*)::bigint n from events group by all")
def audit_hourly(spark, sf_dir):
    """The batch form of the stream's windowed counts (a capability beyond the reference)."""
    return audit_counts(P.table(spark, sf_dir, "events"))
