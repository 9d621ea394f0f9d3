"""Queries whose SQL restates a rule from its own constants, or proves a result another way: page grouping, assignments, answers, suppliers, aliases. What is compared is written out here, not taken from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import guards as G
from ledgerloom.functions.similarity import pair_score_columns
from ledgerloom.operators import assignment as A
from ledgerloom.operators import documents as D
from ledgerloom.operators import review as R
from ledgerloom.operators import suppliers as S
from ledgerloom.plans import projection as P
from ledgerloom.registry import register
from ledgerloom.sources import sinks
from ledgerloom.sources.scratch import folder
from ledgerloom.streaming import jobs

_ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
_SEQ = "row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice)"


def _str(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _sequence() -> F.Column:
    return F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))


# Page grouping ------------------------------------------------------------------------------------------------------
@register("page_groups", "WIN1 FLT9 FLT10 CLS4 AGG10", f"""with recursive s as (
  select l_orderkey job_id, ({_SEQ} - 1)::int page_number, l_partkey % 10 as t, l_suppkey % 4 as r, l_quantity::int % 6 as c, l_linenumber % 3 as v, (l_quantity::int % 5) / 10.0 + 0.4 confidence from lineitem),
p as (select job_id, page_number, confidence::double confidence, case when t < 4 then 'BC' when t < 6 then 'BL' when t < 8 then 'FACTURE' when t = 8 then 'UNKNOWN' else 'RECEPTION' end as kind,
  case when r = 0 then '' else 'BC-2024-0001' || r end as ref, c = 0 as continues, t in (6, 7) and v = 0 as totals from s),
g as (select distinct job_id, -1 page_number, -1 group_no, false opened, '' as kind, '' as ref, null::double confidence, '' as own from p
  union all select p.job_id, p.page_number, case when p.kind = 'RECEPTION' then g.group_no when j.joins then g.group_no else g.group_no + 1 end,
    case when p.kind = 'RECEPTION' then g.opened else p.kind <> 'UNKNOWN' end, case when p.kind = 'RECEPTION' or j.joins then g.kind else p.kind end,
    case when p.kind = 'RECEPTION' or (j.joins and g.ref <> '') then g.ref else p.ref end, p.confidence, p.kind
  from g join p on p.job_id = g.job_id and p.page_number = g.page_number + 1,
    lateral (select g.opened and p.kind <> 'UNKNOWN' and p.kind <> 'RECEPTION' and ((p.kind = g.kind and (p.continues or (p.ref <> '' and (g.ref = '' or g.ref = p.ref)))) or (p.totals and g.kind in ('BC', 'BL'))) as joins) j)
select job_id, group_no, any_value(kind) doc_type, string_agg(page_number::varchar, ',' order by page_number) pages, arg_max(ref, page_number) as ref, min(confidence) confidence from g where page_number >= 0 and own <> 'RECEPTION' group by job_id, group_no""")
def page_groups(spark, sf_dir):
    """A page for every line of an order: with and without a reference, marked as a continuation in three ways or not, and invoices that hold an order's totals, an
    invoice's mark beside them, or neither. References and marks are read from the text."""
    t, r, c, v = F.col("l_partkey") % 10, F.col("l_suppkey") % 4, F.col("l_quantity").cast("int") % 6, F.col("l_linenumber") % 3
    kind = F.when(t < 4, "BC").when(t < 6, "BL").when(t < 8, "FACTURE").when(t == 8, "UNKNOWN").otherwise("RECEPTION")
    mark = F.when(c == 0, F.when(v == 0, "Page 2 sur 3").when(v == 1, "*suite*").otherwise("2 / 3")).otherwise("corps")
    totals = F.when(v == 0, "Net hors taxes").when(v == 1, "Net hors taxes, facture n°").otherwise("a regler")
    text = F.concat_ws("\n", mark, F.when(r == 0, "sans").otherwise(F.concat(F.lit("bc-2024-0001"), _str(r))), totals)
    at = P.table(spark, sf_dir, "lineitem").withColumn("page_number", (_sequence() - 1).cast("int")).withColumn("text", text)
    at = at.select(F.col("l_orderkey").alias("job_id"), "page_number", kind.alias("doc_type"), ((F.col("l_quantity").cast("int") % 5) / 10 + 0.4).alias("confidence"), F.lit(1).alias("tier"), D.reference_hint(F.col("text")).alias("ref"), "text")
    return D.group_pages(at).select("job_id", "group_no", "doc_type", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "ref", "confidence")


@register("printed_order", "WIN6", """with p as (select o_orderkey doc_id, unnest(range(0, 3))::int page_number from orders)
select doc_id, page_number, case when doc_id % 4 = 0 then 3 - page_number else page_number + 1 end::int place from p""")
def printed_order(spark, sf_dir):
    """Three pages an order. Every fourth order has its printed numbers reversed; of the others the middle page has none, a number within a word, or a word that
    ends like the mark."""
    o = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("page_number"))
    k = F.col("doc_id") % 4
    own = _str(3 - F.col("page_number"))
    text = F.when((k == 0) | (F.col("page_number") != 1), F.concat(F.lit("x\nPage . "), own)).when(k == 1, "sans numero").when(k == 2, "PAGE 2B").otherwise("HOMEPAGE 2")
    return D.printed_order(o.withColumn("text", text)).select("doc_id", "page_number", "place")


# Assignments --------------------------------------------------------------------------------------------------------
_CONTESTED = f"""l as (select l_orderkey job_id, ({_SEQ})::int idx, (l_partkey % 4)::int n, (l_suppkey % 4)::int k, (l_partkey % 2)::int base, (l_linenumber % 2)::int other, (l_quantity::int % 3)::int price, (l_quantity::int % 2)::int cost from lineitem),
scores as (select b.job_id, b.idx i, d.idx j, least(1.0, sc + case when sc > 0 and b.price = d.cost then 0.05 else 0 end)::double score from l b join l d on b.job_id = d.job_id and d.idx <> 4,
  lateral (select case when b.base <> d.other then 0 when greatest(b.n, d.k) = 0 then 1.0 when greatest(b.n, d.k) = 1 then 0.85 when greatest(b.n, d.k) = 2 then 0.65 else 0 end::double sc) x)"""


@register("contested_assignment", "JN1 JN2 JN3", f"""with recursive {_CONTESTED},
size as (select job_id, max(i) n, count(distinct j) m from scores group by job_id),
best as (select job_id, 0 as i, 0::bigint used, 0.0::double total from size union all
  select job_id, i, used, max(total) from (
    select b.job_id, b.i + 1 as i, case when s.j is null then b.used else b.used | (1::bigint << s.j) end used, b.total + coalesce(s.score, 0) total
    from best b join size z on z.job_id = b.job_id and b.i < z.n join (select job_id, i, j, score from scores union all select distinct job_id, i, null::int, null::double from scores) s on s.job_id = b.job_id and s.i = b.i + 1
      and (s.j is null or b.used & (1::bigint << s.j) = 0)) group by job_id, i, used)
select z.job_id, round(max(total), 6)::double total, true as optimal from best b join size z on z.job_id = b.job_id and b.i = z.n group by z.job_id""")
def contested_assignment(spark, sf_dir):
    """Jobs with equal and near references on both sides, a price bonus that decides, and sides of unlike length. The SQL finds the greatest total over all
    assignments by subsets of the document lines; here every assignment is also proved by its potentials, against scores made from the pairs themselves."""
    at = P.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), _sequence().alias("idx"), (F.col("l_partkey") % 4).alias("n"), (F.col("l_suppkey") % 4).alias("k"), (F.col("l_partkey") % 2).alias("base"),
        (F.col("l_linenumber") % 2).alias("other"), (F.col("l_quantity").cast("int") % 3).alias("price"), (F.col("l_quantity").cast("int") % 2).alias("cost"),
    )
    # ten distinct characters, the first n of them strange: 100 - 10 n of them in common with a line of fewer strange ones
    whole = lambda b: F.when(b == 0, "ABCDEFGHIJ").otherwise("KLMNOPQRST")
    ref = lambda b, n, strange: F.concat(F.repeat(F.lit(strange), n.cast("int")), F.substring(whole(b), n + 1, F.lit(10)))
    none = F.lit(None).cast("string")
    bc = at.select("job_id", F.lit("BC").alias("side"), "idx", ref(F.col("base"), F.col("n"), "7").alias("ref"), F.lit("").alias("description"), (F.col("price") * 10 + 5).alias("price"), none.alias("alias_target"))
    doc = at.where("idx <> 4").select("job_id", F.lit("FACTURE").alias("side"), "idx", ref(F.col("other"), F.col("k"), "8").alias("ref"), F.lit("").alias("description"), (F.col("cost") * 10 + 5).alias("price"), none.alias("alias_target"))
    proof = A.assignment_proof(bc.unionByName(doc))
    d = doc.select("job_id", "side", F.col("idx").alias("doc_idx"), F.col("ref").alias("ref_d"), F.col("price").alias("price_d"))
    pairs = bc.select("job_id", F.col("idx").alias("bc_idx"), "ref", "price").join(d, "job_id")
    scored = pairs.select("ref", "ref_d").distinct().withColumn("s", pair_score_columns("ref", F.lit(""), "ref_d", F.lit("")))
    near = F.abs(F.col("price") - F.col("price_d")) / ((F.col("price") + F.col("price_d")) / 2) <= 0.01
    score = F.when((F.col("s.confidence") > 0) & near, F.least(F.lit(1.0), F.col("s.confidence") + 0.05)).otherwise(F.col("s.confidence"))
    scores = pairs.join(scored, ["ref", "ref_d"]).select("job_id", "side", "bc_idx", "doc_idx", score.alias("score"))
    return A.optimality(proof, scores).select("job_id", F.round("total", 6).alias("total"), "optimal")


# Answers of external extraction -------------------------------------------------------------------------------------
def _answer(k: F.Column, n: int, declared: int | None = None, key: str = "ref_bc") -> F.Column:
    line = '{"ref_produit": "P10", "qty": "2", "prix_unitaire": "5"}'
    count = "" if declared is None else f', "line_count_in_document": {declared}'
    return F.concat(F.lit(f'{{"{key}": "bc-'), _str(k), F.lit(f'"{count}, "lines": [{", ".join([line] * n)}]}}'))


@register("external_answers", "EXT10 EXT11 EXT14 AGG14", """with c(k, used, tries, n_lines) as (values (0, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (3, 2, 1, 1), (5, 2, 1, 3), (6, 2, 1, 1), (7, 2, 1, 2), (8, 4, 1, 2), (9, 2, 2, 1), (12, 2, 2, 1), (13, 1, 1, 1), (14, 2, 1, 1), (15, 3, 1, 2))
select o_orderkey doc_id, 'BC-' || o_orderkey ref_document, used::int used, tries::int tries, n_lines::int n_lines from orders join c on k = o_orderkey % 17""")
def external_answers(spark, sf_dir):
    """Answers in the order of the calls, by kind: plain, fenced, after a braced note, none at first, never (4), too few lines once, too few lines again, fewer lines than references, all guards
    in turn, without its own reference, empty (10), no object (11), a stray brace that leaves an inner object, a brace in quotes, a fence without its end, two guards, and answers that run out (16)."""
    k = F.col("o_orderkey")
    one, two, three = (_answer(k, n) for n in (1, 2, 3))
    note, few = F.lit("{note}"), _answer(k, 1, 3)
    cases = [
        [one], [F.concat(F.lit("```json\n"), one, F.lit("\n```"))], [F.concat(F.lit("voici {x} puis "), one, F.lit(" fin"))], [note, one], [note, F.lit("rien")], [few, _answer(k, 3, 3)], [few, few], [one, two],
        [_answer(k, 1, 2), note, _answer(k, 1, 2), _answer(k, 2, 2)], [F.lit('{"lines": []}'), one], [F.lit("{}"), one], [F.lit("[1, 2]"), one], [F.concat(F.lit("texte } "), one), one],
        [F.concat(F.lit('dit "{" puis '), one)], [F.concat(F.lit('une "citation sans fin '), one), one], [few, one, two], [few],
    ]
    answers = F.element_at(F.array(*[F.array(*c) for c in cases]), (k % len(cases) + 1).cast("int"))
    text = F.when((k % len(cases)).isin(7, 8, 15), "P1000001 et P1000002, P1000001").otherwise("p1000001")
    docs = P.table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.lit("BC").alias("kind"), text.alias("text"), answers.alias("answers"))
    return D.mapped_external(docs).select("doc_id", "ref_document", "used", "tries", F.size("lines").alias("n_lines"))


@register("external_lines", "EXT12 EXT13 NUM4", """select o_orderkey doc_id, 'FAC-' || o_orderkey ref_document, strftime(o_orderdate, '%d/%m/%Y') as "day", 1234.5::double total_ht, 'vis m8' designation, 5.0::double price,
  case o_orderkey % 4 when 1 then 'P/10' when 2 then 'P1É0' else 'P10' end ref_produit, case o_orderkey % 4 when 0 then 1.0 when 3 then 0.5 else 0.4 end::double confidence, o_orderkey % 4 <> 0 low, o_orderkey % 4 in (1, 2) noted from orders""")
def external_lines(spark, sf_dir):
    """Invoices of external extraction: trailing dashes and dots at designations, references with other characters, confidences that are absent, too large or no numbers."""
    k = F.col("o_orderkey")
    c = k % 4
    line = F.concat(
        F.lit('{"designation": " vis m8 —… -", "qty": 2, "prix_unitaire": "5000", "total_ligne_ht": 10, "ref_produit": "'), F.when(c == 1, "P/10").when(c == 2, "P1É0").otherwise("P10"),
        F.lit('"'), F.when(c == 1, ', "ref_confidence": 0.9').when(c == 2, ', "ref_confidence": "haut"').when(c == 3, ', "ref_confidence": "haut", "designation_confidence": 1.5').otherwise(', "ref_confidence": null'), F.lit("}"),
    )
    answer = F.concat(F.lit('{"ref_facture": " fac-'), _str(k), F.lit('", "total_ht": "1 234,5", "document_date": "'), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit('", "lines": ['), line, F.lit(', {"designation": "Mme Martin"}]}'))
    orders = P.spread(P.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    docs = orders.select(k.alias("doc_id"), F.lit("FACTURE").alias("kind"), F.lit("").alias("text"), F.array(answer).alias("answers"))
    out = D.mapped_external(docs).select("*", F.explode("lines").alias("x"))
    return out.select(
        "doc_id", "ref_document", F.date_format("document_date", "dd/MM/yyyy").alias("day"), F.col("total_ht").cast("double").alias("total_ht"), "x.designation", F.col("x.prix_unitaire").cast("double").alias("price"), "x.ref_produit",
        F.col("x.line_confidence").alias("confidence"), F.col("x.has_low_confidence").alias("low"), F.col("x.note").isNotNull().alias("noted"),
    )


# Suppliers ----------------------------------------------------------------------------------------------------------
_BUYERS = ("acme achats",)


def _letters(spark, sf_dir) -> DataFrame:
    """Seven kinds of letter heads, four lines each: doc_id, line_no, line."""
    k = F.col("s_suppkey")
    kinds = [
        ("FOURNISSEUR : ", F.upper("s_name"), "ligne"), (F.concat(F.lit("Vendeur: Boulons "), _str(k)), "ligne deux", "ligne"), ("Bonjour", "ligne deux", F.concat(F.lit("GRANDE MAISON "), _str(k))), ("BON DE COMMANDE", "SARL", "ligne"),
        ("Fournisseur: ACME ACHATS", "ACME ACHATS", "MAISON BLEUE"), ("Vendeur :", "ab", "Raison sociale - Forges du Nord."), ("N° 12 BETA", "ligne deux", "ligne"),
    ]
    col = lambda x: x if isinstance(x, F.Column) else F.lit(x)
    each = F.array(*[F.array(col(a), col(b), F.concat(F.lit("Client: Acme "), _str(k)), col(c)) for a, b, c in kinds])
    text = F.element_at(each, (k % len(kinds) + 1).cast("int"))
    return P.table(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.posexplode(text).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("line_no"), "line")


@register("issuer_names", "SUP1 SUP2 FLT15", """select s_suppkey doc_id, 'ISSUER' as role, case s_suppkey % 7 when 0 then upper(s_name) when 1 then 'Boulons ' || s_suppkey when 2 then 'GRANDE MAISON ' || s_suppkey else 'MAISON BLEUE' end as name,
  case when s_suppkey % 7 < 2 then 0.8 else 0.55 end::double confidence, case when s_suppkey % 7 < 2 then 1 else 4 end::int line_no from supplier where s_suppkey % 7 in (0, 1, 2, 4)
union all select s_suppkey, 'ISSUER', 'FOURNISSEUR :', 0.55::double, 1 from supplier where s_suppkey % 7 = 0 union all select s_suppkey, 'RECIPIENT', 'Acme ' || s_suppkey, 0.75::double, 3 from supplier union all select s_suppkey, 'RECIPIENT', 'SARL', 0.75::double, 1 from supplier where s_suppkey % 7 = 3""")
def issuer_names(spark, sf_dir):
    """A title and a single word are no issuers, nor is a known buyer; a name of two characters is none."""
    return S.roles(_letters(spark, sf_dir), _BUYERS).select("doc_id", "role", "name", "confidence", "line_no")


@register("supplier_choice", "SUP1 SUP3 SRT6", """select s_suppkey doc_id, case s_suppkey % 7 when 0 then upper(s_name) when 1 then 'Boulons ' || s_suppkey when 2 then 'GRANDE MAISON ' || s_suppkey when 4 then 'MAISON BLEUE' when 5 then 'ab' || chr(10) || 'Client' else 'N° 12 BETA' end as name,
  case s_suppkey % 7 when 5 then 'LABEL' when 6 then 'CAPITALS' else 'ROLE' end found_by from supplier where s_suppkey % 7 <> 3""")
def supplier_choice(spark, sf_dir):
    return S.supplier_names(_letters(spark, sf_dir), _BUYERS)


@register("column_layout", "SUP5", """select s_suppkey doc_id, 2 line_no, case when s_suppkey % 2 = 0 then 'Désignation   Qté   P.U' else 'P.U  Qté  Total  Article' end detected_header,
  case when s_suppkey % 2 = 0 then 'designation:0,qty:14,prix_unitaire:20' else 'prix_unitaire:0,qty:5,total_ligne:10,designation:17,ref_produit:17' end as columns from supplier""")
def column_layout(spark, sf_dir):
    """The line with most columns, the first of two; places of the first words of the vocabularies."""
    head = F.when(F.col("s_suppkey") % 2 == 0, "  Désignation   Qté   P.U ").otherwise("P.U  Qté  Total  Article")
    head = F.trim(head)
    text = F.array(F.lit("qte pu bonjour"), head, head, F.col("s_name"))
    lines = P.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.posexplode(text).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("line_no"), "line")
    shown = F.array_join(F.transform(F.array_sort(F.transform("columns", lambda c: F.struct(c["x_position"].alias("x"), c["name"].alias("name")))), lambda c: F.concat(c["name"], F.lit(":"), c["x"].cast("string"))), ",")
    return S.column_layout(lines).select("doc_id", "line_no", "detected_header", shown.alias("columns"))


_GEN = """array_to_string(list_transform(regexp_extract_all(token, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]'), lambda p: case when regexp_matches(p, '^[0-9]+$') then '\\d{' || len(p) || '}' when regexp_matches(p, '^[A-Za-z]{1,3}$') then p
  when regexp_matches(p, '^[A-Za-z]+$') then '[A-Z]{1,' || len(p) || '}' else '\\' || p end), '')"""


@register("pattern_mining", "AGG11 NRM13 SRT8", f"""with t as (select l_suppkey supplier, string_agg(case l_linenumber % 5 when 0 then 'ref-' || (l_partkey % 40) when 1 then 'bolt' || (l_partkey % 30) || 'a' when 2 then '123-45A' when 3 then 'ab/12 x9' else 'P' || lpad((l_partkey % 60)::varchar, 9, '0') end, ' ' order by l_orderkey, l_linenumber, l_partkey, l_quantity) as text from lineitem group by 1),
w as (select supplier, unnest(tokens) token, generate_subscripts(tokens, 1) pos from (select supplier, regexp_extract_all(upper(text), '\\b([A-Z]{{1,6}}[\\-\\.]?[A-Z0-9]{{2,}}(?:[\\-\\.][A-Z0-9]+)*)\\b') tokens from t)),
s as (select supplier, token, count(*) n, min(pos) pos from w where regexp_matches(token, '[0-9]') and len(token) between 4 and 20 group by all having count(*) >= 2), g as (select supplier, {_GEN} pattern, sum(n)::bigint n, min(pos) pos from s group by all)
select supplier, pattern, n, place from (select *, row_number() over (partition by supplier order by n desc, pos)::int place from g) where place <= 8""")
def pattern_mining(spark, sf_dir):
    """A text a supplier, of tokens with letters first, digits first, slashes and lower case."""
    k, part = F.col("l_linenumber") % 5, F.col("l_partkey")
    token = (
        F.when(k == 0, F.concat(F.lit("ref-"), _str(part % 40))).when(k == 1, F.concat(F.lit("bolt"), _str(part % 30), F.lit("a"))).when(k == 2, "123-45A").when(k == 3, "ab/12 x9")
        .otherwise(F.concat(F.lit("P"), F.lpad(_str(part % 60), 9, "0")))
    )
    each = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", token.alias("t"))))
    texts = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.array_join(F.transform(each, lambda x: x["t"]), " ").alias("text"))
    return S.mine_patterns(texts, "supplier")


@register("header_keywords", "AGG12 SRT8", """with w as (select doc_id, unnest(words) word, generate_subscripts(words, 1) pos from (select doc_id, list_filter(regexp_extract_all(upper(replace(substr(text, 1, 500), 'ß', 'SS')), '[\\p{L}\\p{N}_]+'), lambda x: regexp_matches(x, '^[A-ZÀ-Ÿ]{3,20}$')) words from (select doc_id, 'Facture date net ' || text as text from documents))),
c as (select doc_id, word, count(*)::bigint n, min(pos) pos from w group by all)
select doc_id, word, n, place from (select *, row_number() over (partition by doc_id order by n desc, pos)::int place from c) where place <= 15 and word not in ('BON', 'DE', 'COMMANDE', 'LIVRAISON', 'FACTURE', 'DATE', 'REF', 'REFERENCE', 'TOTAL', 'TVA', 'HT', 'TTC', 'PRIX', 'QTE', 'DESIGNATION', 'ARTICLE', 'MONTANT', 'NET')""")
def header_keywords(spark, sf_dir):
    """Generic words take places of the 15 and then go."""
    text = F.concat(F.lit("Facture date net "), F.col("text"))
    return S.header_keywords(P.table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id").select("doc_id", "word", "n", "place")


@register("visible_refs", "AGG14", """with x as (select o_orderkey job_id, 'ref P' || lpad((o_custkey % 97)::varchar, (6 + o_orderkey % 3)::int, '0') || ' et AB12-34 et 2024AB, xP1234567 BOLT' || (1000 + o_orderkey) || ' abc1234 P' || lpad((o_custkey % 97)::varchar, (6 + o_orderkey % 3)::int, '0') as t from orders)
select job_id, len(list_distinct(list_concat(regexp_extract_all(t, '\\b[A-Z]\\d{6,}\\b'), regexp_extract_all(t, '\\b[A-Z]{2,4}\\d{4,}\\b'))))::int n from x""")
def visible_refs(spark, sf_dir):
    own = F.lpad(_str(F.col("o_custkey") % 97), 8, "0")
    own = F.substring(own, F.lit(3) - (F.col("o_orderkey") % 3).cast("int"), F.lit(8))
    t = F.concat(F.lit("ref P"), own, F.lit(" et AB12-34 et 2024AB, xP1234567 BOLT"), _str(F.col("o_orderkey") + 1000), F.lit(" abc1234 P"), own)
    return P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), S.visible_references(t).alias("n"))


@register("mined_aliases", "JN21", f"""with l as (select {_SEQ} as idx, 3 + l_partkey % 8 as kept, l_suppkey % 4 = 0 as same from lineitem)
select 'P' || idx internal_ref, 'X' || idx external_ref, max(10.0 * kept)::double score, count(*)::bigint n from l where idx % 3 <> 2 and kept >= 5 and not same group by idx""")
def mined_aliases(spark, sf_dir):
    """Descriptions of one letter, of which the invoice keeps three to ten of ten, in words of another order: the ratio is 10 a letter kept for the line's own and 0 for others. Every third line is
    too dear, and some have the same reference on both sides."""
    at = P.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), _sequence().alias("ord"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), (F.col("l_partkey") % 8 + 3).cast("int").alias("kept"), (F.col("l_suppkey") % 4 == 0).alias("same")
    )
    letter, own = F.char(F.lit(97) + F.col("ord")), F.concat(F.lit("P"), _str("ord"))
    columns = ("job_id", "ord", "ref", "designation", "qty", "price")
    orders = at.withColumn("ref", own).withColumn("designation", F.upper(F.repeat(letter, F.lit(10)))).select(*columns)
    dear = F.when(F.col("ord") % 3 == 2, F.col("price") + 0.5).otherwise(F.col("price") + 0.01)
    text = F.concat(F.repeat(letter, F.col("kept")), F.repeat(F.lit("9"), 10 - F.col("kept")))
    invoices = at.withColumn("price", dear).withColumn("ref", F.when(F.col("same"), own).otherwise(F.concat(F.lit("x "), _str("ord")))).withColumn("designation", text).select(*columns)
    return S.mine_aliases(orders, invoices)


# Guards and aliases -------------------------------------------------------------------------------------------------
@register("cleanup_flags", "FLT5 FLT6 NRM10", """with t as (select p_partkey id, p_partkey % 12 as c, p_name, p_size from part),
w as (select id, case c when 0 then '"bl' || id || '"' when 1 then 'ab' || (10 + id % 90) || 'cdef' when 2 then '2025-06-' || (10 + id % 20) when 3 then 'le 30/06/2025' when 4 then p_name when 5 then '6 576,' || lpad((id % 1000)::varchar, 3, '0') when 6 then 'code tva ' || id when 7 then 'x@y.tn' when 8 then '12 X ' || p_size
  when 9 then 'd1sque' when 10 then 'Art.' || id else 'bc suite' end token, case when id % 2 = 0 then 'MANUAL' else 'MODEL' end source from t),
v as (select *, lower(regexp_replace(token, '"', '', 'g')) v from w),
h as (select *, regexp_matches(v, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}') or regexp_matches(v, '^\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}$') or regexp_matches(v, '^\\d{4}[/-]\\d{1,2}[/-]\\d{1,2}$') or (regexp_matches(v, '^[\\d\\s.,]+$') and regexp_matches(v, '\\d'))
  or regexp_matches(v, '\\b(bl|bc|fa|fac|fact|facture)[-_/]?\\s*\\d+') or regexp_matches(v, '\\b(mf|m\\.f)\\s*[:\\-/]?\\s*[0-9]') or regexp_matches(v, '\\b(matricule\\s+fiscal|mat\\s+fiscal|code\\s+tva|c\\.?tva)\\b.*[0-9]') or regexp_matches(v, '\\d+\\s*[xX*]\\s*\\d+')
  or (regexp_matches(v, '\\d') and regexp_matches(v, '[/_\\-=]')) hard from v)
select id, token, hard, hard or (source <> 'MANUAL' and regexp_matches(v, '[0-9]') and (regexp_matches(v, '[/_.+\\-=]') or (regexp_matches(v, '[a-z]') and len(regexp_replace(v, '[^a-z0-9]', '', 'g')) >= 4))) generated from h""")
def cleanup_flags(spark, sf_dir):
    """Words and codes of twelve kinds, one of them decided by each rule."""
    k = F.col("p_partkey")
    kinds = [
        F.concat(F.lit('"bl'), _str(k), F.lit('"')), F.concat(F.lit("ab"), _str(10 + k % 90), F.lit("cdef")), F.concat(F.lit("2025-06-"), _str(10 + k % 20)), F.lit("le 30/06/2025"), F.col("p_name"), F.concat(F.lit("6 576,"), F.lpad(_str(k % 1000), 3, "0")),
        F.concat(F.lit("code tva "), _str(k)), F.lit("x@y.tn"), F.concat(F.lit("12 X "), _str("p_size")), F.lit("d1sque"), F.concat(F.lit("Art."), _str(k)), F.lit("bc suite"),
    ]
    token, source = F.element_at(F.array(*kinds), (k % 12 + 1).cast("int")), F.when(k % 2 == 0, "MANUAL").otherwise("MODEL")
    return P.table(spark, sf_dir, "part").select(k.alias("id"), token.alias("token"), G.is_hard_protected(token).alias("hard"), G.looks_generated(token, source).alias("generated"))


@register("alias_candidates", "FLT16 FLT17 FLT18", "with " + P.LINES + """,
c as (select o.job_id, o.ord, o.ref internal, case when o.h <> 9 then f.ref end invoice_ref, b.ref || case when o.h in (9, 10) then 'B' else '' end delivery_ref, (o.ord % 5 = 0) applied, o.qty bq, b.qty lq, f.qty + case when o.h = 11 then 0.4 else 0 end fq, o.price_m bp, f.price_m fp,
  case o.h % 4 when 0 then 'MATCH' when 1 then 'LOW_CONFIDENCE' when 2 then 'PARTIAL_MATCH' else 'MISMATCH' end verdict, case when o.h = 8 then 1 else 0 end bad from orders_ o left join fac f on f.job_id = o.job_id and f.ord = o.ord left join bl b on b.job_id = o.job_id and b.ord = o.ord and b.doc_ord = 1),
e as (select *, coalesce(invoice_ref, '') <> '' inv, coalesce(nullif(invoice_ref, ''), delivery_ref, '') ext from c)
select job_id, ord, coalesce(verdict in ('LOW_CONFIDENCE', 'PARTIAL_MATCH', 'MATCH') and bad = 0 and internal <> '' and ext <> '' and case when inv then bq = fq and abs(bp - fp) <= 100 else bq is not null and lq is not null end, false) safe,
  coalesce(ext <> '' and ext <> internal and verdict in ('LOW_CONFIDENCE', 'PARTIAL_MATCH', 'MATCH') and bad = 0 and not applied and case when inv then bq = fq and abs(bp - fp) <= 100 else bq = lq end, false) shown,
  coalesce(ext <> '' and not applied and case when inv then bq = floor(fq) else bq = lq end, false) listed, coalesce(ext <> '' and not applied, false) relaxed from e""")
def alias_candidates(spark, sf_dir):
    """The candidates of the server, of the review page and of the list, for every order line: invoice or delivery references, unlike and equal ones, applied and not, parts of a unit."""
    bc = P.order_lines(spark, sf_dir)
    fac = P.invoice_lines(bc).select("job_id", "ord", F.col("ref").alias("f_ref"), F.col("qty").alias("f_qty"), F.col("price_m").alias("f_price"))
    bl = P.delivery_lines(bc).where("doc_ord = 1").select("job_id", "ord", F.col("ref").alias("b_ref"), F.col("qty").alias("b_qty"))
    at, h = bc.join(fac, ["job_id", "ord"], "left").join(bl, ["job_id", "ord"], "left"), F.col("h")
    invoice, delivery = F.when(h != 9, F.col("f_ref")), F.concat("b_ref", F.when(h.isin(9, 10), "B").otherwise(""))
    verdict = F.when(h % 4 == 0, "MATCH").when(h % 4 == 1, "LOW_CONFIDENCE").when(h % 4 == 2, "PARTIAL_MATCH").otherwise("MISMATCH")
    bad, applied = F.when(h == 8, 1).otherwise(0), F.col("ord") % 5 == 0
    dec = lambda c: c.cast("decimal(18,4)")
    bq, lq, fq = dec(F.col("qty")), dec(F.col("b_qty")), dec(F.col("f_qty") + F.when(h == 11, F.lit(0.4).cast("decimal(4,1)")).otherwise(F.lit(0).cast("decimal(4,1)")))
    bp, fp = P.dec("price_m"), P.dec("f_price")
    by_invoice = F.coalesce(invoice != "", F.lit(False))
    other = F.when(by_invoice, invoice).otherwise(F.coalesce(delivery, F.lit("")))
    return at.select(
        "job_id", "ord", G.safe_alias_candidate(verdict, bad, F.col("ref"), other, by_invoice, bq, F.when(by_invoice, fq).otherwise(lq), bp, fp).alias("safe"),
        G.shown_alias_candidate(verdict, bad, F.col("ref"), invoice, delivery, applied, bq, lq, fq, bp, fp).alias("shown"),
        G.listed_alias_candidate(F.col("ref"), invoice, delivery, applied, bq, lq, fq).alias("listed"), G.listed_alias_candidate(F.col("ref"), invoice, delivery, applied, bq, lq, fq, relaxed=True).alias("relaxed"),
    )


_EVIDENCE = "e as (select l_suppkey supplier_key, l_returnflag || (l_partkey % 23) pattern, l_orderkey doc_id, min(l_linenumber) pos from lineitem group by all), n as (select *, row_number() over (partition by supplier_key, pattern order by doc_id) n from e)"


def _evidence(spark, sf_dir) -> DataFrame:
    return P.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier_key"), F.concat("l_returnflag", _str(F.col("l_partkey") % 23)).alias("pattern"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"))


@register("pattern_promotion", "AGG13", f"""with {_EVIDENCE}, p as (select supplier_key, pattern, max(n)::bigint documents, arg_max(doc_id, n = 3) promoted_by, arg_max(pos, n = 3) pos from n group by all having max(n) >= 3)
select supplier_key, pattern, documents, promoted_by, place from (select *, row_number() over (partition by supplier_key order by promoted_by, pos, pattern)::int place from p) where place <= 12""")
def pattern_promotion(spark, sf_dir):
    """Patterns in the order in which documents promote them."""
    return S.promoted_patterns(_evidence(spark, sf_dir))


@register("raised_confidence", "AGG13", f"""with {_EVIDENCE}, p as (select supplier_key, pattern, arg_max(doc_id, n = 3) d, arg_max(pos, n = 3) pos from n group by all having max(n) >= 3), k as (select supplier_key, pattern, row_number() over (partition by supplier_key order by d, pos, pattern) <= 12 kept from p)
select supplier_key, count(distinct doc_id)::bigint changes, least(1.0, round(0.4 + 0.05 * count(distinct doc_id), 9))::double confidence from n join k using (supplier_key, pattern) where n = 3 or (n > 3 and not kept) group by 1""")
def raised_confidence(spark, sf_dir):
    return S.raised_confidence(_evidence(spark, sf_dir))


# Review -------------------------------------------------------------------------------------------------------------
@register("rematched", "VRD9", f"""with l as (select l_orderkey job_id, ({_SEQ} - 1)::int idx from lineitem), j as (select job_id, count(*)::bigint n from l group by 1)
select job_id, 'COMPLETED' status, n total_lines, case when job_id % 2 = 0 then 'REJECTED' else 'VALIDATED' end previous_verdict, case when job_id % 4 = 2 then 'REJECTED' when job_id % 5 = 0 then 'REVIEW' else 'VALIDATED' end by_edits, case when (job_id % 4 = 2 and job_id % 3 = 0) or (job_id % 2 = 0 and job_id % 3 <> 0) then 'REJECTED' when job_id % 5 = 0 then 'REVIEW' else 'VALIDATED' end by_json,
  case when job_id % 4 = 2 then 'REJECTED' when job_id % 5 = 0 then 'REVIEW' else 'VALIDATED' end <> case when job_id % 2 = 0 then 'REJECTED' else 'VALIDATED' end changed from j""")
def rematched(spark, sf_dir):
    """Jobs matched again from what was saved: invoices whose JSON has a wrong price for even jobs, corrected since in the rows of every fourth job, JSON that is broken for every third, and a
    delivery that names another order in every fifth."""
    at = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), (_sequence() - 1).alias("idx"), F.col("l_quantity").cast("decimal(18,4)").alias("qty"), (F.floor("l_extendedprice") + 1).cast("decimal(18,4)").alias("price"))
    k = F.col("job_id")

    def lines(price: F.Column) -> F.Column:
        none = F.lit(None)
        return F.struct(
            (F.col("idx") + 1).cast("int").alias("line_number"), F.repeat(F.char(F.lit(65) + F.col("idx")), F.lit(8)).alias("ref_produit"), none.cast("string").alias("designation"), F.col("qty"), price.cast("decimal(18,4)").alias("prix_unitaire"),
            none.cast("decimal(9,4)").alias("tva_rate"), none.cast("decimal(18,4)").alias("total_ligne_ht"), F.lit(1.0).alias("extraction_confidence"),
        )

    first = F.col("idx") == 0
    wrong = F.when(first & (k % 2 == 0), F.col("price") + 5).otherwise(F.col("price"))
    corrected = F.when(first & (k % 4 == 2), F.col("price") + 5).otherwise(F.col("price"))
    docs, rows = [], []
    for i, (kind, key, in_json, in_rows) in enumerate((("BC", "ref_bc", F.col("price"), F.col("price")), ("BL", "ref_bl", F.col("price"), F.col("price")), ("FACTURE", "ref_facture", wrong, corrected))):
        own = F.concat(F.lit("BC-2024-") if kind == "BC" else F.lit(f"{kind}-"), F.lpad(_str(k), 8, "0"))
        linked = F.when((k % 5 == 0) & F.lit(kind == "BL"), "BC-XXXX-YYYYYYYY").otherwise(F.concat(F.lit("BC-2024-"), F.lpad(_str(k), 8, "0")))
        json = F.to_json(F.struct(own.alias(key), linked.alias("ref_bc_linked"), F.col("lines")))
        per = at.groupBy("job_id").agg(F.array_sort(F.collect_list(lines(in_json))).alias("lines"))
        docs.append(per.select("job_id", F.lit(i).alias("doc_id"), F.lit(kind).alias("doc_type"), F.when((k % 3 == 0) & F.lit(kind == "FACTURE"), "{broken").otherwise(json).alias("raw"), own.alias("ref_document"), linked.alias("ref_bc_linked"), F.lit(None).cast("decimal(18,4)").alias("total_ht"), F.lit(None).cast("decimal(9,4)").alias("tva_rate")))
        rows.append(at.select("job_id", F.lit(i).alias("doc_id"), lines(in_rows).alias("x")).select("job_id", "doc_id", "x.*"))
    documents, edited = docs[0].unionByName(docs[1]).unionByName(docs[2]), rows[0].unionByName(rows[1]).unionByName(rows[2])
    none = F.lit(0).cast("long")
    saved = at.select("job_id").distinct().select("job_id", F.lit("COMPLETED").alias("status"), F.when(k % 2 == 0, "REJECTED").otherwise("VALIDATED").alias("global_verdict"), *[none.alias(f"{c}_count") for c in ("match", "mismatch", "missing", "extra", "low_confidence")], none.alias("total_lines"))
    by_edits, by_json = R.rematch(documents, edited, saved), R.rematch(documents, edited, saved, source="raw")
    return by_edits.join(by_json.select("job_id", F.col("global_verdict").alias("by_json")), "job_id").select("job_id", "status", "total_lines", "previous_verdict", F.col("global_verdict").alias("by_edits"), "by_json", "changed")


@register("source_quality", "AGG16", """with p as (select o_custkey job_id, case o_orderkey % 3 when 0 then 'BC' when 1 then 'BL' else 'FACTURE' end doc_type, (o_orderkey % 11) / 10.0 c, case o_orderkey % 4 when 0 then 'NATIVE' when 1 then 'TRANSCRIPTION' else 'OCR' end s, (o_orderkey % 7) / 10.0 o from orders)
select job_id, doc_type, round(avg(floor(c * 100 + 0.5)), 6)::double classification_pct, round(avg(case when s = 'OCR' then floor(o * 100 + 0.5) else 100 end), 6)::double ocr_pct, array_to_string(list_sort(list(distinct s)), ',') sources from p group by all""")
def source_quality(spark, sf_dir):
    """Confidences of classification and recognition by job and type of document, and the sources of its pages."""
    k = F.col("o_orderkey")
    pages = P.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job_id"), F.when(k % 3 == 0, "BC").when(k % 3 == 1, "BL").otherwise("FACTURE").alias("doc_type"), ((k % 11) / 10).alias("confidence"),
        F.when(k % 4 == 0, "NATIVE").when(k % 4 == 1, "TRANSCRIPTION").otherwise("OCR").alias("ocr_source"), ((k % 7) / 10).alias("ocr_confidence"),
    )
    out = R.source_quality(pages)
    return out.select("job_id", "doc_type", F.round("classification_pct", 6).alias("classification_pct"), F.round("ocr_pct", 6).alias("ocr_pct"), F.array_join("sources", ",").alias("sources"))


# Streams ------------------------------------------------------------------------------------------------------------
@register("stream_upserts", "STR2 SNK5", """select l_partkey part, arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity))::double qty, max((l_orderkey, l_linenumber))[1]::bigint order_key from lineitem group by l_partkey""")
def stream_upserts(spark, sf_dir):
    """Lines read as a stream of files; a key that comes in several batches ends once, with its last line."""
    at = folder(spark, "upserts")
    li = P.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").cast("double").alias("qty"))
    li.repartition(5, "order_key").write.parquet(f"{at}/in")
    schema = "part long, order_key long, line int, qty double"
    stream = jobs.file_stream(spark, f"{at}/in", schema, 2)
    assert jobs.finished(jobs.upserts(stream, f"{at}/out", f"{at}/checkpoint", ["part"], ["order_key", "line", "qty"], 16))
    return sinks.current_rows(spark, f"{at}/out", schema).select("part", "qty", "order_key")


@register("stream_profiles", "STR4 AGG13", f"""with {_EVIDENCE}, p as (select supplier_key, pattern, arg_max(doc_id, n = 3) promoted_by, arg_max(pos, n = 3) pos from n group by all having max(n) >= 3)
select supplier_key::varchar supplier_key, pattern, 3::bigint documents, promoted_by, place from (select *, row_number() over (partition by supplier_key order by promoted_by, pos, pattern)::int place from p) where place <= 12""")
def stream_profiles(spark, sf_dir):
    """The same evidence as a stream of files in the order of the documents, promoted by keyed state."""
    at = folder(spark, "profiles")
    e = _evidence(spark, sf_dir)
    low, high = e.agg(F.min("doc_id"), F.max("doc_id")).first()
    for i in range(3):
        part = F.floor((F.col("doc_id") - low) * 3 / (high - low + 1)) == i
        e.where(part).repartition(1).write.mode("append").parquet(f"{at}/in")
    stream = jobs.file_stream(spark, f"{at}/in", "supplier_key long, pattern string, doc_id long, pos int", 1)
    assert jobs.finished(jobs.profiles(stream, f"{at}/out", f"{at}/checkpoint"))
    return spark.read.parquet(f"{at}/out").where("pattern is not null").select("supplier_key", "pattern", "documents", "promoted_by", "place")
