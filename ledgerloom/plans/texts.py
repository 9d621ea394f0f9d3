"""Queries over normalisers, guards, the dictionary and suppliers: registry entries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import guards as G
from ledgerloom.functions import text as X
from ledgerloom.operators import dictionary as D
from ledgerloom.operators import suppliers as S
from ledgerloom.plans import projection as P
from ledgerloom.registry import register
from ledgerloom.sources.scratch import apart

ACCENT = f"translate({{}}, '{X.ACCENTED}', '{X.PLAIN}')"
FOLD = "replace(replace(replace(replace(replace(" + ACCENT + ", 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE'), 'ß', 'ss')"


def _fold(x: str) -> str:
    return FOLD.format(x)


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_REFS = """r as (select l_orderkey job_id, l_linenumber line, ' p' || lpad(l_partkey::varchar, 9, '0') || case l_linenumber % 5 when 0 then '-o' || l_quantity::int when 1 then '/S'
  when 2 then 'é ' when 3 then ' 1l' || l_linenumber else '' end raw from lineitem)"""


def _refs(spark, sf_dir) -> DataFrame:
    n = F.col("l_linenumber") % 5
    tail = (
        F.when(n == 0, F.concat(F.lit("-o"), F.col("l_quantity").cast("int").cast("string"))).when(n == 1, "/S").when(n == 2, "é ")
        .when(n == 3, F.concat(F.lit(" 1l"), F.col("l_linenumber").cast("string"))).otherwise("")
    )
    return P.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.concat(F.lit(" p"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), tail).alias("raw")
    )


_OCR = """list_reduce(list_transform(range(1, len(s) + 1), lambda i: case when regexp_matches(coalesce(s[i - 1], '') || coalesce(s[i + 1], ''), '[0-9OolISBGZ]')
  then translate(s[i], 'OolISBGZ', '00115862') else s[i] end), lambda a, b: a || b)"""


@register("ref_normalize", "NRM6", f"with {_REFS} select job_id, line, regexp_replace(upper(trim(raw)), '[^A-Z0-9]', '', 'g') \"key\" from r")
def ref_normalize(spark, sf_dir):
    return _refs(spark, sf_dir).select("job_id", "line", X.match_key("raw").alias("key"))


@register("ocr_numeric_fix", "NRM1 NRM2", f"with {_REFS}, t as (select distinct raw, replace(raw, ' ', '') s from r) select raw, upper(trim({_OCR})) fixed from t")
def ocr_numeric_fix(spark, sf_dir):
    return _refs(spark, sf_dir).select("raw").distinct().select("raw", X.reference("raw").alias("fixed"))


@register("desc_normalize", "NRM7", f"select doc_id, trim(regexp_replace(lower({_fold('text')}), '[^a-z0-9 ]', '', 'g'), ' ') description from documents")
def desc_normalize(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", X.description("text").alias("description"))


_NUMS = """n as (select l_orderkey job_id, l_linenumber line, floor(l_extendedprice)::bigint v, floor(l_extendedprice * 1000)::bigint % 1000 m from lineitem),
f as (select job_id, line, case (job_id + line) % 8 when 0 then v || ',' || lpad(m::varchar, 3, '0') when 1 then v || '.' || lpad(m::varchar, 3, '0') when 2 then (v // 1000) || '.' || lpad((v % 1000)::varchar, 3, '0') || ',50'
  when 3 then (v // 1000) || ',' || lpad((v % 1000)::varchar, 3, '0') || '.5' when 4 then v || ',5 DT' when 5 then '1,' || v || ',000.25' when 6 then (v // 1000) || '.' || lpad((v % 1000)::varchar, 3, '0') || '.000' else '-' || v end raw from n)"""


def _numbers(spark, sf_dir) -> DataFrame:
    v, m = F.floor("l_extendedprice").cast("long"), F.pmod(F.floor(F.col("l_extendedprice") * 1000).cast("long"), F.lit(1000))
    k = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(8))
    s = lambda c: c.cast("string")
    t, r, m3 = s(F.floor(v / 1000).cast("long")), F.lpad(s(F.pmod(v, F.lit(1000))), 3, "0"), F.lpad(s(m), 3, "0")
    raw = (
        F.when(k == 0, F.concat(s(v), F.lit(","), m3)).when(k == 1, F.concat(s(v), F.lit("."), m3)).when(k == 2, F.concat(t, F.lit("."), r, F.lit(",50")))
        .when(k == 3, F.concat(t, F.lit(","), r, F.lit(".5"))).when(k == 4, F.concat(s(v), F.lit(",5 DT"))).when(k == 5, F.concat(F.lit("1,"), s(v), F.lit(",000.25")))
        .when(k == 6, F.concat(t, F.lit("."), r, F.lit(".000"))).otherwise(F.concat(F.lit("-"), s(v)))
    )
    return P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), raw.alias("raw"))


@register("french_number_parse", "NUM1", f"""with {_NUMS}, c as (select *, regexp_replace(raw, '[^0-9.,]', '', 'g') s from f),
k as (select *, len(s) - len(replace(s, ',', '')) c, len(s) - len(replace(s, '.', '')) d, len(regexp_extract(s, ',([0-9]*)$', 1)) a, coalesce(try_cast(regexp_extract(s, '^([0-9]*),', 1) as bigint), 0) w from c)
select job_id, line, raw, try_cast(case when c = 1 and d = 0 then case when a <= 2 or a = 3 and w < 10000 then replace(s, ',', '.') else replace(s, ',', '') end when d = 1 and c = 0 then s
  when c = 1 then replace(replace(s, '.', ''), ',', '.') when d = 1 then replace(s, ',', '')
  else replace(replace(substr(s, 1, greatest(len(s) - len(regexp_extract(s, '[.,][0-9]*$')), 0)), '.', ''), ',', '') || replace(regexp_extract(s, '[.,][0-9]*$'), ',', '.') end as decimal(24, 6))::double as value from k""")
def french_number_parse(spark, sf_dir):
    return _numbers(spark, sf_dir).select("job_id", "line", "raw", X.number("raw").cast("double").alias("value"))


@register("date_normalize", "NRM4", """with d as (select o_orderkey job_id, o_orderdate::date v from orders), r as (select job_id, v, case job_id % 6 when 0 then strftime(v, '%d/%m/%Y') when 1 then strftime(v, '%d-%m-%Y') when 2 then strftime(v, '%d.%m.%Y')
  when 3 then strftime(v, '%Y-%m-%d') when 4 then strftime(v, '%d/%m/%y') else strftime(v, '%d/%m/%Y') || ' 10:30' end raw from d)
select job_id, raw, v parsed from r""")
def date_normalize(spark, sf_dir):
    v, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    shown = lambda f: F.date_format(v, f)
    raw = (
        F.when(k == 0, shown("dd/MM/yyyy")).when(k == 1, shown("dd-MM-yyyy")).when(k == 2, shown("dd.MM.yyyy")).when(k == 3, shown("yyyy-MM-dd"))
        .when(k == 4, shown("dd/MM/yy")).otherwise(F.concat(shown("dd/MM/yyyy"), F.lit(" 10:30")))
    )
    return P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), raw.alias("raw")).withColumn("parsed", X.date("raw"))


_NOISE = ", ".join(_lit(w) for w in X.SUPPLIER_NOISE)


@register("supplier_name_key", "NRM8 SRT3", f"""with n as (select s_suppkey, case s_suppkey % 3 when 0 then 'Sté ' || s_name || ' S.A.R.L' when 1 then 'Ets. ' || s_name || ' Tunisie' else 'SARL' end raw from supplier),
t as (select *, regexp_extract_all(upper({_fold('raw')}), '[A-Z0-9]+') a from n), k as (select *, list_filter(a, lambda x: x not in ({_NOISE})) b from t)
select s_suppkey, raw, array_to_string(case when len(b) > 0 then b else a end, '') "key" from k""")
def supplier_name_key(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("Sté "), "s_name", F.lit(" S.A.R.L"))).when(k == 1, F.concat(F.lit("Ets. "), "s_name", F.lit(" Tunisie"))).otherwise("SARL")
    return P.table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw")).select("s_suppkey", "raw", X.supplier_key("raw").alias("key"))


_TOKENS = """w as (select distinct unnest(regexp_extract_all(text, '[^ \\n\\t\\r]+')) token from documents union select 'P' || lpad(p_partkey::varchar, 6, '0') from part
  union select p_partkey || 'x' || p_size || 'X10' from part union select '12/0' || (p_size % 9 + 1) || '/2024' from part union select p_brand || '/' || p_type from part)"""


def _tokens(spark, sf_dir) -> DataFrame:
    docs = P.table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([^ \\n\\t\\r]+)"), 1)).alias("token"))
    p = P.table(spark, sf_dir, "part")
    s = lambda c: F.col(c).cast("string")
    more = p.select(F.explode(F.array(
        F.concat(F.lit("P"), F.lpad(s("p_partkey"), 6, "0")), F.concat(s("p_partkey"), F.lit("x"), s("p_size"), F.lit("X10")),
        F.concat(F.lit("12/0"), (F.col("p_size") % 9 + 1).cast("string"), F.lit("/2024")), F.concat("p_brand", F.lit("/"), "p_type"),
    )).alias("token"))
    return apart(docs.unionByName(more).distinct())


# Written out for the SQL, not taken from the guards that it checks.
_CODES = (
    r"^[A-Za-z]{1,6}\d{2,}$", r"^\d{2,}[A-Za-z]{1,6}$", r"^[A-Za-z0-9]{3,}[-/_.*+x×][A-Za-z0-9]", r"\d+[xX×*]\d+", r"[A-Za-z]+/[A-Za-z]+", r"^\d{6,}$", r"(?i)^[A-Z]{2,6}[-/]\d{2,4}[-/]\d{2,8}$",
)
_PLAIN = (r"^\s*[\d\s]+[,.]?\d{0,3}\s*$", r"\d{7}[/\-][A-Z][/\-][A-Z][/\-][A-Z][/\-]\d{3}", r"[\w.+-]+@[\w.-]+\.\w+", r"[A-Z]{2}\d{2}[\dA-Z]{4,}")
_DAY = r"\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}"


def _sql_code(v: str) -> str:
    any_ = " or ".join(f"regexp_matches({v}, {_lit(p)})" for p in _CODES)
    bare = f"regexp_replace({v}, '[-/.]', '', 'g')"
    return (
        f"((regexp_matches({v}, '[A-Za-z]') and regexp_matches({v}, '[0-9]') and len(replace({v}, ' ', '')) between 4 and 25 and (({any_}) or (len({bare}) between 3 and 15 "
        f"and len({v}) - len(replace({v}, ' ', '')) <= 2 and len(regexp_replace({bare}, '[^0-9]', '', 'g')) >= 0.30 * len({bare})))) or regexp_matches({v}, '\\d+[xX×*]\\d+') or regexp_matches({v}, '[A-Za-z]+/[A-Za-z]+'))"
    )


def _sql_protected(v: str) -> str:
    return f"({_sql_code(v)} or (regexp_matches({v}, {_lit(_DAY)}) and len({v}) <= 12) or " + " or ".join(f"regexp_matches({v}, {_lit(p)})" for p in _PLAIN) + ")"


_ALNUM = "len(regexp_replace(token, '[^A-Za-z0-9]', '', 'g'))"
_WORD = f"{_ALNUM} >= 2 and regexp_matches(token, '[A-Za-z]') and not ({_ALNUM} <= 10 and regexp_matches(token, '[0-9]') and len(regexp_replace(token, '[^0-9]', '', 'g')) > 0.40 * {_ALNUM})"


@register("protected_values", "FLT1 FLT2", f"with {_TOKENS} select token, {_sql_code('token')} code, {_sql_protected('token')} protected from w")
def protected_values(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return t.select("token", G.looks_like_code("token").alias("code"), G.is_protected("token").alias("protected"))


@register("dictionary_candidates", "FLT3", f"""with {_TOKENS} select token from w where not {_sql_protected('token')} and {_WORD}""")
def dictionary_candidates(spark, sf_dir):
    return _tokens(spark, sf_dir).where(G.is_dictionary_candidate("token")).select("token")


@register("ocr_noise_tokens", "FLT8", f"with {_TOKENS} select token from w where len(token) <= 1 or len(regexp_replace(token, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 0.40 * len(token)")
def ocr_noise_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).where(G.is_noise("token"))


_WORDS = "seedw as (select p_partkey as ord, unnest(string_split(p_name, ' ')) raw, upper(split_part(p_type, ' ', 1)) kind, case p_size % 3 when 0 then 'PRODUCT' when 1 then 'BRAND' else 'OTHER' end category from part)"


def _seed_words(spark, sf_dir) -> DataFrame:
    cat = F.when(F.col("p_size") % 3 == 0, "PRODUCT").when(F.col("p_size") % 3 == 1, "BRAND").otherwise("OTHER")
    return P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.explode(F.split("p_name", " ")).alias("raw"), cat.alias("category"))


@register("seed_union", "DIC1 SET3 NRM9", f"with {_WORDS}, k as (select lower(trim(raw)) raw_form, upper(raw) canonical_form, category, ord from seedw where trim(raw) <> '') select raw_form, min(canonical_form) canonical_form, min(ord)::bigint as ord from k group by raw_form")
def seed_union(spark, sf_dir):
    w = _seed_words(spark, sf_dir).select("ord", "raw", F.col("raw").alias("canonical"), "category")
    return D.seed(w).select("raw_form", "canonical_form", "ord")


_PAIRS = ", ".join(f"({_lit(a)}, {_lit(b)})" for a, b in D.VARIANTS)


@register("ocr_variants", "DIC2", f"""with {_WORDS}, k as (select lower(raw) raw_form, arg_min(category, (ord, raw)) category from seedw where raw <> '' group by 1), p as (select * from (values {_PAIRS}) t(a, b)),
v as (select distinct raw_form base, substr(raw_form, 1, instr(raw_form, a) - 1) || b || substr(raw_form, instr(raw_form, a) + len(a)) variant from k, p where contains(raw_form, a)),
t as (select base, variant, variant as token from v where variant <> base and len(variant) >= 3)
select base, variant from t where not {_sql_protected('token')} and {_WORD}""")
def ocr_variants(spark, sf_dir):
    w = _seed_words(spark, sf_dir).select(F.lower("raw").alias("raw_form"), F.upper("raw").alias("canonical_form"), F.lit("PRODUCT").alias("category")).where("raw_form <> ''").distinct()
    return D.ocr_variants(w).select("base", "variant").distinct()


_DICT = f"""{_WORDS}, dict as (select lower(raw) raw_form, upper(min(raw)) canonical_form, min(category) category, case when len(lower(raw)) % 3 = 0 then 0.9::double when len(lower(raw)) % 3 = 1 then 0.75::double else 0.6::double end weight,
  case len(lower(raw)) % 4 when 0 then 'MANUAL' when 1 then 'MODEL' else 'FUZZY' end source, (len(lower(raw)) % 5 <> 0) verified, (len(lower(raw)) % 7 = 0) ignored from seedw where raw <> '' group by lower(raw))"""


def _dictionary(spark, sf_dir) -> DataFrame:
    w = _seed_words(spark, sf_dir).where("raw <> ''").groupBy(F.lower("raw").alias("raw_form")).agg(F.upper(F.min("raw")).alias("canonical_form"), F.min("category").alias("category"))
    n = F.length("raw_form")
    return w.select(
        "raw_form", "canonical_form", "category", F.when(n % 3 == 0, 0.9).when(n % 3 == 1, 0.75).otherwise(0.6).alias("weight"),
        F.when(n % 4 == 0, "MANUAL").when(n % 4 == 1, "MODEL").otherwise("FUZZY").alias("source"), (n % 5 != 0).alias("verified"), (n % 7 == 0).alias("ignored"), F.lit(None).cast("string").alias("supplier_id"), F.lit(0).alias("usage_count"),
    )


@register("dictionary_stats", "AGG15", f"""with {_DICT} select 'total' kind, '' as value, count(*)::bigint n, sum((not verified)::int)::bigint unverified, sum(ignored::int)::bigint ignored from dict
union all select 'source', source, count(*)::bigint, sum((not verified)::int)::bigint, sum(ignored::int)::bigint from dict group by source
union all select 'category', category, count(*)::bigint, sum((not verified)::int)::bigint, sum(ignored::int)::bigint from dict group by category""")
def dictionary_stats(spark, sf_dir):
    return D.statistics(_dictionary(spark, sf_dir))


@register("dictionary_exact", "JN17", f"with {_DICT} select w.raw, d.canonical_form, d.weight from (select distinct raw from seedw where raw <> '') w join dict d on lower(w.raw) = d.raw_form where d.verified and not d.ignored and d.weight > 0.7")
def dictionary_exact(spark, sf_dir):
    words = _seed_words(spark, sf_dir).where("raw <> ''").select("raw").distinct()
    return words.join(D.usable(_dictionary(spark, sf_dir)), X.dictionary_key("raw") == F.col("raw_form")).select("raw", "canonical_form", "weight")


@register("dictionary_fuzzy", "JN18", f"""with {_DICT}, longer as (select * from dict union all select raw_form || repeat(raw_form, 8), canonical_form, category, weight, source, verified, ignored from dict),
m as (select distinct substr(raw_form, 1, 2) || 'q' || substr(raw_form, 4) as k from longer),
p as (select k, raw_form, canonical_form, weight, levenshtein(k, raw_form) d from m join longer on verified and not ignored and k is not null where levenshtein(k, raw_form) <= 2)
select k "key", count(*)::bigint near, min(d)::int nearest from p group by k""")
def dictionary_fuzzy(spark, sf_dir):
    """The candidates of the fuzzy lookup, which SQL can check; its scores are tested against brute force."""
    d = _dictionary(spark, sf_dir)
    d = d.unionByName(d.withColumn("raw_form", F.concat("raw_form", F.repeat("raw_form", F.lit(8)))))
    k = F.concat(F.substring("raw_form", 1, 2), F.lit("q"), F.substring("raw_form", 4, 1000))
    return D.near_entries(d.select(k.alias("key")).distinct(), D.verified(d)).groupBy("key").agg(F.count(F.lit(1)).alias("near"), F.min("distance").alias("nearest"))


@register("dictionary_correct", "DIC3 JN17 JN18")
def dictionary_correct(spark, sf_dir):
    noisy = _seed_words(spark, sf_dir).select(F.when(F.col("ord") % 3 == 0, F.translate("raw", "ol", "01")).when(F.col("ord") % 3 == 1, F.concat("raw", F.lit("e"))).otherwise(F.col("raw")).alias("token"))
    return D.correct_tokens(noisy, _dictionary(spark, sf_dir))


@register("dictionary_upsert", "DIC8 SNK5", f"""with {_DICT}, o as (select * from dict where len(raw_form) % 2 = 0), n as (select raw_form, canonical_form || 'X' canonical_form, category, least(1.0::double, weight + case when ascii(raw_form) % 2 = 0 then 0.2::double else -0.2::double end) weight, 'MODEL' source, true verified, ignored from dict where ascii(raw_form) % 3 <> 0),
j as (select coalesce(o.raw_form, n.raw_form) raw_form, o.canonical_form oc, n.canonical_form nc, o.weight ow, n.weight nw, o.source os, o.verified ov, n.verified nv, (o.raw_form is not null and o.source = 'MANUAL') man from o full join n on o.raw_form = n.raw_form)
select raw_form, case when nc is not null and (oc is null or (not man and (nw > ow or (nv and not ov)))) then nc else oc end canonical_form,
  case when oc is null then nw when nc is null or man then ow else greatest(ow, nw) end weight, case when oc is null then nv when nc is null or man then ov else ov or nv end verified from j""")
def dictionary_upsert(spark, sf_dir):
    d = _dictionary(spark, sf_dir)
    shift = F.when(F.ascii("raw_form") % 2 == 0, 0.2).otherwise(-0.2)
    new = d.where(F.ascii("raw_form") % 3 != 0).select(
        "raw_form", F.concat("canonical_form", F.lit("X")).alias("canonical_form"), "category", F.least(F.lit(1.0), F.col("weight") + shift).alias("weight"),
        F.lit("MODEL").alias("source"), F.lit(True).alias("verified"), "ignored", "supplier_id",
    )
    return D.upsert(d.where("length(raw_form) % 2 = 0"), new).select("raw_form", "canonical_form", "weight", "verified")


@register("dictionary_insert", "SNK6 SET4", f"with {_DICT} select raw_form from dict where raw_form not in (select raw_form from dict where len(raw_form) % 2 = 0)")
def dictionary_insert(spark, sf_dir):
    d = _dictionary(spark, sf_dir)
    return D.absent(d.where("length(raw_form) % 2 = 0"), d).select("raw_form")


@register("renormalize_diff", "DIC4 DIC5 DIC11")
def renormalize_diff(spark, sf_dir):
    p = P.table(spark, sf_dir, "part")
    lines = p.select(F.col("p_partkey").alias("line_item_id"), F.upper("p_name").alias("designation"), F.translate("p_name", "o", "0").alias("raw_designation"))
    return D.renormalised(lines, _dictionary(spark, sf_dir), prefer_raw=True)


@register("confusion_candidates", "DIC12 SRT8", None)
def confusion_candidates(spark, sf_dir):
    words = _seed_words(spark, sf_dir).where("raw <> ''").select("raw").distinct()
    return words.select("raw", F.array_join(D.confusion_candidates(F.col("raw")), ",").alias("candidates"))


@register("broken_spaces", "NRM11", "select doc_id, len(trim(regexp_replace(regexp_replace(replace(text, ', ', '- '), '([\\p{L}\\p{N}_])-\\s+([\\p{L}\\p{N}_])', '\\1\\2', 'g'), ' {2,}', ' ', 'g'), ' '))::int n from documents")
def broken_spaces(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", F.length(X.join_broken(F.replace("text", F.lit(", "), F.lit("- ")))).alias("n"))


_SUPPLIED = """d as (select doc_id, case when doc_id % 4 = 0 then text || ' ' || (select min(s_name) from supplier where s_suppkey = 1 + doc_id % 10) else text end as text from documents)"""


@register("supplier_contains", "JN15", f"with {_SUPPLIED} select doc_id, min(s_name) supplier_name from d join supplier on contains(upper({_fold('text')}), upper({_fold('s_name')})) group by doc_id")
def supplier_contains(spark, sf_dir):
    sup = P.table(spark, sf_dir, "supplier")
    named = sup.select((F.col("s_suppkey") - 1).alias("k"), "s_name")
    docs = P.table(spark, sf_dir, "documents").join(named, (F.col("doc_id") % 4 == 0) & (F.col("doc_id") % 10 == F.col("k")), "left")
    texts = docs.select("doc_id", F.concat_ws(" ", "text", "s_name").alias("text"))
    return S.containing_supplier(texts, sup.select(F.col("s_name").alias("name"), F.array("s_name").alias("identifiers")))


@register("supplier_profiles", "JN16 SUP4")
def supplier_profiles(spark, sf_dir):
    """One letter a supplier, scored against every profile."""
    sup = P.table(spark, sf_dir, "supplier")
    profiles = sup.select(
        F.col("s_name").alias("name"), F.lit("").alias("siret"), F.lit("").alias("vat_number"), F.array(F.upper("s_name")).alias("name_aliases"),
        F.array(F.lit("FACTURE"), F.lit("LIVRAISON")).alias("keywords"), F.array(F.lit(r"[A-Z]{2}-\d{4}")).alias("ref_patterns"),
    )
    text = F.concat(F.lit("Facture BC-2024 "), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).otherwise(F.lit("")))
    texts = sup.select(F.col("s_suppkey").alias("doc_id"), text.alias("text"), F.lit(None).cast("string").alias("detected_name"))
    return S.profile_scores(texts, profiles).withColumn("action", S.detection(F.col("score"), F.lit("X")))
