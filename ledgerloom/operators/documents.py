"""Pages to documents: scan facts, classification, grouping, header extraction and line tables.

Ordered logic (grouping, word rows) is a fold over the ordered array of one document's pages or words with aggregate();
such arrays are bounded by the page limit. Nothing here is a UDF except the reading of JSON out of free text.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import guards as G
from ledgerloom.functions import text as X

# Fixed values -------------------------------------------------------------------------------------------------------
KEYWORDS = {
    "BC": (r"\bBON\s+DE\s+COMMANDE\b", r"\bBON\s+COMMANDE\b", r"\bCOMMANDE\s+N[°o]\b", r"\bN[°o]\s*BC[-\s]\d", r"\bBC[-/]\d{4}", r"\bPURCHASE\s+ORDER\b"),
    "BL": (r"\bBON\s+DE\s+LIVRAISON\b", r"\bBON\s+LIVRAISON\b", r"\bLIVRAISON\s+N[°o]\b", r"\bN[°o]\s*BL[-\s]\d", r"\bBL[-/]\d{4}", r"\bDELIVERY\s+NOTE\b", r"\bBORDEREAU\s+DE\s+LIVRAISON\b"),
    "FACTURE": (r"\bFACTURE\b", r"\bFACTURE\s+N[°o]\b", r"\bN[°o]\s*FAC[-\s]\d", r"\bFAC[-/]\d{4}", r"\bINVOICE\b", r"\bAVOIR\b", r"\bFACT\s+N[°o]\b"),
    "RECEPTION": (
        r"\bRECEPTION\b", r"\bR[ÉE]CEPTION\b", r"\bBON\s+DE\s+R[ÉE]CEPTION\b", r"\bQT[OÔ]\s+R[OÔ]CEPT\b", r"\bQT[EÉ]\s+R[EÉ]CEPT\b", r"\bQT[OÔ]\s+BON\s+LIVR\b",
        r"\bORDRE\s+D[''E]ACHAT\s*:", r"\bR[OÔ]CEPTION\s*:", r"\bDATE\s+RE[ÇCOO]U\b", r"\bEXP[OÔ]DI[OÔ]\s+LE\b",
    ),
}
REF_HINTS = (
    r"(?:N[°o]?\s*)?BC[-\s/]?\d{2,4}[-\s/]?\d{2,6}", r"(?:N[°o]?\s*)?BL[-\s/]?\d{2,4}[-\s/]?\d{2,6}", r"(?:N[°o]?\s*)?FAC[-\s/]?\d{2,4}[-\s/]?\d{2,6}",
    r"(?:N[°o]?\s*)?FACT[-\s/]?\d{2,4}[-\s/]?\d{2,6}", r"\d{4}[-/]\d{3,6}",
)
HEADERS = {
    "ref_bc": (r"(?:N[°o]?\s*(?:BC|BON\s*DE\s*COMMANDE))\s*[:\-]?\s*([A-Z0-9\-/]{3,30})", r"(?:COMMANDE\s*N[°o]?)\s*[:\-]?\s*([A-Z0-9\-/]{3,30})", r"(BC[-/]\d{2,4}[-/]\d{2,8})"),
    "ref_bl": (r"(?:N[°o]?\s*(?:BL|BON\s*DE\s*LIVRAISON))\s*[:\-]?\s*([A-Z0-9\-/]{3,30})", r"(?:LIVRAISON\s*N[°o]?)\s*[:\-]?\s*([A-Z0-9\-/]{3,30})", r"(BL[-/]\d{2,4}[-/]\d{2,8})"),
    "ref_facture": (
        r"(?:N[°o]?\s*(?:FAC(?:TURE)?|FACTURE|FT))\s*[:\-]?\s*([A-Z0-9\-/]{3,30})", r"(?:FACTURE\s*N[°o]?)\s*[:\-]?\s*([A-Z0-9\-/]{3,30})",
        r"(FT[-/]?\d{2}[-/]\d{4,8})", r"(FAC[-/]\d{2,4}[-/]\d{2,8})",
    ),
    "ref_bc_linked": (r"(?:BC|BON\s*DE\s*COMMANDE|REF\s*BC)\s*[:\-]?\s*([A-Z0-9\-/]{3,30})", r"(BC[-/]\d{2,4}[-/]\d{2,8})"),
    "date": (r"(?:DATE|LE|DU)\s*[:\-]?\s*(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})", r"(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})"),
    "total_ht": (r"(?:TOTAL\s*H\.?\s*T\.?|MONTANT\s*HT|TOTAL\s*HORS\s*TAXES)\s*[:\-]?\s*([\d\s.,]+)",),
    "total_ttc": (r"(?:TOTAL\s*T\.?\s*T\.?\s*C\.?|MONTANT\s*TTC|NET\s*À\s*PAYER)\s*[:\-]?\s*([\d\s.,]+)",),
    "tva_rate": (r"(?:TVA|T\.V\.A\.)\s*(?:@|À|A|:)?\s*(\d{1,2}(?:[.,]\d{1,2})?)\s*%", r"(\d{1,2}(?:[.,]\d{1,2})?)\s*%\s*(?:TVA|T\.V\.A\.)"),
}
TABLE_HEADERS = {
    "ref_produit": (r"R[ÉE]F[.\s]*(?:PRODUIT|ART|ARTICLE)?", r"CODE\s*(?:ARTICLE|PRODUIT)?", r"R[ÉE]F\.?"),
    "designation": (r"D[ÉE]SIGNATION", r"LIBELL[ÉE]", r"DESCRIPTION", r"ARTICLE"),
    "qty": (r"(?:QT[ÉE]|QUANTIT[ÉE]|QTE|NB)\b", r"QT[ÉE]\.?"),
    "unit": (r"UNIT[ÉE]", r"U\.?M\.?", r"MESURE"),
    "prix_unitaire": (r"PRIX\s*U(?:NIT\.?)?(?:\s*H\.?T\.?)?", r"P\.?\s*U\.?\s*H\.?T\.?", r"P\.?U\.?"),
    "tva_rate": (r"T\.?V\.?A\.?", r"TVA\s*%"),
    "total_ligne_ht": (r"TOTAL\s*H\.?T\.?", r"MONTANT\s*H\.?T\.?", r"TOTAL\s*LIGNE"),
}
HIT, MISS = 0.85, 0.0
RULE_AT, EXTERNAL_AT = 0.90, 0.70
NATIVE_CHARS, NATIVE_COVERAGE = 50, 0.3
TRANSCRIBE_BELOW = 0.70
MAX_BYTES, MAX_PAGES = 50 * 1024 * 1024, 50
PRINTED_PAGE = r"(?iU)\bPAGE\s*[:\.]?\s*(\d+)\b"
TRAILING = r"(?U)[\s—\-\.…]+$"
ODD_REFERENCE = r"[^A-Za-z0-9\-]"
# --------------------------------------------------------------------------------------------------------------------


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def accepted_upload(name: Column, content: Column, n_pages: Column) -> Column:
    """SRC1."""
    ok = name.endswith(".pdf") & (F.length(content) <= MAX_BYTES) & (F.substring(content, 1, 4) == F.lit(b"%PDF")) & n_pages.between(1, MAX_PAGES)
    return F.coalesce(ok, F.lit(False))


def page_source(char_count: Column, coverage: Column) -> Column:
    """SRC2."""
    return F.when((char_count > NATIVE_CHARS) & (F.least(coverage, F.lit(1.0)) < NATIVE_COVERAGE), "NATIVE").otherwise("SCANNED")


def chosen_text(ocr_text: Column, ocr_confidence: Column, transcription: Column) -> Column:
    """SRC8: struct(text, source)."""
    use = F.coalesce(F.trim(transcription) != "", F.lit(False)) & F.coalesce(ocr_confidence < TRANSCRIBE_BELOW, F.lit(True))
    return F.struct(F.when(use, transcription).otherwise(ocr_text).alias("text"), F.when(use, "TRANSCRIPTION").otherwise("OCR").alias("source"))


def ocr_words(raw: DataFrame) -> DataFrame:
    """SRC10: word rows of parallel arrays (text, conf, left, top, width, height, line_num, block_num, par_num)."""
    names = ("text", "conf", "left", "top", "width", "height", "line_num", "block_num", "par_num")
    keys = [c for c in raw.columns if c not in names]
    rows = raw.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("ord", "w"))
    return rows.where((F.trim("w.text") != "") & (F.col("w.conf") >= 0)).select(
        *keys, "ord", F.trim("w.text").alias("text"), F.col("w.left").alias("x"), F.col("w.top").alias("y"), F.col("w.width").alias("w"), F.col("w.height").alias("h"),
        F.col("w.conf").cast("double").alias("conf"), "w.line_num", "w.block_num", "w.par_num",
    )


def mean_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """SRC5: mean word confidence in [0, 1] and the text in lines."""
    return words.groupBy(*keys).agg((F.avg("conf") / 100).alias("confidence"), F.count(F.lit(1)).alias("n_words"))


def field_confidence(value: Column, words: Column, confs: Column) -> Column:
    """SRC6: mean confidence of the words that equal a field's tokens; 0.5 without input, 0.7 without a hit."""
    tokens = F.split(F.lower(F.trim(value)), r"\s+")
    hits = F.filter(F.arrays_zip(words.alias("t"), confs.alias("c")), lambda z: F.array_contains(tokens, F.lower(z["t"])) & (z["c"] > 0))
    mean = F.aggregate(hits, F.lit(0.0), lambda a, z: a + z["c"]) / F.size(hits) / 100
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", 0.5).when(F.coalesce(F.size(words), F.lit(0)) == 0, 0.5).when(F.size(hits) > 0, mean).otherwise(0.7)


def _fixed(pattern: str) -> str:
    """The longest run of letters that every match of a pattern holds; empty if none is sure."""
    best = run = ""
    for op, value in [*_parser.parse(pattern), (None, None)]:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        best, run = max(best, run, key=len), ""
    return best


def _holds(text: Column, pattern: str) -> Column:
    """Whether a text has what every match of a pattern holds: a search for letters before one for a pattern."""
    fixed = _fixed(pattern)
    return text.contains(fixed) if fixed and "(?" not in pattern else F.lit(True)


def classify(text: Column, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    """CLS1: struct(type, confidence) from keyword rules; the top 40% of the lines weigh more."""
    def scored(v: Column) -> Column:
        each = []
        for i, (kind, patterns) in enumerate(keywords.items()):
            s, guards = F.lit(0.0), [_holds(v["up"], p) for p in patterns]
            for p, guard in zip(patterns, guards):
                s = s + F.when(~guard, 0.0).when(v["top"].rlike("(?U)" + p), 0.40).when(v["up"].rlike("(?U)" + p), 0.15).otherwise(0.0)
            seen = [guard & v["up"].rlike("(?U)" + p) for p, guard in zip(patterns, guards)]
            s = F.when(reduce(Column.__or__, seen), s).otherwise(0.0)  # most classes end here
            each.append(F.struct((-F.least(F.lit(1.0), s)).alias("s"), F.lit(i).alias("i"), F.lit(kind).alias("k")))
        return F.array_sort(F.array(*each))

    def decided(order: Column) -> Column:
        best, second = -order[0]["s"], -order[1]["s"]
        return F.struct(
            F.when(best < 0.15, "UNKNOWN").otherwise(order[0]["k"]).alias("type"),
            F.when(best < 0.15, 0.0).when(best - second < 0.10, best * 0.70).otherwise(best).alias("confidence"),
        )

    up = F.upper(F.coalesce(text, F.lit("")))
    lines = F.split(up, r"\R|[\x0b\x0c\x1c-\x1e]")
    parts = _let(lines, lambda v: F.struct(
        up.alias("up"), F.array_join(F.slice(v, 1, F.greatest(F.lit(1), F.floor(F.size(v) * 4 / 10).cast("int"))), "\n").alias("top")
    ))
    short = F.length(F.trim(F.coalesce(text, F.lit("")))) < 10
    return _let(_let(parts, scored), lambda order: _let(decided(order), lambda d: F.struct(
        F.when(short, "UNKNOWN").otherwise(d["type"]).alias("type"), F.when(short, 0.0).otherwise(d["confidence"]).alias("confidence")
    )))


def cascade(rule: Column, external_type: Column, external_conf: Column, rule_at: float = RULE_AT, external_at: float = EXTERNAL_AT) -> Column:
    """CLS2: struct(type, confidence, tier)."""
    by_label = F.coalesce(external_conf >= external_at, F.lit(False))

    def decided(r: Column) -> Column:
        by_rule = r["confidence"] >= rule_at
        return F.struct(
            F.when(by_rule, r["type"]).when(by_label, external_type).otherwise("UNKNOWN").alias("type"),
            F.when(by_rule, r["confidence"]).when(by_label, external_conf).otherwise(0.0).alias("confidence"),
            F.when(by_rule, 1).when(by_label, 2).otherwise(3).alias("tier"),
        )

    return _let(rule, decided)


def reference_hint(text: Column) -> Column:
    """CLS4."""
    up = F.upper(text)
    found = F.coalesce(*[F.nullif(F.regexp_extract(up, f"({p})", 1), F.lit("")) for p in REF_HINTS])
    return F.coalesce(F.regexp_replace(found, "[ \t]", ""), F.lit(""))


def group_pages(pages: DataFrame) -> DataFrame:
    """WIN1: logical documents of a job's classified pages (job_id, page_number, doc_type, confidence, tier, ref, text).

    RECEPTION pages vanish without closing the open group; UNKNOWN ones close it and stand alone. A page of the group's type joins it if it is marked as a continuation, whatever
    its reference; else if both have the same reference, or only the page has one. A page without one does not join, also where the group has none. An order's
    summary misread as an invoice joins whatever its reference. A group takes the first reference it meets. What a page's text says is two flags
    before the fold, which carries no text. Returns job_id, group_no, doc_type, pages, ref, confidence (min), tier (max)."""
    page = F.struct(
        F.col("page_number").cast("int").alias("page_number"), "doc_type", F.col("confidence").cast("double").alias("confidence"), F.col("tier").cast("int").alias("tier"),
        F.coalesce("ref", F.lit("")).alias("ref"), G.is_continuation("text").alias("continues"), ((F.col("doc_type") == "FACTURE") & G.has_order_totals("text")).alias("totals"),
    )
    per_job = pages.groupBy("job_id").agg(F.array_sort(F.collect_list(page)).alias("p"))
    group = "struct<doc_type:string,pages:array<int>,ref:string,confidence:double,tier:int>"
    start = F.array().cast(f"array<{group}>")

    def fresh(p: Column) -> Column:
        return F.struct(p["doc_type"].alias("doc_type"), F.array(p["page_number"]).alias("pages"), p["ref"].alias("ref"), p["confidence"].alias("confidence"), p["tier"].alias("tier")).cast(group)

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        open_ = F.coalesce(last["doc_type"] != "UNKNOWN", F.lit(False))
        fits = F.when(p["continues"], True).when((p["ref"] != "") & (last["ref"] != ""), p["ref"] == last["ref"]).otherwise(p["ref"] != "")
        same = (last["doc_type"] == p["doc_type"]) & fits
        join = open_ & (p["doc_type"] != "UNKNOWN") & F.coalesce(same | (p["totals"] & last["doc_type"].isin("BC", "BL")), F.lit(False))
        merged = F.struct(
            last["doc_type"].alias("doc_type"), F.concat(last["pages"], F.array(p["page_number"])).alias("pages"), F.when(last["ref"] == "", p["ref"]).otherwise(last["ref"]).alias("ref"),
            F.least(last["confidence"], p["confidence"]).alias("confidence"), F.greatest(last["tier"], p["tier"]).alias("tier"),
        ).cast(group)
        rest = F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))
        return F.when(p["doc_type"] == "RECEPTION", acc).when(join, F.concat(rest, F.array(merged))).otherwise(F.concat(acc, F.array(fresh(p))))

    out = per_job.select("job_id", F.posexplode(F.aggregate("p", start, step)).alias("group_no", "g"))
    return out.select("job_id", "group_no", "g.*")


def printed_order(pages: DataFrame) -> DataFrame:
    """WIN6: pages of a document in the order of their printed numbers, if every page has one; else as they are."""
    no = F.regexp_extract(F.substring("text", 1, 600), PRINTED_PAGE, 1)
    at = pages.withColumn("printed", F.nullif(no, F.lit("")).try_cast("bigint"))
    w = Window.partitionBy("doc_id")
    all_known = F.count("printed").over(w) == F.count(F.lit(1)).over(w)
    key = F.when(all_known, F.col("printed")).otherwise(F.col("page_number"))
    return at.withColumn("place", F.row_number().over(w.orderBy(key, "page_number")))


def header_field(text: Column, patterns: tuple[str, ...]) -> Column:
    """EXT1: struct(value, confidence): the last group of the first pattern that matches upper-cased text."""
    up = F.upper(text)
    found = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(up, "(?m)" + p, 1)), F.lit("")) for p in patterns])
    return F.struct(found.alias("value"), F.when(found.isNotNull(), HIT).otherwise(MISS).alias("confidence"))


def with_aliases(text: Column, aliases: dict[str, str]) -> Column:
    """EXT9: supplier field aliases substituted; the whole text becomes upper-case."""
    out = F.upper(text)
    for other, own in aliases.items():
        out = F.replace(out, F.lit(other.upper()), F.lit(own.upper()))
    return out


def extract_header(docs: DataFrame, kind: str) -> DataFrame:
    """EXT2 (BC), EXT3 (BL), EXT4 (FACTURE): doc_id, ref, date, linked and totals with the template's confidence."""
    f = {k: header_field(F.col("text"), p) for k, p in HEADERS.items()}
    ref = {"BC": "ref_bc", "BL": "ref_bl", "FACTURE": "ref_facture"}[kind]
    needed = [ref, "date"] + (["total_ht", "total_ttc"] if kind == "FACTURE" else [])
    out = docs.select(
        "doc_id", f[ref]["value"].alias("ref_document"), (f["ref_bc_linked"]["value"] if kind != "BC" else F.lit(None).cast("string")).alias("ref_bc_linked"),
        X.date(f["date"]["value"]).alias("document_date"), *[(X.number(f[k]["value"]) if kind == "FACTURE" else F.lit(None).cast(X.NUMBER)).alias(k) for k in ("total_ht", "total_ttc", "tva_rate")],
        F.least(*[f[k]["confidence"] for k in needed]).alias("confidence"),
    )
    return out.where("ref_document is not null") if kind == "BC" else out


def text_line(line: Column) -> Column:
    """EXT5: a text-table line as struct(ref, designation, qty, price, total, tva_rate, confidence); null if no item.

    Parts stand between runs of spaces. Texts are the reference and the designation; the first plausible part with a percent sign is the rate; other numbers are
    quantity, price and total in their order."""
    parts = F.filter(F.transform(F.split(F.trim(line), r"\s{2,}|\t"), lambda p: F.trim(p)), lambda p: p != "")
    numeric = lambda p: F.regexp_replace(F.replace(p, F.lit(","), F.lit(".")), r"[€%\s]", "").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")

    def sorted_out(p: Column) -> Column:
        numbers = F.transform(F.filter(p, numeric), lambda x: F.struct(x.alias("text"), X.number_within(x).alias("value")))
        is_rate = lambda z: F.coalesce(z["text"].contains("%") & (z["value"] > 0) & (z["value"] <= 30), F.lit(False))

        def told(ns: Column) -> Column:
            first = F.array_position(F.transform(ns, is_rate), F.lit(True)).cast("int")
            rest = F.filter(F.transform(F.filter(ns, lambda z, i: i + 1 != first), lambda z: z["value"]), lambda v: v.isNotNull())
            rate = F.when(first > 0, F.try_element_at(ns, F.nullif(first, F.lit(0)))["value"])
            return F.struct(F.size(p).alias("n"), F.filter(p, lambda x: ~numeric(x)).alias("words"), rate.alias("rate"), rest.alias("numbers"))

        return _let(numbers, told)

    def item(v: Column) -> Column:
        at = lambda i: F.try_element_at(v["numbers"], F.lit(i))
        ref = X.safe_reference(F.try_element_at(v["words"], F.lit(1)))
        more = F.slice(v["words"], 2, F.greatest(F.lit(1), F.size(v["words"])))
        known = F.coalesce(ref != "", F.lit(False)) & F.coalesce(at(1) != 0, F.lit(False))
        some = (F.size(v["words"]) > 0) | F.coalesce(at(1) != 0, F.lit(False)) | F.coalesce(at(2) != 0, F.lit(False))
        return F.when((v["n"] >= 2) & some, F.struct(
            ref.alias("ref"), F.when(F.size(v["words"]) > 1, X.squeeze(F.array_join(more, " "))).alias("designation"), at(1).alias("qty"), at(2).alias("price"), at(3).alias("total"),
            v["rate"].alias("tva_rate"), F.when(known, 0.75).otherwise(0.50).alias("confidence"),
        ))

    return F.when(~G.is_skipped_line(line), _let(_let(parts, sorted_out), item))


def text_items(lines: DataFrame) -> DataFrame:
    """WIN5, FLT13, WIN7: items after the first header line. Short lines and lines without digits are passed over before the end of the table is
    looked for, so a caption of totals without a number ends nothing. lines: doc_id, line_no, line."""
    up = F.upper(F.col("line"))
    n_cols = sum((F.when(up.rlike("|".join(ps)), 1).otherwise(0) for ps in TABLE_HEADERS.values()), F.lit(0))
    head = lines.withColumn("__n", n_cols).where("__n >= 3").groupBy("doc_id").agg(F.min("line_no").alias("head"))
    body = lines.join(head, "doc_id").where(F.col("line_no") > F.col("head")).where(~G.is_skipped_line("line"))
    stopped = F.max(G.is_text_footer("line").cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    body = body.withColumn("stopped", stopped).where("stopped = 0").where(F.size(F.filter(F.split(F.trim("line"), r"\s{2,}|\t"), lambda p: F.trim(p) != "")) >= 2)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    body = body.withColumn("line_number", number).select("doc_id", "line_number", F.explode(F.array(text_line(F.col("line")))).alias("item")).where("item is not null")  # computed once
    return body.where(G.valid_product_line(F.col("item.ref"), F.col("item.price"), F.col("item.qty"), F.col("item.designation"))).select("doc_id", "line_number", "item.*")


def spatial_or_text(spatial: DataFrame, text: DataFrame) -> DataFrame:
    """EXT8: the lines of the spatial table of a document, or those of its text table where there are none. Both: doc_id and equal columns."""
    rest = text.join(spatial.select("doc_id").distinct(), "doc_id", "left_anti")
    return spatial.withColumn("by", F.lit("SPATIAL")).unionByName(rest.withColumn("by", F.lit("TEXT")))


_QUOTED_REST, _OUTSIDE = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL), re.compile(r'["{}]')
_FENCES = ((r"(?m)^```(?:json)?\s*", ""), (r"(?m)\s*```$", ""))
_FENCE_ENDS = ((r"(?i)^```(?:json)?\s*\n?", ""), (r"(?i)\n?```\s*$", ""))


def _balanced(text: str):
    """Substrings between an outermost brace and its partner; braces in strings do not count, and a stray closing one takes an opening one with it."""
    depth, start, at = 0, None, 0
    while found := _OUTSIDE.search(text, at):
        at = found.end()
        if found[0] == '"':
            rest = _QUOTED_REST.match(text, at)
            if rest is None:
                return
            at = rest.end()
        elif found[0] == "{":
            start = found.start() if depth == 0 else start
            depth += 1
        else:
            depth -= 1
            if depth == 0 and start is not None:
                yield text[start:at]
                start = None


def _candidates(text: str):
    """What of an answer may be JSON, in the order in which it counts: all of it, all within fences, each balanced part."""
    for pattern, new in _FENCES:
        text = re.sub(pattern, new, text.strip())
    yield text.strip()
    inner = text.strip()
    for pattern, new in _FENCE_ENDS:
        inner = re.sub(pattern, new, inner)
    yield inner.strip()
    yield from _balanced(text)


def read_answer(text: str | None) -> tuple[bool, str | None, int | None, int]:
    """EXT11: whether an answer holds JSON; its first valid JSON if that is an object; the row count that it declares, if a whole number; its lines."""
    for candidate in _candidates(text or ""):
        try:
            value = json.loads(candidate)
        except (ValueError, RecursionError):
            continue
        if not isinstance(value, dict):
            return True, None, None, 0
        declared, lines = value.get("line_count_in_document"), value.get("lines", [])
        whole = isinstance(declared, int) and abs(declared) < 1 << 62
        return True, candidate, int(declared) if whole else None, len(lines) if isinstance(lines, list) else 0
    return False, None, None, 0


ANSWER = "struct<parsed:boolean,object:string,declared:bigint,n_lines:int>"


def _answers(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: [dict(zip(("parsed", "object", "declared", "n_lines"), read_answer(t))) for t in (texts if texts is not None else [])])


def answers_read(texts):
    """EXT11 over a column of answers, an array in the order of the calls; an array of ANSWER."""
    return F.pandas_udf(_answers, f"array<{ANSWER}>")(texts)


def accepted_answer(answers: Column, visible: Column, ref_key: Column) -> Column:
    """EXT10, EXT14: which of a document's answers (array of ANSWER, in the order of the calls) counts: struct(object, used, tries); a null object is a failed extraction.

    Within a try each guard sends back one answer: no JSON; fewer lines than declared; fewer lines than references are visible. Asking again for JSON or
    for lines forgets what the other asked, the references' guard is asked once. What is not an object ends the extraction. An answer without the document's own
    reference can't be mapped: a second try begins with all guards; an empty object ends it. If the answers run out, the extraction failed."""
    state = "struct<json:boolean,line:boolean,ref:boolean,tries:int,used:int,over:boolean,object:string>"

    def now(a: Column, json_: Column, line: Column, ref: Column, tries: Column, over: Column, object_: Column) -> Column:
        return F.struct(json_.alias("json"), line.alias("line"), ref.alias("ref"), tries.alias("tries"), (a["used"] + 1).alias("used"), over.alias("over"), object_.alias("object")).cast(state)

    def step(a: Column, x: Column) -> Column:
        yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("string")
        fewer = F.coalesce((x["declared"] != 0) & (x["n_lines"] < x["declared"]), no)
        mapped = F.array_contains(F.coalesce(F.json_object_keys(x["object"]), F.array()), ref_key)
        return (
            F.when(a["over"], a)
            .when(~x["parsed"] & ~a["json"], now(a, yes, no, a["ref"], a["tries"], no, none))
            .when(x["object"].isNull(), now(a, no, no, no, a["tries"], yes, none))
            .when(~a["line"] & fewer, now(a, no, yes, a["ref"], a["tries"], no, none))
            .when(~a["ref"] & (visible > x["n_lines"]), now(a, no, a["line"], yes, a["tries"], no, none))
            .when(mapped, now(a, no, no, no, a["tries"], yes, x["object"]))
            .when((a["tries"] == 1) & (F.size(F.json_object_keys(x["object"])) > 0), now(a, no, no, no, F.lit(2), no, none))
            .otherwise(now(a, no, no, no, a["tries"], yes, none))
        )

    start = F.struct(*[F.lit(False).alias(k) for k in ("json", "line", "ref")], F.lit(1).alias("tries"), F.lit(0).alias("used"), F.lit(False).alias("over"), F.lit(None).cast("string").alias("object")).cast(state)
    return F.aggregate(answers, start, step, lambda a: F.struct(a["object"].alias("object"), a["used"].alias("used"), a["tries"].alias("tries")))


def polished_line(designation: Column, ref: Column, ref_confidence: Column, issues: Column) -> Column:
    """EXT12: struct(designation, ref, ref_confidence, issues, note). Dashes, dots and space at the designation's end go; a reference with other characters than letters,
    digits and dashes has a confidence of 0.40 at most and a note. Confidences are clamped to [0, 1]; what is no number is 0.5; null stays null."""
    odd = F.coalesce(F.trim(ref).rlike(ODD_REFERENCE), F.lit(False))
    number = F.when(ref_confidence.isNotNull(), F.coalesce(ref_confidence.try_cast("double"), F.lit(0.5)))
    bounded = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    given, capped = F.when(number.isNotNull(), bounded(number)), bounded(F.least(F.lit(0.40), F.coalesce(F.when(number != 0, number), F.lit(1.0))))
    return F.struct(
        F.trim(F.regexp_replace(F.trim(F.coalesce(designation, F.lit(""))), TRAILING, "")).alias("designation"), F.trim(ref).alias("ref"), F.when(odd, capped).otherwise(given).alias("ref_confidence"),
        (F.coalesce(issues, F.lit(False)) | odd).alias("issues"), F.when(odd, F.concat(F.lit("Ref '"), F.trim(ref), F.lit("' contains invalid characters — needs manual review"))).alias("note"),
    )


EXTERNAL = (
    "struct<ref_bc:string,ref_bl:string,ref_facture:string,ref_bc_linked:string,document_date:string,supplier_name:string,total_ht:string,total_ttc:string,tva_rate:string,"
    "lines:array<struct<ref_produit:string,designation:string,qty:string,unit:string,prix_unitaire:string,tva_rate:string,total_ligne_ht:string,"
    "ref_confidence:string,designation_confidence:string,ocr_issues_detected:boolean>>>"
)
REF_KEYS = {"BC": "ref_bc", "BL": "ref_bl", "FACTURE": "ref_facture"}


def mapped_external(docs: DataFrame, patterns: tuple[str, ...] | None = None) -> DataFrame:
    """EXT13: documents from external answers (columns doc_id, kind, text, answers; the answers in the order of the calls); confidence 0.70, tier 3. Texts are those that
    the answers speak of; patterns are a supplier's own references. Documents whose extraction failed are left out."""
    from ledgerloom.operators.suppliers import visible_references

    key = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in REF_KEYS.items()])
    seen = visible_references("text", *([patterns] if patterns else []))
    at = docs.select("doc_id", "kind", key.alias("key"), seen.alias("visible"), answers_read(F.col("answers")).alias("answers"))
    at = at.select("doc_id", "kind", F.explode(F.array(accepted_answer(F.col("answers"), F.col("visible"), F.col("key")))).alias("a"))  # computed once
    at = at.where("a.object is not null").select("doc_id", "kind", "a.used", "a.tries", F.from_json("a.object", EXTERNAL).alias("j"))
    bounded = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v.try_cast("double"), F.lit(0.5))))

    def line(x: Column) -> Column:
        qty, price, total = X.quantity(x["qty"])["value"], X.money(x["prix_unitaire"])["value"], X.money(x["total_ligne_ht"])["value"]
        described = F.when(x["designation_confidence"].isNotNull(), bounded(x["designation_confidence"]))

        def rated(p: Column) -> Column:
            confidence = F.least(F.coalesce(p["ref_confidence"], F.lit(1.0)), F.coalesce(described, F.lit(1.0)), F.when(p["issues"], 0.85).otherwise(1.0))
            return F.struct(p.alias("p"), confidence.alias("c"))

        def made(v: Column) -> Column:
            p, confidence, q = v["r"]["p"], v["r"]["c"], v["q"]
            return F.struct(
                X.safe_reference(p["ref"]).alias("ref_produit"), p["designation"].alias("designation"), x["unit"].alias("unit"), confidence.alias("line_confidence"), q["qty"].alias("qty"),
                X.scale_corrected(q["qty"], q["price"], q["total"]).cast(X.NUMBER).alias("prix_unitaire"), X.normalised_number(x["tva_rate"]).alias("tva_rate"), q["total"].alias("total_ligne_ht"),
                ((confidence < 0.70) | p["issues"]).alias("has_low_confidence"), p["note"].alias("note"),
            )

        polished = _let(polished_line(x["designation"], x["ref_produit"], x["ref_confidence"], x["ocr_issues_detected"]), rated)
        numbers = F.struct(qty.alias("qty"), price.alias("price"), total.alias("total"))
        return _let(F.struct(polished.alias("r"), numbers.alias("q")), made)

    lines = F.filter(F.transform(F.coalesce("j.lines", F.array()), line), lambda x: G.valid_product_line(x["ref_produit"], x["prix_unitaire"], x["qty"], x["designation"]))
    invoice = lambda c: F.when((F.col("kind") == "FACTURE") & (F.col(f"j.{c}") != ""), X.normalised_number(f"j.{c}"))
    return at.select(
        "doc_id", "kind", "used", "tries", X.reference(F.coalesce(*[F.when(F.col("kind") == k, F.col(f"j.{v}")) for k, v in REF_KEYS.items()])).alias("ref_document"),
        F.when(F.col("kind") != "BC", X.safe_reference("j.ref_bc_linked")).alias("ref_bc_linked"), X.date("j.document_date").alias("document_date"), X.squeeze("j.supplier_name").alias("supplier_name"),
        *[invoice(c).alias(c) for c in ("total_ht", "total_ttc", "tva_rate")], F.lit(0.70).alias("extraction_confidence"), F.lit(3).alias("extraction_tier"), lines.alias("lines"),
    )


def attach_pages(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """JN22: the page facts (job_id, page_number and more) of each document group (job_id, group_no, pages), one row a page of the group."""
    return groups.select("job_id", "group_no", F.explode("pages").alias("page_number")).join(pages, ["job_id", "page_number"])


def lines_by_type(lines: DataFrame) -> DataFrame:
    """AGG21: mined lines of each document type."""
    return lines.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


def token_context(text: Column, token: Column, width: int = 5) -> Column:
    """WIN8: the words around the first word that contains a token."""
    words = F.split(text, r"\s+")
    at = F.array_position(F.transform(words, lambda w: w.contains(token)), F.lit(True)).cast("int")
    first = F.greatest(F.lit(1), at - width)
    return F.when(at > 0, F.array_join(F.slice(words, first, at + width - first + 1), " "))
