"""Predicates over tokens, fields, lines and pages as Column -> Column(boolean); no UDFs. Results are never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import _c, cleanup_key, match_key

# Fixed values -------------------------------------------------------------------------------------------------------
PROTECTED_FIELDS = (
    "article_code", "reference", "ref_produit", "ref_produit_normalized", "document_number", "invoice_number", "order_number",
    "delivery_number", "receipt_number", "quantity", "qty", "unit_price", "prix_unitaire", "amount", "amount_ht", "total_ht",
    "total_ttc", "total_ligne_ht", "tax_rate", "tva_rate", "discount_rate", "remise_pct", "fodec", "timbre", "document_date",
    "date", "fiscal_id", "matricule_fiscal", "rib", "phone", "email", "ref_bc", "ref_bl", "ref_facture", "ref_bc_linked",
)
NORMALIZABLE_FIELDS = ("designation", "column_header", "unit", "supplier_name", "product_word", "category", "label")
CODES = (
    r"^[A-Za-z]{1,6}\d{2,}$", r"^\d{2,}[A-Za-z]{1,6}$", r"^[A-Za-z0-9]{3,}[-/_.*+x×][A-Za-z0-9]", r"\d+[xX×*]\d+",
    r"[A-Za-z]+/[A-Za-z]+", r"^\d{6,}$", r"(?i)^[A-Z]{2,6}[-/]\d{2,4}[-/]\d{2,8}$",
)
DIMENSION, SLASHED = r"\d+[xX×*]\d+", r"[A-Za-z]+/[A-Za-z]+"
AMOUNT = r"^\s*[\d\s]+[,.]?\d{0,3}\s*$"
DATE = r"\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}"
FISCAL_ID = r"\d{7}[/\-][A-Z][/\-][A-Z][/\-][A-Z][/\-]\d{3}"
EMAIL = r"[\w.+-]+@[\w.-]+\.\w+"
IBAN = r"[A-Z]{2}\d{2}[\dA-Z]{4,}"
HARD = (
    r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$", r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}$",
    r"(?i)\b(bl|bc|fa|fac|fact|facture)[-_/]?\s*\d+", r"(?i)\b(mf|m\.f)\s*[:\-/]?\s*[0-9]",
    r"(?i)\b(matricule\s+fiscal|mat\s+fiscal|code\s+tva|c\.?tva)\b.*[0-9]", r"\d+\s*[xX*]\s*\d+",
)
CONTINUATION = (
    r"PAGE\s+\d+\s+(?:OF|SUR|DE)\s+\d+", r"\bSUITE\b", r"\bSUITE\s+ET\s+FIN\b", r"\*SUITE\*",
    r"(?<!\w)(?<!\d\s)(?:PAGE\s+)?\d{1,2}\s*/\s*\d{1,2}(?!\s*\d)(?!\w)",
)
ORDER_TOTALS = (
    r"TOTAL\s+HORS\s+TAXES", r"REMISE\s+HORS\s+TAXE", r"NET\s+HORS\s+TAXES", r"ARRET[EÉ]\s+(?:LA\s+)?PRESENT",
    r"DIRECTION\s+G[EÉ]N[EÉ]RALE", r"APPROVISIONNEMENT",
)
INVOICE_MARKS = (r"FACTURE\s+N[°o]", r"N[°o]\s+FACTURE", r"BON\s+DE\s+LIVRAISON", r"AVOIR\s+N[°o]")
TABLE_STOPS = (
    r"(?:TOTAL|MONTANT)\s+H\.?\s*T\.?(?:\s*:)?", r"(?:TOTAL|MONTANT)\s+T\.?\s*T\.?\s*C\.?", r"NET\s+[AÀ]\s+PAYER",
    r"NET\s+HORS\s+TAXES", r"(?:BASE|MONTANT|TOTAL)\s+T\.?\s*V\.?\s*A\.?", r"SOUS.TOTAL", r"TOTAL\s+G[EÉ]N[EÉ]RAL",
    r"ARRET[EÉE]+\s+(?:LA\s+)?PR[EÉ]SENT", r"\bFODEC\b", r"\bTIMBRE\b", r"REMISE\s+HORS\s+TAXES",
)
TEXT_FOOTERS = (
    "TOTAL HORS TAXES", "NET HORS TAXES", "TOTAL TTC", "MONTANT T.T.C", "NET À PAYER", "NET A PAYER", "SOUS-TOTAL", "MONTANT TTC", "ARRETEE LA PRESENTE",
)
TEXT_FOOTER_LINE = r"(?i)^\s*(?:TOTAL\s+H\.?\s*T\.?|MONTANT\s+H\.?\s*T\.?)\s*[:\-]?\s*[\d\s,.]+"
SAFE_VERDICTS = ("LOW_CONFIDENCE", "PARTIAL_MATCH", "MATCH")
STATUS_LABELS = {
    "PENDING": "en attente", "PROCESSING": "en cours", "CLASSIFYING": "classification", "EXTRACTING": "extraction",
    "MATCHING": "rapprochement", "COMPLETED": "terminé", "REVIEW_REQUIRED": "à vérifier", "FAILED": "échoué",
}
# --------------------------------------------------------------------------------------------------------------------


def _any(x: Column, patterns: tuple[str, ...], flags: str = "(?U)") -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | x.rlike(flags + p)
    return F.coalesce(out, F.lit(False))


def _count(x: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(x, f"[^{kind}]", ""))


def looks_like_code(x: Column | str) -> Column:
    """FLT2."""
    v = _c(x)
    mixed = v.rlike("[A-Za-z]") & v.rlike("[0-9]") & F.length(F.replace(v, F.lit(" "), F.lit(""))).between(4, 25)
    bare = F.regexp_replace(v, "[-/.]", "")
    dense = F.length(bare).between(3, 15) & (F.length(v) - F.length(F.replace(v, F.lit(" "), F.lit(""))) <= 2) & (
        _count(bare, "0-9") >= F.lit(0.30) * F.length(bare)
    )
    return F.coalesce((mixed & (_any(v, CODES) | dense)) | _any(v, (DIMENSION, SLASHED)), F.lit(False))


def is_protected(x: Column | str, field: Column | None = None, patterns: tuple[str, ...] = ()) -> Column:
    """FLT1: a value that no correction may touch. patterns: a supplier's reference patterns."""
    v = F.trim(_c(x))
    out = looks_like_code(v) | (_any(v, (DATE,)) & (F.length(v) <= 12)) | _any(v, (AMOUNT, FISCAL_ID, EMAIL, IBAN))
    if field is not None:
        out = out | F.coalesce(F.lower(field).isin(*PROTECTED_FIELDS), F.lit(False))
    if patterns:
        out = out | _any(v, patterns, "(?i)")
    return F.coalesce((v != "") & out, F.lit(False))


def is_dictionary_candidate(x: Column | str, field: Column | None = None) -> Column:
    """FLT3: a word worth a dictionary entry."""
    v = F.trim(_c(x))
    n, digits = _count(v, "A-Za-z0-9"), _count(v, "0-9")
    ok = (n >= 2) & v.rlike("[A-Za-z]") & ~((n <= 10) & (digits > 0) & (digits > F.lit(0.40) * n))
    return F.coalesce(~is_protected(v, field) & ok & ~v.rlike(r"^[0-9\s.,/\-]+$"), F.lit(False))


def is_normalizable_field(x: Column | str) -> Column:
    """FLT4."""
    return F.coalesce(F.lower(_c(x)).isin(*NORMALIZABLE_FIELDS), F.lit(False))


def is_hard_protected(x: Column | str) -> Column:
    """FLT5: what even a manual dictionary entry may not be: addresses, whole dates, amounts, document references, fiscal ids, dimensions, digits with a separator."""
    v = cleanup_key(x)
    amount = v.rlike(r"(?U)^[\d\s.,]+$") & v.rlike(r"(?U)\d")
    return F.coalesce((v != "") & (_any(v, HARD) | amount | (v.rlike(r"(?U)\d") & v.rlike(r"[/_\-=]"))), F.lit(False))


def looks_generated(x: Column | str, source: Column) -> Column:
    """FLT6: a learnt entry that looks like a code; manual entries only if hard-protected."""
    v = cleanup_key(x)
    learnt = (v.rlike("[a-z]") & v.rlike("[0-9]") & (_count(v, "a-z0-9") >= 4)) | (v.rlike("[0-9]") & v.rlike(r"[/_.+\-=]"))
    return is_hard_protected(x) | F.coalesce((F.upper(source) != "MANUAL") & learnt, F.lit(False))


def valid_product_line(ref: Column, price: Column, qty: Column, designation: Column) -> Column:
    """FLT7."""
    has_ref, has_price = F.coalesce(ref != "", F.lit(False)), F.coalesce(price > 0, F.lit(False))
    words = F.filter(F.split(F.coalesce(designation, F.lit("")), r"\s+"), lambda w: F.length(w) > 1)
    prose = (F.size(words) > 0) & F.forall(words, lambda w: w.rlike(r"^[A-ZÀ-Ÿa-zà-ÿ\-]+$"))
    return (has_ref | has_price | F.coalesce(qty > 0, F.lit(False))) & ~(~has_ref & ~has_price & prose)


def is_noise(x: Column | str) -> Column:
    """FLT8: one character, or under 40% letters and digits."""
    v = _c(x)
    return F.coalesce((F.length(v) <= 1) | (F.length(F.regexp_replace(v, r"[^\p{L}\p{N}]", "")) < F.lit(0.40) * F.length(v)), F.lit(True))


def is_continuation(text: Column | str) -> Column:
    """FLT9."""
    return _any(F.upper(_c(text)), CONTINUATION)


def has_order_totals(text: Column | str) -> Column:
    """FLT10's part that the text decides: totals of an order, and no mark of an invoice."""
    up = F.upper(_c(text))
    return _any(up, ORDER_TOTALS) & ~_any(up, INVOICE_MARKS)


def is_order_summary(group_type: Column, text: Column | str) -> Column:
    """FLT10: totals of an order that were read as an invoice."""
    return F.coalesce(group_type.isin("BC", "BL"), F.lit(False)) & has_order_totals(text)


def is_table_stop(text: Column | str) -> Column:
    """FLT11."""
    return _any(F.upper(_c(text)), TABLE_STOPS)


def has_number(words: Column) -> Column:
    """FLT12: a word of digits, commas, dots and spaces only."""
    return F.coalesce(F.exists(words, lambda w: F.regexp_replace(w, "[,. ]", "").rlike("^[0-9]+$")), F.lit(False))


def is_skipped_line(line: Column | str) -> Column:
    """FLT13: a text-table line that is passed over: short, or without digits."""
    v = F.trim(_c(line))
    return F.coalesce((F.length(v) < 5) | ~v.rlike("[0-9]"), F.lit(True))


def is_text_footer(line: Column | str) -> Column:
    """FLT13: a line that ends a text table."""
    v = F.trim(_c(line))
    up = F.upper(v)
    return F.coalesce(F.exists(F.array(*[F.lit(k) for k in TEXT_FOOTERS]), lambda k: up.contains(k)) | v.rlike(TEXT_FOOTER_LINE), F.lit(False))


def needs_fallback(n_lines: Column, confidence: Column, transcribed: Column) -> Column:
    """FLT14."""
    return F.coalesce(n_lines, F.lit(0)).eqNullSafe(F.lit(0)) | F.coalesce(confidence < 0.60, F.lit(True)) | F.coalesce(transcribed, F.lit(False))


def is_known_buyer(name: Column | str, buyers: tuple[str, ...]) -> Column:
    """FLT15; buyers: configured names in lower case."""
    return F.coalesce(F.lower(F.trim(_c(name))).isin(*buyers) if buyers else F.lit(False), F.lit(False))


def safe_alias_candidate(verdict: Column, n_mismatch: Column, bc_ref: Column, doc_ref: Column, is_invoice: Column,
                         bc_qty: Column, doc_qty: Column, bc_price: Column, doc_price: Column) -> Column:
    """FLT16."""
    invoice = (bc_qty == doc_qty) & (F.abs(bc_price - doc_price) <= 0.100)
    both = F.when(is_invoice, invoice).otherwise(bc_qty.isNotNull() & doc_qty.isNotNull())
    return F.coalesce(verdict.isin(*SAFE_VERDICTS) & (n_mismatch == 0) & (bc_ref != "") & (doc_ref != "") & both, F.lit(False))


def shown_alias_candidate(verdict: Column, n_mismatch: Column, internal: Column, invoice_ref: Column, delivery_ref: Column, applied: Column,
                          bc_qty: Column, delivery_qty: Column, invoice_qty: Column, bc_price: Column, invoice_price: Column) -> Column:
    """FLT17: what a reviewer is offered. The invoice's reference counts before the delivery's; quantities agree on either side, on the invoice the price too."""
    by_invoice = F.coalesce(invoice_ref != "", F.lit(False))
    external = F.when(by_invoice, invoice_ref).otherwise(F.coalesce(delivery_ref, F.lit("")))
    same = bc_qty == F.when(by_invoice, invoice_qty).otherwise(delivery_qty)
    price = ~by_invoice | F.coalesce(F.abs(bc_price - invoice_price) <= 0.100, F.lit(False))
    some = (external != "") & (internal != "") & (external != internal)
    return F.coalesce(some & verdict.isin(*SAFE_VERDICTS) & (F.coalesce(n_mismatch, F.lit(0)) == 0) & ~F.coalesce(applied, F.lit(False)) & same & price, F.lit(False))


def listed_alias_candidate(internal: Column, invoice_ref: Column, delivery_ref: Column, applied: Column, bc_qty: Column, delivery_qty: Column, invoice_qty: Column, relaxed: bool = False) -> Column:
    """FLT18: what the list of candidates holds: both references and not applied; unless relaxed, whole quantities that agree, the invoice's where it has a
    reference. A missing quantity agrees with none."""
    by_invoice = F.coalesce(invoice_ref != "", F.lit(False))
    some = (by_invoice | F.coalesce(delivery_ref != "", F.lit(False))) & (internal != "") & (F.coalesce(F.lower(applied.cast("string")), F.lit("")) != "true")
    whole = lambda q: q.try_cast("double").try_cast("bigint")
    return F.coalesce(some & (F.lit(True) if relaxed else whole(bc_qty) == F.when(by_invoice, whole(invoice_qty)).otherwise(whole(delivery_qty))), F.lit(False))


def is_alias_line(bc_ref: Column, document_ref: Column, external: Column, internal: Column) -> Column:
    """FLT19: a verdict line of the requested alias pair, both sides normalised."""
    return F.coalesce((match_key(bc_ref) == match_key(internal)) & (match_key(F.coalesce(document_ref, F.lit(""))) == match_key(external)), F.lit(False))


def contains_text(x: Column, y: Column, needle: str) -> Column:
    """FLT20."""
    hit = F.lower(F.coalesce(x, F.lit(""))).contains(needle.lower()) | F.lower(F.coalesce(y, F.lit(""))).contains(needle.lower())
    return hit


def job_matches(needle: str, *fields: Column) -> Column:
    """FLT21: the needle in any of the job's fields, its French status label included by the caller."""
    return F.exists(F.array(*[F.lower(F.coalesce(f.cast("string"), F.lit(""))) for f in fields]), lambda v: v.contains(needle.lower()))


def status_label(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in STATUS_LABELS.items() for v in kv]), status), F.lower(status))


def shown_invoice_row(ref: Column, designation: Column) -> Column:
    """FLT22."""
    return F.coalesce(F.trim(ref) != "", F.lit(False)) | F.coalesce(F.trim(designation) != "", F.lit(False))
