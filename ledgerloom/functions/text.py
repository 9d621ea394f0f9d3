"""Scalar normalisers and number parsing as Column -> Column functions; no UDFs.

Fixed values below (accent table, noise words, date formats, confusable characters) must be what they are for right
results; they are listed together at the top.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------------------------
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝŸ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY"
LIGATURES = (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss"))
DIGIT_LIKE = (("Oo", "0"), ("lI", "1"), ("S", "5"), ("B", "8"), ("G", "6"), ("Z", "2"))
SUPPLIER_NOISE = ("ETS", "ETABLISSEMENT", "ETABLISSEMENTS", "STE", "SOCIETE", "SARL", "SUARL", "SA", "SAS", "EURL", "TUNISIE", "TUNIS")
DATE_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d")
KEY_PUNCTUATION = r",;:!?@#$%^&*()\[\]{}"
TIER_LABELS = {1: "Template", 2: "Model", 3: "Vision", 4: "Manual"}
VERDICT_LABELS = {
    "MATCH": "Conforme", "MISMATCH": "Écart", "MISSING": "Manquant", "EXTRA": "Supplémentaire",
    "LOW_CONFIDENCE": "Confiance faible", "PARTIAL_DATA": "Données partielles", "PARTIAL_MATCH": "Correspondance partielle",
}
NUMBER = "decimal(24,6)"
# --------------------------------------------------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_accents(x: Column | str) -> Column:
    """ASCII form of Latin letters (NRM7 and others)."""
    out = F.translate(_c(x), ACCENTED, PLAIN)
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def squeeze(x: Column | str) -> Column:
    """NRM5: trimmed, every white-space run one space."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def digits_for_letters(x: Column | str) -> Column:
    """NRM1: without spaces; letters that look like digits become digits beside a digit or another such letter."""
    near = "[0-9OolISBGZ]"
    out = F.replace(_c(x), F.lit(" "), F.lit(""))
    for letters, digit in DIGIT_LIKE:
        out = F.regexp_replace(out, f"(?<={near})[{letters}]|[{letters}](?={near})", digit)
    return out


def reference(x: Column | str) -> Column:
    """NRM2: OCR-corrected, trimmed, upper-case reference; null and blank give the empty string."""
    return F.coalesce(F.upper(F.trim(digits_for_letters(x))), F.lit(""))


def safe_reference(x: Column | str) -> Column:
    """NRM14: NRM2, null instead of the empty string."""
    return F.nullif(reference(x), F.lit(""))


def match_key(x: Column | str) -> Column:
    """NRM6: upper-case A-Z and 0-9 only; accented letters are dropped."""
    return F.coalesce(F.regexp_replace(F.upper(F.trim(_c(x))), "[^A-Z0-9]", ""), F.lit(""))


def description(x: Column | str) -> Column:
    """NRM7: accents folded, lower-case a-z, 0-9 and spaces, trimmed."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(fold_accents(x)), "[^a-z0-9 ]", "")), F.lit(""))


def supplier_key(x: Column | str) -> Column:
    """NRM8: upper-case tokens without noise words (with them if nothing else is left), joined without separator."""
    tokens = F.regexp_extract_all(F.upper(fold_accents(x)), F.lit("([A-Z0-9]+)"), 1)
    kept = F.filter(tokens, lambda t: ~t.isin(*SUPPLIER_NOISE))
    return F.coalesce(F.array_join(F.when(F.size(kept) > 0, kept).otherwise(tokens), ""), F.lit(""))


def dictionary_key(x: Column | str) -> Column:
    """NRM9: folded, lower-case, spaces collapsed, outer punctuation removed (dots and hyphens stay)."""
    v = squeeze(F.lower(fold_accents(F.trim(_c(x)))))
    v = F.regexp_replace(F.regexp_replace(v, f"^[{KEY_PUNCTUATION}]+", ""), f"[{KEY_PUNCTUATION}]+$", "")
    return F.coalesce(F.trim(v), F.lit(""))


def cleanup_key(x: Column | str) -> Column:
    """NRM10: lower-case, quotes at the ends removed, spaces collapsed."""
    v = F.regexp_replace(F.lower(F.trim(_c(x))), "^[\"'`]+|[\"'`]+$", "")
    return F.coalesce(squeeze(v), F.lit(""))


def join_broken(x: Column | str) -> Column:
    """NRM11: words broken as `x- y` joined, doubled spaces collapsed."""
    v = F.regexp_replace(_c(x), r"(?U)(\w)-\s+(\w)", "$1$2")
    return F.trim(F.regexp_replace(v, " {2,}", " "))


def supplier_code(x: Column | str, stop_words: tuple[str, ...] = SUPPLIER_NOISE[:10]) -> Column:
    """NRM12: first 4 letters of the first two tokens that are no stop words and longer than 1; at most 10, or UNKNOWN."""
    tokens = F.filter(F.regexp_extract_all(F.upper(fold_accents(x)), F.lit("([A-Z0-9]+)"), 1), lambda t: (F.length(t) > 1) & ~t.isin(*stop_words))
    code = F.substring(F.array_join(F.transform(F.slice(tokens, 1, 2), lambda t: F.substring(t, 1, 4)), ""), 1, 10)
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("UNKNOWN"))


def generalised(x: Column | str) -> Column:
    """NRM13: a regular expression for tokens like this one: letter runs over 3 as classes, digit runs by length."""
    parts = F.regexp_extract_all(_c(x), F.lit(r"([A-Za-z]+|[0-9]+|[^A-Za-z0-9])"), 1)

    def one(p: Column) -> Column:
        n = F.length(p).cast("string")
        return (
            F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("\\d{"), n, F.lit("}")))
            .when(p.rlike("^[A-Za-z]{1,3}$"), F.upper(p))
            .when(p.rlike("^[A-Za-z]+$"), F.concat(F.lit("[A-Z]{1,"), n, F.lit("}")))
            .otherwise(F.concat(F.lit("\\"), p))
        )

    return F.array_join(F.transform(parts, one), "")


def date(x: Column | str, supplier_format: str | None = None) -> Column:
    """NRM4: a date from the fixed formats, day first; a trailing time is dropped; two-digit years pivot at 69.

    English month names are read; the free-form tail of other layouts gives null.
    """
    v = F.trim(F.regexp_replace(F.trim(_c(x)), r"\s+\d{1,2}:\d{2}(:\d{2})?$", ""))
    tries = [F.try_to_timestamp(F.when(v.rlike(r"^\d{4}-"), v) if f.startswith("yyyy") else F.when(v.rlike(r"[/.\-]\d{4}$"), v), F.lit(f)).cast("date") for f in DATE_FORMATS]
    if supplier_format:
        tries.insert(0, F.try_to_timestamp(v, F.lit(supplier_format)).cast("date"))
    short = F.regexp_extract_all(v, F.lit(r"(\d+)"), 1)
    year = F.try_element_at(short, F.lit(3)).cast("int")
    full = F.when(year >= 69, 1900 + year).otherwise(2000 + year)
    two = F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_timestamp(F.concat_ws("/", F.try_element_at(short, F.lit(1)), F.try_element_at(short, F.lit(2)), full.cast("string")), F.lit("d/M/yyyy")).cast("date"))
    named = F.when(v.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), F.try_to_timestamp(F.initcap(v), F.lit("d MMMM yyyy")).cast("date"))
    return F.coalesce(*tries, two, named)


def number(x: Column | str) -> Column:
    """NUM1: a decimal from French or English notation, by the counts of commas (c) and dots (d).

    Signs vanish. c=1, d=0: comma is decimal with at most 2 digits after it, or with 3 if the integer part is below 10000;
    otherwise it groups. d=1, c=0: dot is decimal. c=1, d>=1: dots group. d=1, c>=2: commas group. Else all but the last
    separator go and that one is decimal.
    """
    return _decimal(F.regexp_replace(_c(x), "[^0-9.,]", ""))


def number_within(x: Column) -> Column:
    """NUM1 inside a lambda, where common parts are not shared: the cleaned text is computed once."""
    return F.transform(F.array(F.regexp_replace(x, "[^0-9.,]", "")), _decimal)[0]


def _decimal(s: Column) -> Column:
    c = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    d = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    before = F.regexp_extract(s, "^([0-9]*),", 1)
    after = F.length(F.regexp_extract(s, ",([0-9]*)$", 1))
    comma_point = F.replace(s, F.lit(","), F.lit("."))
    no_comma = F.replace(s, F.lit(","), F.lit(""))
    whole = F.coalesce(F.try_to_number(F.nullif(before, F.lit("")), F.lit("999999999999999999")).cast("decimal(20,0)"), F.lit(0))
    last_only = F.replace(F.regexp_replace(s, "[.,](?=.*[.,])", ""), F.lit(","), F.lit("."))
    text = (
        F.when((c == 1) & (d == 0), F.when((after <= 2) | ((after == 3) & (whole < 10000)), comma_point).otherwise(no_comma))
        .when((d == 1) & (c == 0), s)
        .when(c == 1, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(d == 1, no_comma)
        .otherwise(last_only)
    )
    return F.nullif(text, F.lit("")).try_cast(NUMBER)


def normalised_number(x: Column | str) -> Column:
    """NRM3."""
    return number(digits_for_letters(x))


def quantity(x: Column | str) -> Column:
    """NUM2: struct(value, raw); one leading ~ or - is dropped."""
    raw = F.trim(_c(x))
    return F.struct(number(F.regexp_replace(raw, "^[~-]", "")).alias("value"), raw.alias("raw"))


def money(x: Column | str) -> Column:
    """NUM3: struct(value, raw)."""
    raw = F.trim(_c(x))
    return F.struct(number(raw).alias("value"), raw.alias("raw"))


def nonzero(x: Column | str) -> Column:
    """Zero is missing almost everywhere in the domain."""
    return F.when(_c(x) != 0, _c(x))


def scale_corrected(qty: Column, price: Column, total: Column) -> Column:
    """NUM4: the price divided by 1000, 100 or 10 if quantity * price is within 20% of that multiple of the total."""
    ratio = nonzero(qty).cast("double") * nonzero(price).cast("double") / nonzero(total).cast("double")
    out = price
    for factor in (10, 100, 1000):
        out = F.when(F.abs(ratio - factor) <= 0.2 * factor, price / factor).otherwise(out)
    return out


def shift_repaired(bc_price: Column, price: Column) -> Column:
    """NUM5: the invoice price times 10, 100 or 1000 if the order price is within 5% of that multiple of it."""
    ratio = nonzero(bc_price).cast("double") / nonzero(price).cast("double")
    out = price
    for factor in (1000, 100, 10):
        out = F.when(F.abs(ratio - factor) <= 0.05 * factor, price * factor).otherwise(out)
    return out


def line_total(declared: Column, qty: Column, price: Column) -> Column:
    """NUM6: the declared total, or quantity times price where it is missing."""
    return F.coalesce(declared, qty * price)


def to_decimal(x: Column | str) -> Column:
    """NUM7."""
    return _c(x).cast("string").try_cast(NUMBER)


def percentage(x: Column | str) -> Column:
    """FMT1: a confidence as a whole percentage; values above 1 are percentages already."""
    v = _c(x)
    return F.floor(F.when(v <= 1, v * 100).otherwise(v) + 0.5).cast("int")


def tier_label(x: Column | str) -> Column:
    """FMT2: the label of an extraction tier."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in TIER_LABELS.items() for v in kv]), _c(x)), F.lit("-"))


def verdict_label(x: Column | str) -> Column:
    """FMT3: the French label of a verdict."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in VERDICT_LABELS.items() for v in kv]), _c(x)), _c(x))


def shown_money(x: Column | str) -> Column:
    """FMT2: two decimals."""
    return F.format_number(_c(x), 2)


def shown_date(x: Column | str) -> Column:
    """FMT2: dd/MM/yyyy."""
    return F.date_format(_c(x), "dd/MM/yyyy")
