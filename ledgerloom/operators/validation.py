"""Document validation (VAL1-VAL5) as array-building projections over lines aggregated once per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
LINE_TOTAL, DOCUMENT_TOTAL, SCHEMA_TOTAL = 0.02, 0.10, 0.05


def line_math(total: Column, expected: Column, least: Column | None = None) -> Column:
    """Whether a line total agrees with quantity times price: within least or 1% of it. Missing or zero values agree."""
    known = F.coalesce((total != 0) & (expected != 0), F.lit(False))
    least = F.lit(LINE_TOTAL) if least is None else least
    return ~known | (F.abs(total - expected) <= F.greatest(least, F.lit(0.01) * F.abs(expected)))


def math_ratio(total: Column, expected: Column) -> Column:
    """The ratio of line total to quantity times price at 4 decimals."""
    return F.when((total != 0) & (expected != 0), F.bround(total / expected, 4))


def capped(confidences: Column, field: str, at: float = 0.5) -> Column:
    """A confidence map with one field capped."""
    own = F.least(F.coalesce(F.try_element_at(confidences, F.lit(field)), F.lit(1.0)), F.lit(at))
    return F.map_concat(F.map_filter(confidences, lambda k, _: k != field), F.create_map(F.lit(field), own))


def totals_agree(ht: Column, rate: Column, ttc: Column, tolerance: float = SCHEMA_TOTAL) -> Column:
    """Whether HT with tax gives TTC; missing or zero values agree."""
    known = F.coalesce((ht != 0) & (rate != 0) & (ttc != 0), F.lit(False))
    return ~known | (F.abs(ht * (1 + rate / 100) - ttc) <= tolerance)


def _lines(kind: str) -> list[Column]:
    bad_qty = F.col("qty").isNull() | (F.col("qty") <= 0)
    bad_price = F.col("price").isNull() | (F.col("price") <= 0)
    off = F.coalesce((F.col("qty") != 0) & (F.col("price") != 0) & (F.col("total") != 0) & (F.abs(F.col("qty") * F.col("price") - F.col("total")) > LINE_TOTAL), F.lit(False))
    return [
        F.count(F.lit(1)).alias("n_lines"), F.count_if(bad_qty).alias("bad_qty"),
        F.count_if(F.col("ref").isNull() | (F.col("ref") == "")).alias("no_ref"),
        (F.count_if(bad_price) if kind != "BL" else F.lit(0)).alias("bad_price"), (F.count_if(off) if kind == "BC" else F.lit(0)).alias("bad_math"),
        F.sum("total").alias("sum_total"),
    ]


def validate(documents: DataFrame, lines: DataFrame, kind: str) -> DataFrame:
    """VAL1 (BC), VAL2 (BL), VAL3 (FACTURE): doc_id, n_errors, n_warnings, is_valid, findings (sorted codes).

    documents: doc_id, ref_document, document_date, total_ht, total_ttc, tva_rate; lines: doc_id, ref, qty, price, total."""
    at = documents.join(lines.groupBy("doc_id").agg(*_lines(kind)), "doc_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    has = n("n_lines") > 0
    no_ref_doc = F.col("ref_document").isNull() | (F.col("ref_document") == "")
    invoice = F.lit(kind == "FACTURE")
    sum_off = F.coalesce(invoice & has & (F.col("total_ht") != 0) & (F.col("sum_total") > 0) & (F.abs(F.col("sum_total") - F.col("total_ht")) > DOCUMENT_TOTAL), F.lit(False))
    ttc_off = invoice & has & ~totals_agree(F.col("total_ht"), F.col("tva_rate"), F.col("total_ttc"), DOCUMENT_TOTAL)
    errors = no_ref_doc.cast("int") + (~has).cast("int") + n("bad_qty") + F.when(invoice, n("bad_price")).otherwise(0)
    warnings = F.col("document_date").isNull().cast("int") + n("no_ref") + F.when(invoice, 0).otherwise(n("bad_price")) + n("bad_math") + sum_off.cast("int") + ttc_off.cast("int")
    code = lambda cond, name: F.when(cond, F.lit(name))
    findings = F.array_compact(F.array(
        code(F.col("document_date").isNull(), "document_date"), code(~has, "lines"), code(n("bad_price") > 0, "prix_unitaire"), code(n("bad_qty") > 0, "qty"),
        code(no_ref_doc, "ref_document"), code(n("no_ref") > 0, "ref_produit"), code(sum_off, "total_ht"), code(n("bad_math") > 0, "total_ligne_ht"), code(ttc_off, "total_ttc"),
    ))
    return at.select("doc_id", errors.cast("long").alias("n_errors"), warnings.cast("long").alias("n_warnings"), (errors == 0).alias("is_valid"), F.array_join(findings, ",").alias("findings"))


def requires_review(is_valid: Column, low_fields: Column) -> Column:
    """VAL5."""
    return ~is_valid | low_fields


def date_warnings(orders: DataFrame, deliveries: DataFrame, invoices: DataFrame) -> DataFrame:
    """VAL4: job_id, early_deliveries, invoice_early. Each: job_id, document_date; deliveries also ref."""
    bl = deliveries.where("document_date is not null").join(orders.select("job_id", F.col("document_date").alias("ordered")), "job_id", "left")
    bl = bl.groupBy("job_id").agg(F.count_if(F.col("document_date") < F.col("ordered")).alias("early_deliveries"), F.max("document_date").alias("latest"), F.max_by("ref", "document_date").alias("latest_ref"))
    at = orders.select("job_id", F.col("document_date").alias("ordered")).join(bl, "job_id", "left").join(invoices.select("job_id", F.col("document_date").alias("invoiced")), "job_id", "left")
    early = F.coalesce(F.col("invoiced") < F.coalesce("latest", "ordered"), F.lit(False))
    return at.select("job_id", F.coalesce("early_deliveries", F.lit(0)).cast("long").alias("early_deliveries"), early.alias("invoice_early"))
