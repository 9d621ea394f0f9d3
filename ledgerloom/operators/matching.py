"""Three-way reconciliation of order, delivery and invoice lines.

Lines are rows (job_id, idx, ref, designation, qty, price, tva, total, confidence); money is DECIMAL. Everything but the
assignment is Catalyst expressions and joins on job_id, so all jobs run at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators.assignment import assign_lines
from ledgerloom.sources.scratch import stored

# Fixed values -------------------------------------------------------------------------------------------------------
MATCH_AT = 0.80
WEAK, UNSURE = 0.65, 0.70
NOTE_LINE = "FACTURE qty/price reconciled from invoice line total"
NOTE_TOTAL = "FACTURE qty/price reconciled from invoice total"
NOTE_BC_RATE = "BC TVA reconciled from facture TVA consensus"
NOTE_FAC_RATE = "FACTURE TVA reconciled from facture TVA consensus"
NOTE_ABSENT = "Ordered in BC but absent from FACTURE"
NOTE_MISSING = "Product in BC not found in BL or FACTURE"
NOTE_EXTRA_BL = "Product in BL not found in BC"
NOTE_EXTRA_FAC = "Product in FACTURE not found in BC"
LOW = ("LOW_CONFIDENCE", "PARTIAL_DATA", "PARTIAL_MATCH")
# --------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tolerances:
    """Defaults of the reference; a supplier's own values replace price and qty (VRD6)."""

    price: float = 0.10
    qty: float = 0.0
    line_total: float = 0.02
    tva: float = 0.0
    ref_distance: int = 2
    invoice_allow_partial: bool = True


DEFAULT = Tolerances()


def _lit(x: float) -> Column:
    return F.lit(f"{x:.4f}").cast("decimal(18,4)")


def total_tolerance(t: Tolerances, *values: Column) -> Column:
    """REC3."""
    return F.greatest(_lit(max(t.line_total, 0.100)), *[F.abs(v) * _lit(0.001) for v in values])


def totals_agree(a: Column, b: Column, t: Tolerances) -> Column:
    return F.coalesce(F.abs(a - b) <= total_tolerance(t, a, b), F.lit(False))


def compare_quantities(bc: Column, other: Column, tolerance: Column, allow_partial: bool = True) -> tuple[Column, Column]:
    """VRD2: whether the quantities are acceptable, and a warning or null."""
    near = F.abs(bc - other) <= tolerance
    if allow_partial:
        warning = F.when(near, None).when(other < bc, "PARTIAL_DELIVERY").when(other > bc + tolerance, "OVER_DELIVERY").otherwise("QTY_MISMATCH")
        return near | (other < bc) | (other > bc + tolerance), warning
    return near, F.when(near, F.lit(None).cast("string")).otherwise("QTY_MISMATCH")


def rates_agree(a: Column, b: Column, t: Tolerances) -> Column:
    return F.coalesce(F.abs(a - b) <= _lit(max(t.tva, 0.25)), F.lit(False))


def rate_slip(observed: Column, trusted: Column, t: Tolerances) -> Column:
    """REC4: a plausible misreading of the trusted rate."""
    plausible = observed.between(0, 30) & trusted.between(0, 30)
    tens = F.floor(observed / 10) == F.floor(trusted / 10)
    return F.coalesce(plausible & (rates_agree(observed, trusted, t) | ((F.abs(observed - trusted) <= 4) & tens)), F.lit(False))


def reconcile_rates(bc: Column, fac: Column, trusted: Column, t: Tolerances) -> tuple[Column, Column, Column]:
    """REC4: both rates and a note or null."""
    off = bc.isNotNull() & fac.isNotNull() & trusted.isNotNull() & ~rates_agree(bc, fac, t)
    fix_bc = off & rates_agree(fac, trusted, t) & rate_slip(bc, trusted, t)
    fix_fac = off & rates_agree(bc, trusted, t) & rate_slip(fac, trusted, t)
    fixed = fix_bc | fix_fac
    return F.when(fixed, trusted).otherwise(bc), F.when(fixed, trusted).otherwise(fac), F.when(fix_bc, NOTE_BC_RATE).when(fix_fac, NOTE_FAC_RATE)


def line_verdict(has_side: Column, n_mismatch: Column, partial: Column, confidence: Column, extraction: Column) -> Column:
    """VRD3."""
    weak = (confidence < WEAK) | (extraction < UNSURE)
    return (
        F.when(~has_side, "PARTIAL_DATA").when(n_mismatch > 0, "MISMATCH").when(partial, "PARTIAL_MATCH")
        .when(confidence < MATCH_AT, F.when(weak, "LOW_CONFIDENCE").otherwise("MATCH"))
        .when(extraction < UNSURE, "LOW_CONFIDENCE").otherwise("MATCH")
    )


def global_verdict(counts: dict[str, Column], has_invoice: Column, n_warnings: Column) -> Column:
    """AGG3."""
    return (
        F.when(~has_invoice, "INCOMPLETE").when(counts["MISMATCH"] > 0, "REJECTED").when(counts["PARTIAL_MATCH"] > 0, "REVIEW")
        .when(counts["LOW_CONFIDENCE"] > 0, "REVIEW").when(counts["MISSING"] > 0, "PARTIAL").when(counts["EXTRA"] > 0, "REVIEW")
        .when(n_warnings > 0, "REVIEW").otherwise("VALIDATED")
    )


def final_status(verdict: Column, has_order: Column) -> Column:
    """VRD7."""
    return F.when(~has_order, "FAILED").when(verdict.isin("REVIEW", "INCOMPLETE"), "REVIEW_REQUIRED").otherwise("COMPLETED")


def reviewed(status: Column, decision: Column, verdict: Column) -> tuple[Column, Column]:
    """VRD8: status and verdict after a human decision; other statuses stay."""
    open_ = status.isin("REVIEW_REQUIRED", "FAILED")
    yes, no = open_ & (decision == "approve"), open_ & (decision == "reject")
    return F.when(yes, "COMPLETED").when(no, "FAILED").otherwise(status), F.when(yes, "VALIDATED").when(no, "REJECTED").otherwise(verdict)


def merge_deliveries(lines: DataFrame) -> DataFrame:
    """JN7: delivery lines of a job merged by reference, in order of first appearance; blank references stay apart.

    lines: job_id, doc_ord, idx, ref, designation, qty, price, tva, total, confidence, low."""
    key = F.upper(F.trim(F.coalesce("ref", F.lit(""))))
    at = lines.withColumn("__key", F.when(key != "", key).otherwise(F.concat(F.lit("\0"), F.col("doc_ord").cast("string"), F.lit(":"), F.col("idx").cast("string"))))
    order = F.struct("doc_ord", "idx")
    first = {c: F.min_by(c, order).alias(c) for c in ("ref", "designation", "price", "tva", "total")}
    merged = at.groupBy("job_id", "__key").agg(
        F.min(order).alias("__first"), *first.values(), F.sum("qty").alias("qty"), F.min("confidence").alias("confidence"), F.bool_or("low").alias("low")
    )
    return merged.withColumn("idx", F.row_number().over(Window.partitionBy("job_id").orderBy("__first")) - 1).drop("__key", "__first")


def consolidate_orders(lines: DataFrame) -> DataFrame:
    """JN8: order lines merged by normalised reference and price text. The quantity is null if the first one is."""
    key = X.match_key("ref")
    blank = F.concat(F.lit("\0"), F.col("idx").cast("string"))
    at = lines.withColumn("__key", F.when(key == "", blank).otherwise(F.concat_ws("|", key, F.coalesce(F.col("price").cast("string"), F.lit("None")))))
    merged = at.groupBy("job_id", "__key").agg(
        F.min("idx").alias("__first"), F.min_by("ref", "idx").alias("ref"), F.min_by("designation", "idx").alias("designation"),
        F.min_by("price", "idx").alias("price"), F.sum("qty").alias("__sum"), F.min_by(F.struct("qty"), "idx").alias("__q"),
    )
    return merged.select(
        "job_id", "ref", "designation", "price", F.when(F.col("__q.qty").isNotNull(), F.col("__sum")).alias("qty"),
        (F.row_number().over(Window.partitionBy("job_id").orderBy(F.col("__key").startswith("\0"), "__first")) - 1).alias("idx"),
    )


def link_references(bc_ref: Column, other_ref: Column, distance: int = 2) -> tuple[Column, Column, Column]:
    """JN5: linked, confidence, fuzzy. A missing other reference is linked at 0.70."""
    a, b = X.match_key(bc_ref), X.match_key(other_ref)
    missing = F.coalesce(F.trim(other_ref), F.lit("")) == ""
    exact = (a != "") & (a == b)
    d = F.levenshtein(a, b, distance)
    near = (a != "") & (b != "") & (d >= 0) & ~exact
    longest = F.greatest(F.length(a), F.length(b))
    confidence = F.when(missing, F.lit(0.70)).when(exact, F.lit(1.0)).when(near, 1 - d / longest)
    return missing | exact | near, confidence, ~missing & near


def dominant_rate(lines: DataFrame) -> DataFrame:
    """AGG4: job_id, rate. The most frequent plausible rate at two decimals, the first seen among equals, if it has two
    lines and 60%."""
    ok = lines.where("tva between 0 and 30").withColumn("rate", F.bround("tva", 2))
    counts = ok.groupBy("job_id", "rate").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    best = counts.groupBy("job_id").agg(F.max_by(F.struct("rate", "n"), F.struct("n", -F.col("first"))).alias("b"), F.sum("n").alias("total"))
    return best.where((F.col("b.n") >= 2) & (F.col("b.n") >= F.lit(0.60) * F.col("total"))).select("job_id", F.col("b.rate").alias("rate"))


def total_gate(bc: DataFrame, fac: DataFrame, pairs: DataFrame, totals: DataFrame, t: Tolerances = DEFAULT) -> DataFrame:
    """AGG6: job_id, force. pairs: job_id, bc_idx, doc_idx of invoices; totals: job_id, total_ht."""
    current = F.coalesce(X.nonzero("total"), F.col("qty") * F.col("price"))
    lines = fac.select("job_id", F.col("idx").alias("doc_idx"), current.alias("current"))
    order = bc.select("job_id", F.col("idx").alias("bc_idx"), (F.col("qty") * F.col("price")).alias("bc_total"))
    at = lines.join(pairs.select("job_id", "bc_idx", "doc_idx"), ["job_id", "doc_idx"], "left").join(order, ["job_id", "bc_idx"], "left")
    changed = F.col("bc_total").isNotNull() & ~totals_agree(F.col("current"), F.col("bc_total"), t)
    sums = at.groupBy("job_id").agg(
        F.sum("current").alias("cur"), F.sum(F.coalesce("bc_total", "current")).alias("cand"), F.count_if(changed).alias("changed"),
        F.count_if(F.col("current").isNull()).alias("unknown"), F.count("bc_idx").alias("assigned"),
    ).join(totals, "job_id")
    tol = total_tolerance(t, F.col("total_ht"), F.col("cand"))
    now, then = F.abs(F.col("cur") - F.col("total_ht")), F.abs(F.col("cand") - F.col("total_ht"))
    force = (F.col("unknown") == 0) & (F.col("assigned") > 0) & (F.col("changed") > 0) & (then <= tol) & (now > tol) & (then + tol < now)
    return sums.select("job_id", F.coalesce(force, F.lit(False)).alias("force"))


def invoice_reconciled(bc_qty: Column, bc_price: Column, qty: Column, price: Column, total: Column, force: Column,
                       t: Tolerances = DEFAULT) -> tuple[Column, Column]:
    """REC1 and REC2: whether the invoice line takes the order's quantity and price, and the note."""
    bc_total, own, declared = bc_qty * bc_price, qty * price, X.nonzero(total)
    by_line = F.coalesce(bc_total.isNotNull() & declared.isNotNull() & totals_agree(declared, bc_total, t) & ~totals_agree(own, declared, t), F.lit(False))
    by_total = F.coalesce(bc_total.isNotNull() & force & ~totals_agree(own, bc_total, t), F.lit(False))
    return by_line | by_total, F.when(by_line, NOTE_LINE).when(by_total, NOTE_TOTAL)


def alias_targets(lines: DataFrame, aliases: DataFrame, keys: DataFrame) -> DataFrame:
    """JN12-JN14: lines with alias_target and alias_id. aliases: id, supplier_key, external_ref, internal_ref, is_active; keys:
    job_id, supplier_key, priority. The first supplier key by priority wins; later ones with another target are dropped."""
    active = aliases.where("is_active").select(
        "supplier_key", F.col("id").alias("alias_id"), X.match_key("external_ref").alias("__external"), X.match_key("internal_ref").alias("alias_target")
    )
    at = lines.withColumn("__external", X.match_key("ref"))
    wanted = at.select("job_id", "__external").where("__external <> ''").distinct().join(keys, "job_id")
    hits = wanted.join(active, ["supplier_key", "__external"])
    first = hits.groupBy("job_id", "__external").agg(F.min_by(F.struct("alias_target", "alias_id"), F.struct("priority", "alias_id")).alias("a"))
    out = at.join(first, ["job_id", "__external"], "left")
    return out.select(*[F.col(c) for c in lines.columns], F.col("a.alias_target").alias("alias_target"), F.col("a.alias_id").alias("alias_id"))


def three_way_match(bc: DataFrame, bl: DataFrame, fac: DataFrame, invoices: DataFrame, t: Tolerances = DEFAULT, arbitration: DataFrame | None = None) -> DataFrame:
    """Line verdicts (§3.2). bc, bl, fac: job_id, idx, ref, designation, qty, price, tva, total, confidence and alias_target
    on bl and fac; bl already merged. invoices: job_id, total_ht, tva_rate. arbitration (VRD5): job_id, bc_idx, same, confidence."""
    def side(df: DataFrame, name: str) -> DataFrame:
        target = F.col("alias_target") if "alias_target" in df.columns else F.lit(None).cast("string")
        return df.select("job_id", F.lit(name).alias("side"), "idx", X.match_key("ref").alias("ref"), X.description("designation").alias("description"), "price", target.alias("alias_target"))

    # four joins read the pairs: they are written once, so each job is solved once
    pairs = stored(assign_lines(side(bc, "BC").unionByName(side(bl, "BL")).unionByName(side(fac, "FACTURE"))), "pairs")
    both = pairs.groupBy("job_id", "bc_idx").agg(
        *[F.max(F.when(F.col("side") == s, F.struct("doc_idx", "confidence", "layer"))).alias(s) for s in ("BL", "FACTURE")]
    )
    gate = total_gate(bc, fac, pairs.where("side = 'FACTURE'"), invoices.select("job_id", "total_ht"), t)
    trusted = invoices.join(dominant_rate(fac), "job_id", "left").select(
        "job_id", F.coalesce("rate", F.when(F.col("tva_rate").between(0, 30), F.col("tva_rate"))).alias("trusted")
    )
    fields = ("ref", "designation", "qty", "price", "tva", "total", "confidence")
    named = lambda df, p: df.select("job_id", F.col("idx").alias(f"{p}_idx"), *[F.col(c).alias(f"{p}_{c}") for c in fields])
    at = named(bc, "bc").join(both, ["job_id", "bc_idx"], "left").withColumn("bl_idx", F.col("BL.doc_idx")).withColumn("fac_idx", F.col("FACTURE.doc_idx"))
    at = at.join(named(bl, "bl"), ["job_id", "bl_idx"], "left").join(named(fac, "fac"), ["job_id", "fac_idx"], "left")
    at = at.join(gate, "job_id", "left").join(trusted, "job_id", "left")
    at = at.join(bl.select("job_id").distinct().withColumn("any_bl", F.lit(True)), "job_id", "left")
    if arbitration is not None:
        at = at.join(arbitration.select("job_id", "bc_idx", F.col("same").alias("__same"), F.col("confidence").alias("__conf")), ["job_id", "bc_idx"], "left")
    else:
        at = at.withColumn("__same", F.lit(False)).withColumn("__conf", F.lit(0.0))
    compared = _compare(at, t)
    extra = _extra(bl, pairs, "BL", NOTE_EXTRA_BL).where("keep").unionByName(_extra(fac, pairs, "FACTURE", NOTE_EXTRA_FAC)).drop("keep")
    return compared.unionByName(extra)


def _compare(at: DataFrame, t: Tolerances) -> DataFrame:
    has_bl, has_fac = F.col("bl_idx").isNotNull(), F.col("fac_idx").isNotNull()
    c_bl, c_fac = F.col("BL.confidence"), F.col("FACTURE.confidence")
    by_bl = has_bl & (~has_fac | (c_bl >= c_fac))
    layer = F.when(by_bl, F.col("BL.layer")).otherwise(F.col("FACTURE.layer"))
    conf = F.coalesce(F.when(by_bl, c_bl).otherwise(c_fac), F.lit(1.0))
    settled = has_fac & conf.between(0.50, MATCH_AT - 1e-12) & F.coalesce(F.col("__same") & (F.col("__conf") >= UNSURE), F.lit(False))
    alias = F.coalesce(layer == 6, F.lit(False))
    copied, note = invoice_reconciled(F.col("bc_qty"), F.col("bc_price"), F.col("fac_qty"), F.col("fac_price"), F.col("fac_total"), F.coalesce("force", F.lit(False)), t)
    copied = has_fac & copied
    out = at.withColumn("__layer", F.when(settled, 5).otherwise(F.coalesce(layer, F.lit(0)))).withColumn(
        "__conf1", F.when(settled, F.greatest(conf, F.col("__conf"))).otherwise(conf)
    )
    out = out.withColumn("__note", F.when(copied, note)).withColumn("__fq", X.nonzero(F.when(copied, F.col("bc_qty")).otherwise(F.col("fac_qty"))))
    out = out.withColumn("__fp0", F.when(copied, F.col("bc_price")).otherwise(F.col("fac_price"))).withColumn("__alias", alias)
    bq, lq, fq = X.nonzero("bc_qty"), X.nonzero("bl_qty"), F.col("__fq")
    bp, fp0 = X.nonzero("bc_price"), X.nonzero("__fp0")
    shift = X.shift_repaired(bp, fp0)
    shifted = F.coalesce(shift != fp0, F.lit(False)) & has_fac
    extraction = F.least(F.col("bc_confidence"), F.coalesce("bl_confidence", F.lit(1.0)), F.coalesce("fac_confidence", F.lit(1.0)))
    extraction = F.when(alias, F.greatest(extraction, F.lit(0.80))).otherwise(extraction)
    extraction = F.when(shifted, F.least(extraction, F.lit(0.65))).otherwise(extraction)
    ok_bl, warn_bl = compare_quantities(bq, lq, _lit(t.qty), True)
    ok_fac, warn_fac = compare_quantities(bq, fq, _lit(t.qty), t.invoice_allow_partial)
    bad_price = F.abs(bp - shift) > _lit(max(t.price, 0.100))
    tb, tf, rate_note = reconcile_rates(F.col("bc_tva"), F.col("fac_tva"), F.col("trusted"), t)
    bad_rate = has_fac & F.coalesce((tb != 0) & (tf != 0), F.lit(False)) & ~rates_agree(tb, tf, t)
    bad = F.array_compact(F.array(
        F.when(has_bl & ~ok_bl, "qty_bc_vs_bl"), F.when(has_fac & ~ok_fac, "qty_bc_vs_facture"),
        F.when(has_fac & bad_price, "prix_unitaire"), F.when(bad_rate, "tva_rate"),
    ))
    notes = F.concat_ws(
        "; ", F.col("__note"), F.when(alias, F.lit("Reference alias applied")), F.when(has_bl & ok_bl, F.concat(F.lit("BL: "), warn_bl)),
        F.when(has_fac & ok_fac, F.concat(F.lit("FACTURE: "), warn_fac)), rate_note,
    )
    partial = F.coalesce(has_bl & ok_bl & (warn_bl == "PARTIAL_DELIVERY"), F.lit(False)) | F.coalesce(has_fac & ok_fac & (warn_fac == "PARTIAL_DELIVERY"), F.lit(False))
    absent, missing = F.col("any_bl").isNull() & ~has_fac, F.col("any_bl").isNotNull() & ~has_bl & ~has_fac
    gone = absent | missing
    verdict = F.when(gone, "MISSING").otherwise(line_verdict(has_bl | has_fac, F.size(bad), partial, F.col("__conf1"), extraction))
    safe = lambda r: F.coalesce(F.nullif(r, F.lit("")), F.col("bc_designation"), F.concat(F.lit("line_"), F.col("bc_idx").cast("string")))
    return out.select(
        "job_id", F.lit(0).alias("part"), F.col("bc_idx").alias("ord"),
        F.when(missing, F.coalesce(X.safe_reference("bc_ref"), F.concat(F.lit("line_"), F.col("bc_idx").cast("string")))).otherwise(safe(F.col("bc_ref"))).alias("ref_produit"),
        F.col("bl_ref").alias("ref_produit_bl"), F.col("fac_ref").alias("ref_produit_facture"), F.col("bc_designation").alias("designation"),
        bq.cast("double").alias("qty_bc"), lq.cast("double").alias("qty_bl"), fq.cast("double").alias("qty_facture"),
        bp.cast("double").alias("prix_bc"), shift.cast("double").alias("prix_facture"), tb.cast("double").alias("tva_bc"), tf.cast("double").alias("tva_facture"),
        verdict.alias("verdict"),
        F.when(absent, F.array().cast("array<string>")).when(missing, F.array(F.lit("ref_produit"))).otherwise(bad).alias("mismatch_fields"),
        F.when(gone, F.lit(1.0)).otherwise(F.least(extraction, F.col("__conf1"))).alias("confidence"),
        F.when(gone, 0).otherwise(F.col("__layer")).cast("int").alias("match_layer"),
        F.when(absent, NOTE_ABSENT).when(missing, NOTE_MISSING).otherwise(F.nullif(notes, F.lit(""))).alias("notes"),
        (~gone & F.col("__alias")).alias("reference_alias_applied"),
    )


def _extra(lines: DataFrame, pairs: DataFrame, side: str, note: str) -> DataFrame:
    """JN10: document lines that no order line took."""
    taken = pairs.where(F.col("side") == side).select("job_id", F.col("doc_idx").alias("idx"))
    none = F.lit(None)
    bl = side == "BL"
    return lines.join(taken, ["job_id", "idx"], "left_anti").select(
        "job_id", F.lit(1 if bl else 2).alias("part"), F.col("idx").alias("ord"),
        F.coalesce(X.safe_reference("ref"), F.concat(F.lit("bl_extra_" if bl else "fac_extra_"), F.col("idx").cast("string"))).alias("ref_produit"),
        (F.col("ref") if bl else none.cast("string")).alias("ref_produit_bl"), (none.cast("string") if bl else F.col("ref")).alias("ref_produit_facture"),
        "designation", none.cast("double").alias("qty_bc"), (X.nonzero("qty").cast("double") if bl else none.cast("double")).alias("qty_bl"),
        (none.cast("double") if bl else X.nonzero("qty").cast("double")).alias("qty_facture"), none.cast("double").alias("prix_bc"),
        (none.cast("double") if bl else X.nonzero("price").cast("double")).alias("prix_facture"), none.cast("double").alias("tva_bc"),
        none.cast("double").alias("tva_facture"), F.lit("EXTRA").alias("verdict"), F.array(F.lit("ref_produit")).alias("mismatch_fields"),
        F.lit(1.0).alias("confidence"), F.lit(0).alias("match_layer"), F.lit(note).alias("notes"), F.lit(False).alias("reference_alias_applied"),
        (F.coalesce(F.col("ref") != "", F.lit(False)) | F.coalesce(F.col("price") != 0, F.lit(False))).alias("keep"),
    )


def match_results(verdicts: DataFrame, jobs: DataFrame) -> DataFrame:
    """AGG1-AGG3, VRD7, one row a job. jobs: job_id, has_order, has_invoice, n_warnings."""
    kinds = ("MATCH", "MISMATCH", "MISSING", "EXTRA", "LOW_CONFIDENCE", "PARTIAL_DATA", "PARTIAL_MATCH")
    counted = verdicts.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_lines"), *[F.count_if(F.col("verdict") == k).alias(k) for k in kinds], F.count_if(F.col("verdict").isin(*LOW)).alias("low")
    )
    at = jobs.join(counted, "job_id", "left").na.fill(0)
    verdict = global_verdict({k: F.col(k) for k in kinds}, F.col("has_invoice"), F.col("n_warnings"))
    return at.withColumn("global_verdict", verdict).select(
        "job_id", "global_verdict", final_status(F.col("global_verdict"), F.col("has_order")).alias("status"), "total_lines",
        F.col("MATCH").alias("match_count"), F.col("MISMATCH").alias("mismatch_count"), F.col("MISSING").alias("missing_count"),
        F.col("EXTRA").alias("extra_count"), F.col("low").alias("low_confidence_count"),
    )
