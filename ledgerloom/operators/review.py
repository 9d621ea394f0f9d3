"""Review metrics, edits and alias approval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import matching as M
from ledgerloom.sources.scratch import stored

#: Rows of job ids that are copied to every task at once.
SMALL = 200_000


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(100.0 * part / whole + 0.5).cast("int"))


def quality_rates(results: DataFrame) -> DataFrame:
    """AGG16: validated, coverage and overall percentage of each job, from the counters of match_results."""
    m, x, e, s, r = (F.col(f"{k}_count") for k in ("match", "mismatch", "extra", "missing", "low_confidence"))
    validated, coverage = _percent(m, m + x + e + r), _percent(m + x + r, m + x + s + r)
    return results.withColumn("validated_pct", validated).withColumn("coverage_pct", coverage).withColumn("overall_pct", F.least(validated, coverage))


def source_quality(pages: DataFrame) -> DataFrame:
    """AGG16, by job and document type: mean classification and OCR percentage (100 for native and transcribed pages)
    and the set of sources. pages: job_id, doc_type, confidence, ocr_source, ocr_confidence."""
    ocr = F.when(F.col("ocr_source").isin("NATIVE", "TRANSCRIPTION"), 100).otherwise(X.percentage("ocr_confidence"))
    return pages.groupBy("job_id", "doc_type").agg(
        F.avg(X.percentage("confidence")).alias("classification_pct"), F.avg(ocr).alias("ocr_pct"), F.array_sort(F.collect_set("ocr_source")).alias("sources")
    )


def approve_aliases(known: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VRD10: the alias table after approvals, and the approvals that conflict with another internal reference.

    Both: supplier_key, external_ref, internal_ref, is_active, usage_count. An approved known alias is active again."""
    keyed = lambda df, p: df.select(F.col("supplier_key"), X.match_key("external_ref").alias("__k"), *[F.col(c).alias(f"{p}_{c}") for c in ("external_ref", "internal_ref", "is_active", "usage_count")])
    at = keyed(known, "old").join(keyed(approved, "new"), ["supplier_key", "__k"], "full")
    clash = F.col("old_internal_ref").isNotNull() & F.col("new_internal_ref").isNotNull() & (X.match_key("old_internal_ref") != X.match_key("new_internal_ref"))
    clash = F.coalesce(clash, F.lit(False))
    kept = at.select(
        "supplier_key", F.coalesce("old_external_ref", "new_external_ref").alias("external_ref"), F.coalesce("old_internal_ref", "new_internal_ref").alias("internal_ref"),
        F.when(F.col("new_external_ref").isNotNull() & ~clash, True).otherwise(F.col("old_is_active")).alias("is_active"),
        F.coalesce("old_usage_count", F.lit(0)).alias("usage_count"),
    )
    return kept, at.where(clash).select("supplier_key", F.col("new_external_ref").alias("external_ref"), F.col("new_internal_ref").alias("internal_ref"))


def count_usage(aliases: DataFrame, used: DataFrame) -> DataFrame:
    """SNK7: usage counters raised by the applications of a run. used: alias_id, used_at."""
    counts = used.groupBy(F.col("alias_id").alias("id")).agg(F.count(F.lit(1)).alias("__n"), F.max("used_at").alias("__at"))
    return aliases.join(counts, "id", "left").select(
        *[F.col(c) for c in aliases.columns if c not in ("usage_count", "last_used_at")],
        (F.col("usage_count") + F.coalesce("__n", F.lit(0))).alias("usage_count"), F.greatest("last_used_at", "__at").alias("last_used_at"),
    )


def edited(rows: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """VRD11: rows with the non-null fields of edits of the same keys."""
    fields = [c for c in edits.columns if c not in keys]
    new = edits.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields])
    return rows.join(new, keys, "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def extraction_report(found: DataFrame, expected: DataFrame) -> DataFrame:
    """AGG18: line recall and error of the total by document. found, expected: doc_id, n_lines, total_ttc, confidence."""
    e = expected.select("doc_id", F.col("n_lines").alias("__n"), F.col("total_ttc").alias("__t"))
    return e.join(found, "doc_id", "left").select(
        "doc_id", F.least(F.lit(1.0), F.coalesce("n_lines", F.lit(0)) / F.col("__n")).alias("recall"), (F.abs(F.col("total_ttc") - F.col("__t")) / F.col("__t")).alias("error"), "confidence"
    )


def assembled(documents: DataFrame, lines: DataFrame, results: DataFrame) -> DataFrame:
    """JN20 and VRD12: one nested row per job; lines in line order, a message while the job is not complete."""
    per_doc = lines.groupBy("job_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "ref_produit", "qty"))).alias("lines"))
    docs = documents.join(per_doc, ["job_id", "doc_id"], "left").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "doc_type", "lines"))).alias("documents"))
    done = F.col("status").isin("COMPLETED", "REVIEW_REQUIRED")
    return results.join(docs, "job_id", "left").select("job_id", "status", F.when(done, F.col("documents")).alias("documents"), F.when(~done, F.lit("not complete")).alias("message"))


def alias_order(aliases: DataFrame, keys: DataFrame) -> DataFrame:
    """SRT5: the active aliases of each job in the order of its supplier keys. aliases: id, supplier_key, is_active; keys: job_id, supplier_key, priority.

    Jobs with the same keys and priorities have the same order, which is ranked once: what is sorted is the aliases of each different list of keys, and a job's rows leave the
    join as they are written. The result has a row for every pair of a job and an alias of its keys, however it is made."""
    lists = keys.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("priority", "supplier_key"))).alias("list"))
    lists = stored(lists.select("job_id", "list", F.sha2(F.to_json("list"), 256).alias("kind")), "key-lists")
    kinds = lists.dropDuplicates(["kind"]).select("kind", F.explode("list").alias("k")).select("kind", "k.*")
    ranked = aliases.where("is_active").join(kinds, "supplier_key").withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("priority", "id")))
    return _multiplied(ranked, lists.select("job_id", "kind")).select("job_id", "id", "supplier_key", "priority", "place")


def _multiplied(few: DataFrame, many: DataFrame, blocks: int = 64) -> DataFrame:
    """Both by kind, where a kind may have all rows: those of few are dealt over all tasks, those of many meet them in blocks, copied to each."""
    n = max(blocks, int(few.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = few.repartition(n)
    rows = many.count()
    if rows <= SMALL:
        return dealt.join(F.broadcast(many), "kind")
    part = lambda i: many.where(F.pmod(F.xxhash64("job_id"), F.lit(parts)) == i)
    parts = -(-rows // SMALL)
    return reduce(DataFrame.unionByName, [dealt.join(F.broadcast(part(i)), "kind") for i in range(parts)])


SAVED = (
    "struct<ref_bc:string,ref_bl:string,ref_facture:string,ref_bc_linked:string,total_ht:decimal(18,4),tva_rate:decimal(9,4),lines:array<struct<line_number:int,ref_produit:string,designation:string,"
    "qty:decimal(18,4),prix_unitaire:decimal(18,4),tva_rate:decimal(9,4),total_ligne_ht:decimal(18,4),extraction_confidence:double>>,_corrupt_record:string>"
)
_FIELDS = ("line_number", "ref_produit", "designation", "qty", "prix_unitaire", "tva_rate", "total_ligne_ht", "extraction_confidence")


def saved_lines(documents: DataFrame, rows: DataFrame, source: str = "edited") -> DataFrame:
    """The documents of each job with the lines that a new match reads: job_id, doc_id, doc_type, ref_document, ref_bc_linked, total_ht, tva_rate, lines.

    documents: job_id, doc_id, doc_type, raw (the JSON as extracted), ref_document, ref_bc_linked, total_ht, tva_rate; rows: the stored lines, as edited since (job_id, doc_id and SAVED's
    line fields). By "edited" the rows count, and the JSON only for documents without any; by "raw" the JSON counts, and the rows where it is no valid document. Documents
    with neither are left out."""
    key = F.when(F.col("doc_type") == "BC", F.col("j.ref_bc")).when(F.col("doc_type") == "BL", F.col("j.ref_bl")).otherwise(F.col("j.ref_facture"))
    parsed = documents.withColumn("j", F.from_json("raw", SAVED, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    valid = F.coalesce(F.col("j._corrupt_record").isNull() & key.isNotNull() & F.col("j.lines").isNotNull(), F.lit(False))
    per = rows.groupBy("job_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("edited"))
    at = parsed.withColumn("valid", valid).join(per, ["job_id", "doc_id"], "left")
    by_rows = F.col("edited").isNotNull() if source == "edited" else ~F.col("valid") & F.col("edited").isNotNull()
    pick = lambda own, json: F.when(by_rows, own).otherwise(json)
    lines = F.when(by_rows, F.col("edited")).when(F.col("valid"), F.transform("j.lines", lambda x: F.struct(*[x[f].alias(f) for f in _FIELDS])))
    return at.select(
        "job_id", "doc_id", "doc_type", pick(F.col("ref_document"), key).alias("ref_document"), pick(F.col("ref_bc_linked"), F.col("j.ref_bc_linked")).alias("ref_bc_linked"),
        pick(F.col("total_ht"), F.col("j.total_ht")).alias("total_ht"), pick(F.col("tva_rate"), F.col("j.tva_rate")).alias("tva_rate"), lines.alias("lines"),
    ).where("lines is not null")


def rematch(documents: DataFrame, rows: DataFrame, saved: DataFrame, source: str = "edited", aliases: DataFrame | None = None, tolerances: M.Tolerances = M.DEFAULT) -> DataFrame:
    """VRD9: saved results matched again from the saved documents: job_id, status (which stays), the counters and global_verdict of the new run where a job has documents, else the
    saved ones, previous_verdict, and changed. saved: job_id, status and the columns of match_results. aliases: job_id, external_ref, alias_target.

    The document with most lines is the order (the last among equals) and the invoice (the first); deliveries are merged. Links that fail or are missing warn as in the first run."""
    # each step that is read several times is written once, so that no plan holds all of them
    at = stored(saved_lines(documents, rows, source), "saved")
    most = lambda last: F.row_number().over(Window.partitionBy("job_id", "doc_type").orderBy(F.desc(F.size("lines")), F.desc("doc_id") if last else F.asc("doc_id")))
    bc_doc = at.where("doc_type = 'BC'").withColumn("n", most(True)).where("n = 1")
    fac_doc = at.where("doc_type = 'FACTURE'").withColumn("n", most(False)).where("n = 1")
    bl_docs = at.where("doc_type = 'BL'").withColumn("doc_ord", F.row_number().over(Window.partitionBy("job_id").orderBy("doc_id")))

    def lines(df: DataFrame, *more: str) -> DataFrame:
        one = df.select("job_id", *more, F.posexplode("lines").alias("idx", "x"))
        conf = F.coalesce("x.extraction_confidence", F.lit(1.0))
        return one.select(
            "job_id", *more, "idx", F.col("x.ref_produit").alias("ref"), F.col("x.designation").alias("designation"), F.col("x.qty").alias("qty"), F.col("x.prix_unitaire").alias("price"),
            F.col("x.tva_rate").alias("tva"), F.col("x.total_ligne_ht").alias("total"), conf.alias("confidence"), (conf < 0.70).alias("low"),
        )

    def aliased(df: DataFrame) -> DataFrame:
        if aliases is None:
            return df.withColumn("alias_target", F.lit(None).cast("string"))
        known = aliases.select("job_id", X.match_key("external_ref").alias("__key"), X.match_key("alias_target").alias("alias_target"))
        return df.withColumn("__key", X.match_key("ref")).join(known, ["job_id", "__key"], "left").drop("__key")

    bc, bl, fac = lines(bc_doc), aliased(M.merge_deliveries(lines(bl_docs, "doc_ord"))), aliased(lines(fac_doc))
    verdicts = M.three_way_match(bc, stored(bl, "deliveries"), fac, fac_doc.select("job_id", "total_ht", "tva_rate"), tolerances)
    verdicts = stored(verdicts.select("job_id", "verdict"), "verdicts")
    order = bc_doc.select("job_id", F.col("ref_document").alias("bc_ref"))
    sides = bl_docs.where("doc_ord = 1").unionByName(fac_doc, allowMissingColumns=True).select("job_id", F.col("ref_bc_linked").alias("other")).join(order, "job_id")
    linked, _, _ = M.link_references(F.col("bc_ref"), F.col("other"))
    warned = sides.groupBy("job_id").agg(F.count_if(~linked | (F.coalesce(F.trim("other"), F.lit("")) == "")).cast("int").alias("n_warnings"))
    jobs = at.select("job_id").distinct().join(order.select("job_id", F.lit(True).alias("has_order")), "job_id", "left")
    jobs = jobs.join(fac_doc.select("job_id", F.lit(True).alias("has_invoice")), "job_id", "left").join(warned, "job_id", "left")
    jobs = jobs.select("job_id", F.coalesce("has_order", F.lit(False)).alias("has_order"), F.coalesce("has_invoice", F.lit(False)).alias("has_invoice"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"))
    again = M.match_results(verdicts, jobs)
    fields = [c for c in again.columns if c not in ("job_id", "status")]
    new = again.select("job_id", F.struct(*fields).alias("__new"))
    out = saved.join(new, "job_id", "left")
    return out.select(
        "job_id", "status", *[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in fields], F.col("global_verdict").alias("previous_verdict"),
        F.coalesce(F.col("__new.global_verdict") != F.col("global_verdict"), F.lit(False)).alias("changed"),
    )
