"""Readers with declared schemas, and the boundaries to what lies outside the engine.

PDF rendering, image clean-up, optical character recognition and model calls stay outside; their results enter as tables of
the schemas below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = (
    "struct<line_number:int,ref_produit:string,ref_produit_normalized:string,designation:string,qty:decimal(18,4),unit:string,prix_unitaire:decimal(18,4),"
    "tva_rate:decimal(9,4),total_ligne_ht:decimal(18,4),raw_reference:string,raw_designation:string,raw_qty:string,raw_unit_price:string,raw_total:string,"
    "line_confidence:double,extraction_confidence:double,field_confidence_map:map<string,double>,has_low_confidence:boolean>"
)
DOCUMENT = (
    "job_id string, doc_id string, doc_type string, pages array<int>, ref_document string, ref_bc_linked string, document_date date, supplier_name string, "
    "total_ht decimal(18,4), total_tva decimal(18,4), total_ttc decimal(18,4), tva_rate decimal(9,4), extraction_confidence double, extraction_tier int, "
    f"lines array<{LINE}>"
)
JOB = (
    "id string, status string, documents array<struct<id:string,doc_type:string,ref_document:string,total_ht:double,total_ttc:double,lines:array<struct<"
    "line_number:int,ref_produit:string,designation:string,qty:double,prix_unitaire:double,tva_rate:double,total_ligne_ht:double>>>>, "
    "match_result struct<global_verdict:string,line_verdicts:array<struct<ref_produit:string,verdict:string,confidence:double,match_layer:int>>>"
)
PAGE_FACTS = "job_id string, page_number int, char_count int, image_coverage double, raw_text string, width double, height double"
OCR_RAW = "job_id string, page_number int, text array<string>, conf array<int>, left array<int>, top array<int>, width array<int>, height array<int>, line_num array<int>, block_num array<int>, par_num array<int>"
ALIASES = "pdf string, internal_ref string, external_ref string, designation string, qty double, prix double, match_score int"
EVENT = "job_id string, event_type string, event_data string, actor string, created_at timestamp"


def pdf_uploads(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: uploaded files with length, digest and whether they look like a PDF; page counts come from outside."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"), "modificationTime")


def mined_aliases(spark: SparkSession, path: str) -> DataFrame:
    """SRC12."""
    return spark.read.csv(path, header=True, schema=ALIASES)


def seed_aliases(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: alias rows of INSERT statements, whatever table they name: the quoted values of each row in order."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*(INSERT|\()"))
    values = F.regexp_extract_all("value", F.lit(r"'((?:[^']|'')*)'"), 1)
    return lines.select(F.transform(values, lambda v: F.replace(v, F.lit("''"), F.lit("'"))).alias("values")).where(F.size("values") >= 2)


def job_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC14: nested job results; a job a file, or with lines a job a line."""
    return spark.read.schema(JOB).json(path, multiLine=not lines)


def job_lines(jobs: DataFrame) -> DataFrame:
    """The lines of nested job results, a row each."""
    docs = jobs.select(F.col("id").alias("job_id"), F.posexplode("documents").alias("doc_ord", "d"))
    return docs.select("job_id", "doc_ord", F.col("d.id").alias("doc_id"), "d.doc_type", F.posexplode("d.lines").alias("idx", "l")).select("job_id", "doc_ord", "doc_id", "doc_type", "idx", "l.*")


def page_counts(pages: DataFrame) -> DataFrame:
    """SRC4, AGG19: pages of each job, native and scanned ones."""
    return pages.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("source") == "NATIVE").alias("native"), F.count_if(F.col("source") == "SCANNED").alias("scanned"))
