"""Queries of this subpackage and their DuckDB SQL. Modules are imported when a query runs."""

from __future__ import annotations

from importlib import import_module

#: query: module
MODULES = {
    "op1_mixing": "mixing",
    "op2_language_id": "language",
    "op3_sharding": "sharding",
    "op4_html_extraction": "extract",
    "op5_quality_classifier": "quality",
    "op6_decontamination": "decontaminate",
    "op7_embedding_dedup": "embeddings",
    "op8_minhash_dedup": "minhash",
    "op9_warc": "warc",
    "op10_substring_dedup": "substring",
    "op11_suffix_array": "suffixes",
    "op12_merkle_manifest": "merkle",
    "op13_tokenizer_alignment": "align",
}


def _of(module: str):
    return lambda spark, sf_dir: import_module(f"ledgerloom.llm.{module}").query(spark, sf_dir)


def queries() -> dict:
    return {name: _of(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"ledgerloom.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
