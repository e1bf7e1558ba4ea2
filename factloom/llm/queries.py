"""Queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this folder that holds a function of that name.
MODULES = {
    "op1_quality_classifier": "quality",
    "op2_best_fit_packing": "packing",
    "op3_benchmark_decontamination": "decontamination",
    "op4_language_id": "language_id",
    "op5_warc": "warc",
    "op6_media_columns": "jpeg",
    "op7_license_scans": "licenses",
    "op8_sharding": "sharding",
    "op9_simhash_near_dedup": "simhash",
    "op10_token_counts": "token_counts",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
