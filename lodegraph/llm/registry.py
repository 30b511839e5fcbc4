"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, exact_topk, html_extraction, license_scans, media_columns, minhash_near_dedup, packing, secret_scans, substring_dedup, toxicity

_MODULES = {
    "op1_substring_dedup": substring_dedup,
    "op2_media_columns": media_columns,
    "op3_packing": packing,
    "op4_secret_scans": secret_scans,
    "op5_toxicity": toxicity,
    "op6_html_extraction": html_extraction,
    "op7_byte_bpe": byte_bpe,
    "op8_minhash_near_dedup": minhash_near_dedup,
    "op9_exact_topk": exact_topk,
    "op10_license_scans": license_scans,
}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict:
    return {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
