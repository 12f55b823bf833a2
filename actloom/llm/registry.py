"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from . import chat_format, exact_dedup, license_scan, line_dedup, main_text, mixing, packing, prefix_trie, quality_classifier, quality_rules, simhash_dedup, spelling, substring_dedup

MODULES = (license_scan, quality_rules, mixing, exact_dedup, substring_dedup, chat_format, simhash_dedup, packing, line_dedup, quality_classifier, main_text, spelling, prefix_trie)


def queries() -> dict:
    found = {}
    for module in MODULES:
        found |= {n: getattr(module, n) for n in vars(module) if n.startswith("op") and n[2:3].isdigit()}
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= getattr(module, "SQL", {})
    return found
