"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import importlib

# module, query function; a module's SQL is its twin, where SQL can express it
MODULES = (
    ("mixing", "op1_mixing"),
    ("toxicity", "op2_toxicity"),
    ("line_dedup", "op3_line_dedup"),
    ("token_count", "op4_token_count"),
    ("packing", "op5_best_fit_packing"),
    ("suffix_dedup", "op6_suffix_dedup"),
    ("fingerprint", "op7_fingerprint"),
    ("topk_search", "op8_topk_search"),
    ("near_dedup", "op9_near_dedup"),
    ("url_filter", "op10_url_filter"),
    ("exact_dedup", "op11_exact_dedup"),
    ("merkle", "op12_merkle_manifest"),
    ("collocations", "op13_collocations"),
)


def load() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for module, name in MODULES:
        m = importlib.import_module(f"{__package__}.{module}")
        queries[name] = getattr(m, name)
        if getattr(m, "SQL", None):
            sql[name] = m.SQL
    return queries, sql
