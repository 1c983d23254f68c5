"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_dedup", "q_chat", "q_secrets", "q_topk", "q_packing", "q_substring", "q_jaccard", "q_toxicity", "q_perplexity", "q_pieces", "q_spelling", "q_whitening", "q_bpe")


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= import_module(f"tessera.llm.{name}").QUERIES
    return out | {"pipeline": import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= getattr(import_module(f"tessera.llm.{name}"), "SQL", {})
    return out
