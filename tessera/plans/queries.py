"""All queries of the library proper, and their SQL."""

from __future__ import annotations

from importlib import import_module

from tessera.plans.registry import QUERIES, SQL

MODULES = ("q_telemetry", "q_sessions", "q_records", "q_ranking", "q_rules", "q_listings", "q_choices", "q_hierarchy", "q_greedy", "q_pages", "q_naming", "q_sections", "q_shapes", "q_state")


def _load() -> None:
    for name in MODULES:
        import_module(f"tessera.plans.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
