"""The queries of the library's own operators, with their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("queries_text", "queries_search", "queries_classification", "queries_regression", "queries_curves", "queries_tokens")


def _gather(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"sparklex.plans.{name}"), attr)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
