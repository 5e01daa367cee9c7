"""Queries of this subpackage and their SQL, gathered for the entry module."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pii", "rule_ensemble", "latent_leaks", "toxicity", "secrets", "chat_preferences", "licenses", "quality_rules", "byte_bpe", "simhash")


def _gather(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"sparklex.llm.{name}"), attr)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
