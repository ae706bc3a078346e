"""All queries of the core and the SQL that states them."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("texts", "collections", "retrieval", "evaluation")
FLAGSHIP = "search_samples"


def _all(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(import_module(f"mathloom.plans.{m}"), name, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
