"""The queries of this subpackage and the SQL that states some of them."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("canonical", "sampling", "near", "markup", "glyphs", "vectors", "bpe", "packing", "spans")


def _all(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), name, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
