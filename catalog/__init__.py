"""Runnable examples: the library bound to the TPC-H-like test tables, each with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("reports", "projection", "scalars", "relations", "checks", "links", "profiles", "storage")


def load() -> tuple[dict, dict]:
    for name in MODULES:
        import_module(f"catalog.{name}")
    return dict(QUERIES), dict(ORACLES)
