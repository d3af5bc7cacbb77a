"""Registered queries over the driver's tables: each reference shape as a plan, with its SQL twin."""

from __future__ import annotations

from importlib import import_module


def registered() -> tuple[dict, dict]:
    for name in ("blocks", "layout", "paths", "entries", "scalars", "images"):
        import_module(f"blockloom.plans.{name}")
    from blockloom.plans.catalog import ORACLES, QUERIES

    return QUERIES, ORACLES
