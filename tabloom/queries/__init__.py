"""Registered queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["quality", "cleaning", "preparation", "models", "trees", "closed_forms", "scoring", "rules", "sources"]


def registered() -> dict:
    """``name -> (callable, sql or None)`` over all query modules."""
    out: dict = {}
    for module in MODULES:
        for name, entry in import_module(f"{__name__}.{module}").QUERIES.items():
            if name in out:
                raise ValueError(f"query {name!r} is registered twice")
            out[name] = entry
    return out
