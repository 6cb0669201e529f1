"""End-to-end plans, and the registered queries with the SQL they are held against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("posting_queries", "text_queries", "scoring_queries", "flow_queries")


def _registry():
    for name in MODULES:
        import_module(f"textmatch.plans.{name}")
    return import_module("textmatch.plans.registry")


def queries() -> dict:
    return dict(_registry().QUERIES)


def oracles() -> dict[str, str]:
    return dict(_registry().ORACLE)
