"""Queries of the curation layer, with DuckDB SQL where SQL can express them."""

from importlib import import_module

from tessel.plans import _registry

MODULES = ("captions", "prompts", "selection", "planning", "scoring", "sources", "images", "streams")


def queries() -> dict:
    for name in MODULES:
        import_module(f"tessel.plans.{name}")
    return dict(_registry.QUERIES)


def sql() -> dict[str, str]:
    queries()
    return dict(_registry.SQL)
