"""Named queries over the driver tables. Importing a module of this package registers its queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("catalog_queries", "document_queries", "estimate_queries", "feed_queries", "release_queries")


def load_all() -> None:
    for name in MODULES:
        import_module(f"tarifold.plans.{name}")
