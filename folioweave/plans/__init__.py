"""Registered queries over the test tables."""

from folioweave.plans.registry import CHECKS, QUERIES, query

__all__ = ["CHECKS", "QUERIES", "load_all", "query"]


def load_all() -> None:
    """Import every module that registers queries."""
    from folioweave.plans import hits, catalog, chapters, extraction, lists, shelf, streams, texts, urls  # noqa: F401, I001
