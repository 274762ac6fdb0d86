"""Registered queries: each operator run over the given tables, with its SQL check."""

from newsloom.catalog.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load"]


def load() -> None:
    """Import every module that registers queries."""
    from newsloom.catalog import (  # noqa: F401
        acquisition, caches, markup, pages, publishing, scalars, searching, selection, streams,
    )
