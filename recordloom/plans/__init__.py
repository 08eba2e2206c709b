"""Registered queries: each operator run over the given tables, with the same result in SQL."""

from recordloom.plans import extraction, files, joins, merging, normalising, ranking, selection, streams
from recordloom.plans.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "extraction", "files", "joins", "merging", "normalising", "ranking",
    "selection", "streams",
]
