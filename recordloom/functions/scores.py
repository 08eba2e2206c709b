"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights every published score row satisfies.
WEIGHTS = {"rel": 0.45, "tech_overlap": 0.35, "novelty": 0.10, "actionability": 0.10}


def composite(parts: dict[str, Column], confidence: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the parts, scaled to half at confidence 0 and whole at confidence 1."""
    weights = WEIGHTS if weights is None else weights
    total = sum((F.lit(w) * parts[name] for name, w in weights.items()), F.lit(0.0))
    return total * (F.lit(0.5) + F.lit(0.5) * confidence)


def tokens(c: Column) -> Column:
    """Distinct lower-case words (runs of letters and digits)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def shared(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def token_overlap(record_tokens: Column, unit_tokens: Column) -> Column:
    """Share of the unit's words found in the record, 0 for a unit without words."""
    found = F.size(F.array_intersect(record_tokens, unit_tokens))
    return F.when(F.size(unit_tokens) > 0, found / F.size(unit_tokens)).otherwise(F.lit(0.0))
