"""Operators of a training-data pipeline over documents, pages and vectors."""

from recordloom.llm import (
    byte_bpe,
    conversation_repair,
    exact_dedup,
    hard_negatives,
    language_id,
    mixing,
    near_dedup,
    permutation_index,
    stretch_dedup,
    subspace_dedup,
    token_counts,
    toxicity,
    unit_dedup,
    url_filter,
)
from recordloom.llm.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES",
    "byte_bpe",
    "conversation_repair",
    "exact_dedup",
    "hard_negatives",
    "language_id",
    "mixing",
    "near_dedup",
    "permutation_index",
    "stretch_dedup",
    "subspace_dedup",
    "token_counts",
    "toxicity",
    "unit_dedup",
    "url_filter",
]
