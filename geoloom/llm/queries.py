"""Every operator's query; importing it fills the registry."""

from geoloom.llm import bpe, context_mixing, embedding_dedup, fingerprints, hard_negatives, language, line_dedup, mixing, near_dup, periodic_runs, quality, token_counts, toxicity  # noqa: F401
from geoloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
