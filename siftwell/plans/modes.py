"""The eight search modes over an index's tables, and the automatic router."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import is_identifier_like
from siftwell.operators import ranking as R

MODES = ("auto", "exact", "fuzzy", "graph", "hybrid_rrf", "hybrid_weighted", "lexical", "semantic")


def route(symbols: DataFrame, query: str, least: float = 0.55, most_candidates: int | None = None) -> str:
    """exact if a name is equal; else, for one that looks like an identifier, fuzzy if anything is near; else semantic."""
    if not R.exact(symbols, query, 1).isEmpty():
        return "exact"
    if is_identifier_like(query):
        try:
            if not R.fuzzy(symbols, query, 1, least, most_candidates).isEmpty():
                return "fuzzy"
        except OverflowError:
            pass
    return "semantic"


def config_id(name: str, settings: dict) -> str:
    text = json.dumps(settings, separators=(",", ":"), sort_keys=True)
    return f"{name}:{hashlib.sha256(text.encode()).hexdigest()[:12]}"


def located(rows: DataFrame) -> DataFrame:
    """Ranked rows in the shape that fusion takes: (rank, path, id, score)."""
    return rows.select("rank", "path", "id", F.col("score").cast("double").alias("score"))
