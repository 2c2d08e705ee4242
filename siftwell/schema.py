"""Tables of an index and the settings that shape results (S9, D10 and the settings' bounds)."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

FORMAT = "4"
TABLES = {
    "files": "path string, path_lc string, modified_time_ns long, size_bytes long, content_hash string, language string, source_text string, line_count int",
    "symbols": "id string, name string, qualified_name string, kind string, path string, start_line int, end_line int, source_snippet string, language string",
    "chunks": "id string, path string, start_line long, end_line long, symbol_id string, text string, content_hash string, language string, kind string",
    "embeddings": "chunk_id string, path string, content_hash string, vector array<double>",
    "graph_nodes": "id string, path string, kind string, qualified_name string, name string, start_line int, end_line int, symbol_id string",
    "graph_facts": "id string, path string, ordinal int, kind string, source_node string, target_reference string, source_scope string, module string, start_line int, end_line int, confidence double, target_kind string, hint string, hint_method string, evidence string",
    "postings": "document string, path string, column string, term string, tf long",
    "document_sizes": "document string, path string, dl long",
}
DERIVED = {
    "graph_status": "id string, path string, status string, method string",
    "graph_edges": "id string, source string, target string, kind string, source_file string, start_line int, end_line int, method string, confidence double",
}


@dataclass(frozen=True)
class Settings:
    fuzzy_threshold: float = 0.55
    most_fuzzy_candidates: int | None = 512
    rrf_k: int = 60
    pool: int = 20
    rrf_weights: dict = field(default_factory=lambda: {"lexical": 1.0, "semantic": 1.0})
    weighted_weights: dict = field(default_factory=lambda: {"lexical": 0.5, "semantic": 0.5})
    missing_value: float = 0.0
    score_floor: float | None = None
    graph_seeds: int = 5
    graph_hops: int = 1
    graph_neighbours: int = 20
    graph_expanded: int = 50
    graph_confidence: float = 0.55
    graph_decay: float = 0.7
    dimension: int = 64
    snippet_chars: int = 12_000
    total_chars: int = 64_000
    window_lines: int = 100
    window_overlap: int = 20
    chunks_per_file: int = 2048

    def __post_init__(self) -> None:
        for name, low, high in (("fuzzy_threshold", 0, 1), ("graph_hops", 1, 2), ("graph_neighbours", 1, 100), ("graph_expanded", 1, 200), ("pool", 1, 20), ("graph_decay", 0, 1), ("snippet_chars", 1, 32_000)):
            if not low <= getattr(self, name) <= high or not math.isfinite(getattr(self, name)):
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.window_overlap >= self.window_lines:
            raise ValueError("windows must be longer than their overlap")

    def as_dict(self) -> dict:
        return asdict(self)
