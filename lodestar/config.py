"""Values that define the retrieval and evaluation semantics."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_tokens: int = 512
    chunk_overlap: int = 100
    top_k: int = 100
    min_similarity: float = 0.4
    chars_per_token: int = 4
    context_tokens: int = 8000
    separator: str = "\n\n"
    seeds: int = 20
    seed_similarity: float = 0.4
    ppr_nodes: int = 100
    ppr_alpha: float = 0.85
    ppr_min_score: float = 1e-5
    ppr_rounds: int = 100
    ppr_epsilon: float = 1e-6
    iterative_rounds: int = 3
    faithful_similarity: float = 0.7
    hub_neighbours: int = 10
    path_nodes: int = 5000
    embedding_size: int = 64
    summary_documents: int = 5
    sample_seed: int = 42
    refusal: str = "I cannot answer this question from the given context."

    @property
    def stride(self) -> int:
        return self.chunk_tokens - self.chunk_overlap


DEFAULT = Config()
