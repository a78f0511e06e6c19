"""Settings that change results; the defaults are those of the service whose answers are to be matched."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    rerank_candidate_count: int = 30
    semantic_weight: float = 0.3
    keyword_weight: float = 0.2
    rerank_weight: float = 0.5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    out_of_scope_similarity: float = 0.25
    context_token_budget: int = 7000
    explain_chunks: int = 8
    specific_chunks: int = 4
    explain_window: int = 1
    specific_window: int = 0
    claim_support_threshold: float = 0.12
    claim_partial_threshold: float = 0.05
    citation_required: bool = True
    page_min_chars: int = 20
    page_min_words: int = 5
    page_image_coverage: float = 0.35
    page_trivial_coverage: float = 0.02
    page_suspicious_rate: float = 0.02
    page_min_word_length: float = 1.5
    quality_accept: float = 0.75
    quality_retry: float = 0.5
    quality_review: float = 0.3
    quality_max_retries: int = 2
    include_needs_review: bool = False
    citation_cap: int = 12
    single_shot_chars: int = 300_000
    section_batch: int = 10
    reduce_batch: int = 8
    vector_size: int = 1536


DEFAULTS = EngineConfig()
