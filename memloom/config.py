"""Defaults of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    wing: str = "work"
    fetch: int = 200
    rrf_k: int = 60
    mmr_weight: float = 0.5
    salience_weight: float = 0.10
    side_index_weight: float = 0.15
    backlink_weight: float = 0.12
    backlink_cap: float = 0.25
    predicate_weight: float = 0.10
    confidence_high: float = 0.80
    confidence_medium: float = 0.60
    confidence_proceed: float = 0.40
    least_score: float = 0.0
    wake_up_least: float = 0.25
    wake_up_budget: int = 3200
    wake_up_recent: int = 5
    wake_up_synthesis_least: int = 1600
    wake_up_tail_least: int = 600
    wake_up_semantic: int = 10
    admission_length: int = 80
    admission_symbols: float = 0.95
    admission_duplicate: float = 0.97
    governance: str = "balanced"
    recency_days: float = 14
    stale_days: float = 30
    stale_penalty: float = 0.2
    prune_protect: int = 3
    chunk_least: int = 80
    chunk_target: int = 800
    chunk_most: int = 1800
    topic_threshold: float = 0.60
    chunk_overlap: int = 0
    geometry_theta: float = 0.90
    prune_theta: float = 0.97
    regime_theta: float = 0.85
    pending_similarity: float = 0.55
    entity_merge: float = 0.82
    predicate_merge: float = 0.85
    anchor_size: int = 16
    task_k: int = 5
    task_prune_uses: int = 5
    task_prune_share: float = 0.5
    task_duplicate: float = 0.92
    question_duplicate: float = 0.90
    fact_confidence: float = 0.9
