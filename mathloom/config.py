"""Thresholds of the question search."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchConfig:
    """The thresholds and sizes that results depend on."""

    recall_k: int = 80
    rerank_k: int = 32
    max_results: int = 3
    t_same: float = 0.90
    t_ocr_same: float = 0.82
    t_var: float = 0.85
    surface_gap: float = 0.08
    phash_hamming_max: int = 10
    min_final_score: float = 0.38
    unrelated_structure_max: float = 0.45
    drop_unrelated_before_rerank: bool = True
    visual_blend: float = 0.35
    t_formula: float = 0.82
    t_diagram: float = 0.62
    generic_stem_chars: int = 24
    max_features: int = 80_000
    containment_chars: int = 24
    formula_containment_chars: int = 12
    t_lost_fraction: float = 0.80
