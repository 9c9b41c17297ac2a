"""Thresholds of the quality filter and sizes of the training layout."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class FilterConfig:
    """One setting of the metadata quality filter; see operators.filters.predicates."""

    min_aesthetic: float = 6.5
    min_similarity: float = 0.28
    min_side: int = 512
    min_aspect: float = 0.5
    max_aspect: float = 2.0
    min_caption: int = 20
    max_caption: int = 300
    max_watermark: float = 0.5
    allow_nsfw: bool = False
    max_nsfw_score: float = 0.2


BROAD = FilterConfig()
REFINED = replace(BROAD, min_aesthetic=7.5, min_similarity=0.30, max_watermark=0.15)

#: Training layout.
TOKENS = 77
LATENT_SHAPE = (4, 64, 64)
LATENT_BYTES = 4 * 64 * 64 * 2
SCALING = 0.18215
