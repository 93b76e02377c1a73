"""Record layouts and settings."""

from __future__ import annotations

from dataclasses import dataclass

#: Output columns, in order.
LEAD_FIELDS = ("business_name", "website", "email", "phone", "location", "niche", "tags", "confidence_score", "outreach_score", "source_url")

LEAD_SCHEMA = "business_name string, website string, email string, phone string, location string, niche string, tags array<string>, confidence_score double, outreach_score double, source_url string"

#: What fixes the order of candidates: site, page, chunk and place in the chunk.
ORDINALS = ("site_ord", "page_ord", "chunk_ord", "cand_ord")

CANDIDATE_SCHEMA = "business_name string, website string, email string, phone string, location string, niche string, tags array<string>, confidence_score double, source_url string"


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and caps; the defaults are fixed values."""

    min_confidence: float = 0.2
    max_depth: int = 2
    max_pages_per_site: int = 12
    max_links_per_page: int = 10
    max_chunk_chars: int = 3500
    min_chunk_chars: int = 80
    max_prompt_chars: int = 2000
    forced_candidates: int = 5
    retry_attempts: int = 3
    retry_step: float = 0.15
    retry_floor: float = 0.1
