"""From text or pages to ranked leads: one lazy plan with one shuffle to drop repeats and one to sort."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.urls import normalize_url
from leadloom.operators import candidates as C
from leadloom.operators import validate as V
from leadloom.operators.pages import page_chunks
from leadloom.schema import LEAD_FIELDS, EngineConfig
from leadloom.sources.files import written

DOCUMENT_ORDER = ["doc_id", "cand_ord"]
PAGE_ORDER = ["page_id", "chunk_ord", "cand_ord"]


def document_texts(docs: DataFrame, min_chars: int = 80) -> DataFrame:
    """Documents as clean text of one chunk; the website is made of the source's name."""
    site = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"))
    return docs.filter(F.length("text") >= min_chars).select("doc_id", "text", site.alias("source_url"), site.alias("website"))


def document_candidates(docs: DataFrame) -> DataFrame:
    return C.heuristic(document_texts(docs))


def page_candidates(pages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    chunked = page_chunks(pages, config.max_chunk_chars, config.min_chunk_chars)
    site = F.coalesce(normalize_url(F.col("url")), F.col("url"))
    return C.heuristic(chunked.select("page_id", "chunk_ord", "text", F.col("url").alias("source_url"), site.alias("website")))


def leads(candidates: DataFrame, order: list[str], config: EngineConfig = EngineConfig()) -> DataFrame:
    """Accepted, scored, confident, ranked; with the order's columns.

    Whether anything passes decides on other rows, so candidates are asked for more than once:
    they are written, texts and pages are read once.
    """
    candidates = written(candidates, "candidates")
    taken = V.accepted(candidates, config.min_confidence, order, config.forced_candidates)
    return V.ranked(V.confident(V.scored(taken), config.min_confidence), order)


def document_leads(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return leads(document_candidates(docs), DOCUMENT_ORDER, config).select("doc_id", *LEAD_FIELDS)


def page_leads(pages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return leads(page_candidates(pages, config), PAGE_ORDER, config).select("page_id", *LEAD_FIELDS)


def thresholds(config: EngineConfig = EngineConfig()) -> list[float]:
    """The least confidence of each attempt."""
    out = [config.min_confidence]
    for _ in range(config.retry_attempts - 1):
        out.append(max(config.retry_floor, out[-1] - config.retry_step))
    return out


def with_retries(attempts: Iterable[Callable[[], DataFrame]], order: list[str], config: EngineConfig = EngineConfig()) -> DataFrame:
    """The leads of the first attempt that has any, each with a lower threshold and all other settings kept. An attempt is a function that gives its candidates."""
    out = None
    for attempt, least in zip(attempts, thresholds(config), strict=False):
        out = V.ranked(written(leads(attempt(), order, replace(config, min_confidence=least)), "attempt"), order)
        if not out.isEmpty():
            break
    if out is None:
        raise ValueError("no attempts")
    return out
