"""Validation, keep-first dedup, forced candidates, scores and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadloom.functions import patterns as P
from leadloom.functions.classify import heuristic_score, parsed_score
from leadloom.functions.entities import digits_of
from leadloom.functions.text import stripped
from leadloom.functions.urls import normalize_url


def valid_email(email: Column) -> Column:
    e = F.lower(stripped(email))
    domain = F.substring_index(e, "@", -1)
    return (email == "") | (F.rlike(e, F.lit(f"{P.U}(?i)^(?:{P.EMAIL})$")) & ~domain.isin(*P.DISPOSABLE_DOMAINS) & F.rlike(domain, F.lit(P.EMAIL_DOMAIN)))


def valid_phone(phone: Column) -> Column:
    return (phone == "") | F.length(digits_of(phone)).between(10, 15)


def first_of_each(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key in the given order: a window that Spark prunes before the shuffle."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


def dedup_key() -> list[Column]:
    return [F.lower(stripped(F.col(c))) for c in ("business_name", "email", "website")]


def validated(candidates: DataFrame, min_confidence: float, order: list[str]) -> DataFrame:
    """Candidates that pass, cleaned, the first of each key by ``order``. Cheap tests stand first."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    c = candidates.withColumns({k: blank(k) for k in ("business_name", "website", "email", "phone", "location", "niche")})
    c = c.filter((F.col("confidence_score") >= min_confidence) & (F.length("business_name") >= 2) & ((F.col("email") != "") | (F.col("phone") != "")))
    c = c.filter(valid_phone(F.col("phone"))).filter(valid_email(F.col("email")))
    c = c.withColumns(
        {
            "business_name": stripped(F.col("business_name")),
            "website": F.coalesce(normalize_url(F.col("website")), F.col("website")),
            "email": F.lower(stripped(F.col("email"))),
            "phone": stripped(F.col("phone")),
            "location": stripped(F.col("location")),
            "niche": F.when(F.col("niche") == "", F.lit("general")).otherwise(stripped(F.col("niche"))),
            "tags": F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("local business"))),
        }
    )
    return first_of_each(c, dedup_key(), order)


def accepted(candidates: DataFrame, min_confidence: float, order: list[str], forced: int = 5) -> DataFrame:
    """What validation keeps or, if that is nothing, the first ``forced`` candidates as they are. One flag, one row, is broadcast."""
    valid = validated(candidates, min_confidence, order)
    some = valid.limit(1).agg((F.count(F.lit(1)) > 0).alias("_some"))
    first = candidates.orderBy(*order).limit(forced).crossJoin(F.broadcast(some)).filter(~F.col("_some")).drop("_some")
    return valid.unionByName(first.select(valid.columns))


def scored(leads: DataFrame, response: str | None = None) -> DataFrame:
    """Adds ``outreach_score``: the number in a model's ``response``, 0 if it has none; by rule where there is no response (null)."""
    rule = heuristic_score(*(F.col(c) for c in ("email", "phone", "business_name", "website", "confidence_score")))
    return leads.withColumn("outreach_score", rule if response is None else F.when(F.col(response).isNotNull(), parsed_score(F.col(response))).otherwise(rule))


def counted(stage: DataFrame, name: str):
    """A stage and the observation of its rows: ``observation.get["rows"]``, known once an action has run, without one of its own."""
    seen = Observation(name)
    return stage.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def confident(leads: DataFrame, min_confidence: float) -> DataFrame:
    """Leads at or above the threshold; all of them if none is."""
    best = leads.agg((F.max("confidence_score") >= min_confidence).alias("_some"))
    return leads.crossJoin(F.broadcast(best)).filter(~F.col("_some") | (F.col("confidence_score") >= min_confidence)).drop("_some")


def ranked(leads: DataFrame, order: list[str]) -> DataFrame:
    return leads.orderBy(F.desc("outreach_score"), *order)


def above_score(leads: DataFrame, least: float = 4.0) -> DataFrame:
    return leads.filter(F.col("outreach_score") >= least)


def actionable(leads: DataFrame) -> DataFrame:
    return leads.filter((F.col("business_name") != "") & ((F.col("email") != "") | (F.col("phone") != "")) & (F.col("confidence_score") >= 0))


def reachable(leads: DataFrame, checked: DataFrame) -> DataFrame:
    """Leads without a website or whose website is in ``checked(url)``, the boundary to whatever tests it."""
    known = checked.select(normalize_url(F.col("url")).alias("_url")).filter("_url IS NOT NULL").distinct().withColumn("_ok", F.lit(True))
    joined = leads.withColumn("_url", normalize_url(F.col("website"))).join(known, "_url", "left")
    return joined.filter((F.col("website") == "") | F.col("_ok")).drop("_url", "_ok")
