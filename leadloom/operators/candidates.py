"""Rows of candidates from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import classify, entities, semi
from leadloom.functions.text import title_case
from leadloom.functions.urls import normalize_url, registrable_domain, urls_in_text
from leadloom.schema import CANDIDATE_SCHEMA

FIELDS = [f.split()[0] for f in CANDIDATE_SCHEMA.split(", ")]


def _row(name, website, email, phone, niche, tags, confidence, source) -> Column:
    empty = F.lit("")
    values = (name, website, email, phone, empty, niche, tags, confidence, source)
    return F.struct(*(v.alias(k) for k, v in zip(FIELDS, values, strict=True)))


def with_contacts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``emails`` and ``phones`` in a step of its own, so that each pattern runs once."""
    return df.withColumns({"emails": entities.emails(F.col(text)), "phones": entities.phones(F.col(text))})


def heuristic(df: DataFrame, text: str = "text", source: str = "source_url", website: str = "website") -> DataFrame:
    """One row for each candidate: five e-mails at most, else three phones, with ``cand_ord`` from 0. Rows without either go before anything else is computed."""
    t, w, s = F.col(text), F.col(website), F.col(source)
    found = with_contacts(df, text).filter((F.size("emails") > 0) | (F.size("phones") > 0))
    found = found.withColumns({"_name": classify.guess_name(t, w), "_niche": classify.niche(t), "_tags": classify.niche_tags(t)})
    confidence = F.when((F.size("emails") > 0) & (F.size("phones") > 0), F.lit(0.65)).otherwise(F.lit(0.6))
    first = F.coalesce(F.try_element_at(F.col("phones"), F.lit(1)), F.lit(""))
    row = lambda email, phone, c: _row(F.col("_name"), w, email, phone, F.col("_niche"), F.col("_tags"), c, s)
    rows = F.when(F.size("emails") > 0, F.transform(F.slice("emails", 1, 5), lambda e: row(e, first, confidence))).otherwise(
        F.transform(F.slice("phones", 1, 3), lambda p: row(F.lit(""), p, confidence - F.lit(0.05)))
    )
    kept = [c for c in df.columns if c not in (text, source, website, *FIELDS)]
    return found.select(*kept, F.posexplode(rows).alias("cand_ord", "c")).select(*kept, "cand_ord", "c.*")


def _exploded(df: DataFrame, kept: list[str], rows: Column) -> DataFrame:
    """A row for each struct of ``rows``. Exploded as an expression: of a plain column Catalyst would infer that it is not empty, and push that down through all the steps that made it, each inlined as often as it is used."""
    rows = F.concat(rows, F.slice(rows, 1, 0))
    return df.select(*kept, F.posexplode(rows).alias("cand_ord", "c")).select(*kept, "cand_ord", "c.*")


def with_fallback(df: DataFrame, text: str = "text", source: str = "source_url", website: str = "website") -> DataFrame:
    """Adds ``_f``, candidates by patterns alone: e-mails, else phones, else URLs; names from the host. In steps, so that nothing is computed twice."""
    nonblank = lambda c: F.when(c != "", c)
    out = with_contacts(df, text).withColumn("_urls", urls_in_text(F.col(text)))
    out = out.withColumn("_site", F.coalesce(nonblank(F.col(website)), nonblank(F.col(source)), F.try_element_at(F.col("_urls"), F.lit(1)), F.lit("")))
    site = F.col("_site")
    out = out.withColumn("_site", F.when((site == "") | F.startswith(site, F.lit("http")), site).otherwise(F.coalesce(normalize_url(site), site)))
    name = title_case(F.replace(F.replace(registrable_domain(site), F.lit("."), F.lit(" ")), F.lit("-"), F.lit(" ")))
    out = out.withColumn("_name", name).withColumn("_name", F.coalesce(nonblank(F.col("_name")), F.lit("Business")))
    out = out.withColumn("_tags", classify.infer_tags(F.lit(""), F.col("_name")))
    first = F.coalesce(F.try_element_at(F.col("phones"), F.lit(1)), F.lit(""))
    row = lambda w, e, p, c: _row(F.col("_name"), w, e, p, F.lit(""), F.col("_tags"), F.lit(c), F.col(source))
    rows = (
        F.when(F.size("emails") > 0, F.transform(F.slice("emails", 1, 5), lambda e: row(site, e, first, 0.55)))
        .when(F.size("phones") > 0, F.transform(F.slice("phones", 1, 3), lambda p: row(site, F.lit(""), p, 0.5)))
        .otherwise(F.array_distinct(F.transform(F.slice("_urls", 1, 3), lambda u: row(F.coalesce(normalize_url(u), u), F.lit(""), F.lit(""), 0.45))))
    )
    return out.withColumn("_f", rows).drop("emails", "phones", "_urls", "_site", "_name", "_tags")


def fallback(df: DataFrame, text: str = "text", source: str = "source_url", website: str = "website") -> DataFrame:
    kept = [c for c in df.columns if c not in (text, source, website, *FIELDS)]
    return _exploded(with_fallback(df, text, source, website), kept, F.col("_f"))


def model_or_heuristic(df: DataFrame, responses: list[str], text: str = "text", source: str = "source_url", website: str = "website") -> DataFrame:
    """Candidates from given model responses: the first response with any, followed by the fallback's.

    ``responses``: columns with the answers to the first, the repair and the strict prompt. All
    are columns of one row, so nothing is joined. Heuristics would follow where neither gives a
    row; they find e-mails and phones only, and the fallback has rows wherever those are.
    """
    kept = [c for c in df.columns if c not in (text, source, website, *responses, *FIELDS)]
    some = with_fallback(df, text, source, website)
    for i, r in enumerate(responses):
        some = semi.with_response(some, r, f"_a{i}", source, website)
    model = F.coalesce(*(F.when(F.size(f"_a{i}") > 0, F.col(f"_a{i}")) for i in range(len(responses))), F.slice("_f", 1, 0))
    return _exploded(some, kept, F.concat(model, F.col("_f")))
