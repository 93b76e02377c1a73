"""Niches, tags, names and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import patterns as P
from leadloom.functions.text import stripped, title_case
from leadloom.functions.urls import registrable_domain


def _hits(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    return F.filter(F.array(*(F.when(hit(words), F.lit(name)) for name, words in P.NICHES.items())), lambda x: x.isNotNull())


def _or_local(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("local business")))


def niche(text: Column) -> Column:
    return F.coalesce(F.try_element_at(_hits(text), F.lit(1)), F.lit("general"))


def niche_tags(text: Column) -> Column:
    return _or_local(_hits(text))


def infer_tags(niche_name: Column, name: Column) -> Column:
    return _or_local(_hits(F.concat_ws(" ", F.coalesce(niche_name, F.lit("")), F.coalesce(name, F.lit("")))))


def host_label(url: Column) -> Column:
    return title_case(F.replace(F.substring_index(registrable_domain(url), ".", 1), F.lit("-"), F.lit(" ")))


def guess_name(text: Column, website: Column) -> Column:
    """The first of eight lines with 3 to 80 characters that is no URL, else the host's first label."""
    lines = F.transform(F.slice(F.split(text, P.LINES, 9), 1, 8), stripped)
    fit = F.filter(lines, lambda x: F.length(x).between(3, 80) & ~F.startswith(x, F.lit("http")))
    return F.coalesce(F.try_element_at(fit, F.lit(1)), host_label(website))


def heuristic_score(email: Column, phone: Column, name: Column, website: Column, confidence: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    gain = lambda test, by: F.when(test, F.lit(by)).otherwise(F.lit(0.0))
    total = F.lit(3.0) + gain(has(email), 2.5) + gain(has(phone), 2.0) + gain(F.length(F.coalesce(name, F.lit(""))) > 2, 1.5) + gain(has(website), 1.0) + gain(confidence >= 0.8, 1.0)
    return F.least(F.lit(10.0), total)


def parsed_score(response: Column) -> Column:
    """The first unsigned number of a response, within 0 and 10; 0 if there is none."""
    number = F.regexp_extract(F.coalesce(response, F.lit("")), r"(?U)(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.coalesce(F.least(F.lit(10.0), F.greatest(F.lit(0.0), number)), F.lit(0.0))
