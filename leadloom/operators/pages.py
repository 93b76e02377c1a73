"""Page operators: chunks of clean text, and the bundle of everything a page's source holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import entities, semi
from leadloom.functions import patterns as P
from leadloom.functions.classify import host_label
from leadloom.functions.text import chunks, clean_html, clean_name, unescape
from leadloom.functions.urls import _contains_any, _parts


def page_chunks(pages: DataFrame, max_chars: int = 3500, min_chars: int = 80) -> DataFrame:
    """``page_id, url, chunk_ord, text, section_hint``; only id, URL and HTML enter the Python worker."""
    text = pages.select("page_id", "url", clean_html("html").alias("_text")).filter(F.length("_text") >= min_chars)
    return text.select("page_id", "url", F.posexplode(chunks(F.col("_text"), max_chars, min_chars)).alias("chunk_ord", "c")).select("page_id", "url", "chunk_ord", "c.*")


def _meta(html: Column, *patterns: str) -> list[Column]:
    return [F.regexp_extract(html, "(?is)" + p, 1) for p in patterns]


def business_names(pages: DataFrame, decoded: Callable[[Column], Column] = unescape) -> DataFrame:
    """Adds ``business_name``: of site name, title property, JSON-LD names, first heading and title the first of two characters or more, else the host's label. Needs ``data``; ``decoded`` resolves entities."""
    html = F.coalesce(F.col("html"), F.lit(""))
    site = r"<meta[^>]+property=[\"']og:site_name[\"'][^>]+content=[\"']([^\"']+)[\"']"
    swapped = r"<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+property=[\"']og:site_name[\"']"
    title = r"<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']+)[\"']"
    before, after = _meta(html, site, swapped, title), _meta(html, r"<h1[^>]*>([^<]+)</h1>", r"<title[^>]*>([^<]+)</title>")
    mark = "\x00"
    joined = F.concat_ws(mark, *before, F.array_join("data.names", mark), *after)
    plain = pages.withColumn("_names", decoded(joined))
    fit = F.filter(F.transform(F.split("_names", mark), clean_name), lambda n: F.length(n) >= 2)
    return plain.withColumn("business_name", F.coalesce(F.try_element_at(fit, F.lit(1)), host_label(F.col("url")))).drop("_names")


def page_data(pages: DataFrame) -> DataFrame:
    """One row a page: e-mails, phones, addresses, contact and social URLs, name, hints and listing records."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    with_data = pages.select("page_id", "url", "html").withColumn("data", semi.structured(html, url))
    named = business_names(with_data)
    cuisine = [F.regexp_extract(html, rf"(?is)<meta[^>]+name=[\"']{k}[\"'][^>]+content=[\"']([^\"']+)[\"']", 1) for k in P.CUISINE_KEYS]
    cuisines = F.array_sort(F.array_distinct(F.filter(F.concat(F.col("data.cuisines"), F.array(*cuisine)), lambda c: c != "")))
    hinted = _contains_any(F.lower(html), P.RESTAURANT_WORDS) | F.col("data.business")
    tags = F.when(hinted, F.array(F.lit("restaurant"))).otherwise(F.array().cast("array<string>"))
    extra = F.map_filter(F.map_from_arrays(F.array(F.lit("tags"), F.lit("cuisine")), F.array(tags, cuisines)), lambda _, v: F.size(v) > 0)
    union = lambda a, b: F.array_sort(F.array_distinct(F.concat(a, b)))
    return named.select(
        "page_id",
        F.col("url").alias("source_url"),
        union(entities.emails(html), entities.mailto_emails(html)).alias("emails"),
        entities.html_phones(html).alias("phones"),
        union(F.col("data.addresses"), union(entities.street_addresses(html), entities.microdata_addresses(html))).alias("addresses"),
        entities.contact_urls(html, url).alias("contact_urls"),
        entities.social_urls(html, url).alias("social_urls"),
        "business_name",
        extra.alias("extra"),
        F.col("data.records").alias("listings"),
    )


def site_summary(data: DataFrame) -> DataFrame:
    """Pages of a host together: count, name of the first page with one, all contacts as sorted sets, and each listing once, in page order, with its page."""
    hosts = data.withColumn("site", F.lower(_parts(F.col("source_url"))[1]))
    rows = hosts.select("site", "page_id", F.posexplode(F.transform("listings", lambda r: F.struct(*(r[k].alias(k) for k in ("name", "email", "phone", "address", "social")), F.col("source_url").alias("page")))).alias("ord", "r"))
    key = [F.lower("r.name"), F.lower("r.email"), F.regexp_replace("r.phone", r"\D", "")]
    from leadloom.operators.validate import first_of_each

    rows = first_of_each(rows, [F.col("site"), *key], ["page_id", "ord"])
    found = rows.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "ord", "r"))), lambda x: x["r"]).alias("listings"))
    named = F.when(F.col("business_name") != "", F.col("page_id"))
    count = hosts.groupBy("site").agg(F.count(F.lit(1)).alias("pages_crawled"), F.min_by("business_name", named).alias("business_name"))
    # Values are made distinct before they are gathered: a site's many pages repeat theirs.
    kinds = ("emails", "phones", "addresses", "contact_urls", "social_urls")
    tagged = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))
    values = hosts.select("site", F.explode(F.concat(*map(tagged, kinds))).alias("v")).select("site", "v.*").distinct()
    sets = values.groupBy("site").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("x")))).alias(k) for k in kinds))
    none = F.array().cast("array<string>")
    out = count.join(sets, "site", "left").join(found, "site", "left")
    return out.withColumns({"listings": F.coalesce("listings", F.slice(F.array(F.lit(None).cast(found.schema["listings"].dataType.elementType)), 1, 0)), **{k: F.coalesce(k, none) for k in kinds}})
