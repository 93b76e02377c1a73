"""Domains and URLs of earlier runs: read from history, CSV and JSON results; anti-joined; written.

A folder is what Spark wrote, one JSON record a line, and is read with a given schema. A
single file may also be one document: an array of records, an object with a list of
them, of any layout. What doesn't parse counts as missing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.text import stripped
from leadloom.functions.urls import domain_of
from leadloom.operators.validate import first_of_each
from leadloom.sources.files import exists, is_folder, swap_in

_EMPTY = "domain string"


def _domains(values: DataFrame) -> DataFrame:
    return values.select(domain_of(F.col("url")).alias("domain")).filter("domain <> ''").distinct()


def _document(spark: SparkSession, path: str) -> DataFrame | None:
    """``v``, the variant of a single file that is one JSON document; none if it isn't, or if its first of several lines is a whole object."""
    text = spark.read.text(path, wholetext=True).select(F.split(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")), r"\s*\n\s*").alias("lines"), "value")
    first = F.element_at("lines", 1)
    lined = (F.size("lines") > 1) & F.startswith(first, F.lit("{")) & F.try_parse_json(first).isNotNull()
    whole = text.filter(~lined).select(F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    return None if whole.isEmpty() else whole


def read_records(spark: SparkSession, path: str, columns: list[str], wrapper: str = "leads") -> DataFrame | None:
    """Records at ``path`` as string columns, null where a record lacks one, and ``_at``, their order; none if nothing is there."""
    if not exists(spark, path):
        return None
    schema = ", ".join(f"`{c}` string" for c in columns)
    whole = None if is_folder(spark, path) else _document(spark, path)
    if whole is None:
        lines = spark.read.schema(f"{schema}, _corrupt_record string").json(path)
        # A text array that isn't JSON lines gives nothing but corrupt rows.
        return lines.filter(F.coalesce(*columns).isNotNull()).select(*columns, F.monotonically_increasing_id().alias("_at"))
    items = lambda at: F.try_variant_get("v", at, "array<variant>")
    wrapped = F.try_variant_get("v", f"$.{wrapper}", "variant").isNotNull()
    single = F.when(F.try_variant_get("v", "$", "map<string,variant>").isNotNull() & ~wrapped, F.array("v"))
    rows = whole.select(F.posexplode(F.coalesce(items("$"), items(f"$.{wrapper}"), single)).alias("_at", "r")).filter(F.try_variant_get("r", "$", "map<string,variant>").isNotNull())
    return rows.select(*(F.try_variant_get("r", f"$.{c}", "string").alias(c) for c in columns), F.col("_at").cast("long").alias("_at"))


def read_list(spark: SparkSession, path: str, field: str) -> DataFrame:
    """``value``: all strings of the lists ``field`` of an object, or of one object a line."""
    empty = spark.createDataFrame([], "value string")
    if not exists(spark, path):
        return empty
    whole = None if is_folder(spark, path) else _document(spark, path)
    if whole is None:
        return spark.read.schema(f"`{field}` array<string>").json(path).select(F.explode(field).alias("value")).filter("value <> ''")
    values = whole.select(F.explode(F.try_variant_get("v", f"$.{field}", "array<variant>")).alias("x"))
    return values.select(F.try_variant_get("x", "$", "string").alias("value")).filter("value <> ''")


def _write_list(spark: SparkSession, values: DataFrame, field: str, path: str) -> None:
    """One value a line, in order; the new list is complete beside the old one before it takes its place."""
    new = f"{path}.{uuid.uuid4().hex}"
    values.orderBy("value").select(F.array("value").alias(field)).write.json(new)
    swap_in(spark, new, path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return read_list(spark, path, "domains").select(F.lower("value").alias("domain")).distinct()


def read_visited(spark: SparkSession, path: str) -> DataFrame:
    """URLs of the visited cache."""
    return read_list(spark, path, "urls").select(F.col("value").alias("url")).distinct()


def record_visited(spark: SparkSession, visited: DataFrame, path: str) -> None:
    """Adds the URLs that a crawl has visited to the cache, which is kept sorted."""
    both = read_visited(spark, path).union(visited.select("url")).filter("url IS NOT NULL").distinct()
    _write_list(spark, both.select(F.col("url").alias("value")), "urls", path)


def csv_domains(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], _EMPTY)
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    named = [c for c in ("source_website", "website") if c in df.columns]
    return _domains(df.select(F.explode(F.array(*named)).alias("url"))) if named else spark.createDataFrame([], _EMPTY)


def result_domains(spark: SparkSession, path: str) -> DataFrame:
    """Domains in JSON results, a list of records or one object with ``leads``; unlike CSV, their ``source_url`` counts too."""
    df = read_records(spark, path, ["website", "source_website", "source_url"])
    return spark.createDataFrame([], _EMPTY) if df is None else _domains(df.select(F.explode(F.array("website", "source_website", "source_url")).alias("url")))


def crawled_domains(spark: SparkSession, history: str, csv: str, results: str) -> DataFrame:
    return read_history(spark, history).union(csv_domains(spark, csv)).union(result_domains(spark, results)).distinct()


def new_urls(urls: DataFrame, domains: DataFrame, order: list[str], url: str = "url") -> DataFrame:
    """URLs with a domain that is not in ``domains``, the first of each domain. Spark broadcasts the anti-join's right side if it is small."""
    named = urls.withColumn("domain", domain_of(F.col(url))).filter("domain <> ''")
    return first_of_each(named.join(domains.select("domain"), "domain", "left_anti"), [F.col("domain")], order)


def flag_crawled(urls: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    known = domains.select("domain").distinct().withColumn("_k", F.lit(True))
    return urls.withColumn("domain", domain_of(F.col(url))).join(known, "domain", "left").withColumn("already_crawled", F.coalesce("_k", F.lit(False))).drop("_k")


def merged_domains(domains: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    return domains.select("domain").union(_domains(urls.select(F.col(url).alias("url")))).distinct()


def record(spark: SparkSession, urls: DataFrame, history: str, csv: str, results: str) -> None:
    """Writes the union of all domains so far, sorted, one for each line of the folder ``history``."""
    both = merged_domains(crawled_domains(spark, history, csv, results), urls)
    _write_list(spark, both.select(stripped(F.col("domain")).alias("value")), "domains", history)


def result_links(anchors: DataFrame, order: list[str], href: str = "href") -> DataFrame:
    """Of search result anchors the targets, engine redirects unwrapped: external sites only, the first of each in the given order."""
    from leadloom.functions.urls import is_external_site, normalize_url, search_target

    target: Column = F.coalesce(search_target(F.col(href)), normalize_url(F.col(href)))
    found = anchors.withColumn("url", target).filter("url IS NOT NULL").filter(is_external_site(F.col("url")))
    return first_of_each(found, [F.col("url")], order)


def select_discovered(results: DataFrame, domains: DataFrame, max_sites: int, with_agent: bool = True) -> DataFrame:
    """Of search results ``(engine_ord, rank, url)`` the first of each new external domain, in order, up to the caps."""
    order = ["engine_ord", "rank"]
    found = result_links(results, order, "url")
    picked = new_urls(found, domains, order).orderBy(*order).limit(2 * max_sites)
    return picked.orderBy(*order).limit(min(5, max_sites) if with_agent else max_sites)
