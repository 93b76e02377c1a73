"""Sinks: append-merge of leads as JSON and CSV, listings, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadloom.operators.validate import first_of_each
from leadloom.schema import LEAD_FIELDS
from leadloom.sources.files import exists, swap_in
from leadloom.sources.history import read_records

_KEY = ("business_name", "email", "website")


def flat(leads: DataFrame) -> DataFrame:
    """Leads with tags as one string, the form in which they are kept."""
    return leads.withColumn("tags", F.concat_ws(", ", "tags"))


def append_merge(existing: DataFrame, new: DataFrame, order: list[str], fold_case: bool = True) -> DataFrame:
    """Existing rows, then new ones, the first of each key: lower-cased (JSON) or exact (CSV). Missing strings are ``''`` in either."""
    key = [F.lower(F.coalesce(c, F.lit(""))) if fold_case else F.coalesce(c, F.lit("")) for c in _KEY]
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    placed = ["_at"] if "_at" in existing.columns else []
    return first_of_each(both, key, ["_new", *placed, *order]).drop("_new", *placed)


def _kept(spark: SparkSession, path: str, kind: str, columns: list[str]) -> DataFrame | None:
    if kind == "csv":
        df = spark.read.csv(path, header=True, multiLine=True, escape='"') if exists(spark, path) else None
    else:
        df = read_records(spark, path, columns)
    if df is None or not set(_KEY) <= set(df.columns):
        return None
    numbers = ("confidence_score", "outreach_score", "ord")
    df = df if "_at" in df.columns else df.withColumn("_at", F.monotonically_increasing_id())
    return df.select("_at", *(F.col(c).cast("double" if c in numbers else "string").alias(c) if c in df.columns else F.lit(None).cast("double" if c in numbers else "string").alias(c) for c in columns)).fillna("")


def save(leads: DataFrame, path: str, kind: str = "json", append: bool = True, order: list[str] | None = None) -> DataFrame:
    """Merges leads into the folder ``path``: written beside it, then swapped in. Returns what is there now.

    An empty CSV result writes nothing; an empty JSON result still writes the merged rows. A file that can't be read counts as none.
    JSON is written as one record a line; a file that holds one array, or an object with ``leads``, is read as well.
    """
    spark = leads.sparkSession
    order = order or list(LEAD_FIELDS)
    new = flat(leads).select(*LEAD_FIELDS, *(c for c in order if c not in LEAD_FIELDS))
    old = _kept(spark, path, kind, list(LEAD_FIELDS)) if append else None
    if kind == "csv" and new.isEmpty():
        return (old if old is not None else new).select(*LEAD_FIELDS)
    if old is not None:
        rows = append_merge(old, new, order, fold_case=kind == "json")
    else:
        rows = append_merge(new.limit(0), new, order) if kind == "json" else new
    rows = rows.select(*LEAD_FIELDS)
    beside = f"{path}.{uuid.uuid4().hex}"
    writer = rows.write
    writer.json(beside, ignoreNullFields=False) if kind == "json" else writer.csv(beside, header=True, escape='"', quoteAll=True)
    swap_in(spark, beside, path)
    kept = _kept(spark, path, kind, list(LEAD_FIELDS))
    return rows.limit(0) if kept is None else kept.select(*LEAD_FIELDS)


def export_array(leads: DataFrame, path: str, order: list[str]) -> None:
    """One file with one JSON array of all leads, for whoever reads no lines: rows are sorted and stream through one task."""
    last = F.lead(F.lit(False), 1, True).over(W.orderBy(*order))
    rows = flat(leads).withColumn("_last", last).withColumn("_at", F.row_number().over(W.orderBy(*order)))
    line = F.concat(F.lit("  "), F.to_json(F.struct(*LEAD_FIELDS), {"ignoreNullFields": "false"}), F.when(F.col("_last"), "").otherwise(","))
    edges = leads.sparkSession.createDataFrame([(0, "["), (1 << 31, "]")], "at long, value string")
    text = edges.union(rows.select(F.col("_at").cast("long"), line)).orderBy("at").select("value").coalesce(1)
    beside = f"{path}.{uuid.uuid4().hex}"
    text.write.text(beside)
    swap_in(leads.sparkSession, beside, path)


def listing_rows(sites: DataFrame) -> DataFrame:
    """One row for each listing of each site, its social URLs as one sorted string, the first of each (site, name, email, phone)."""
    rows = sites.select(F.col("site").alias("source_website"), F.posexplode("listings").alias("ord", "r"))
    rows = rows.select("source_website", "ord", "r.name", "r.email", "r.phone", "r.address", F.array_join(F.array_sort("r.social"), "; ").alias("social_urls"), "r.page")
    return first_of_each(rows, [F.col(c) for c in ("source_website", "name", "email", "phone")], ["ord"])


def report(sites: DataFrame) -> DataFrame:
    """``site, block``: the text block of each site, with its listings numbered."""
    or_else = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", F.lit(other)).otherwise(c)
    rule = "=" * 80

    def listing(r, i):
        lines = F.concat_ws(
            "\n",
            F.concat(F.lit("--- Restaurant "), (i + 1).cast("string"), F.lit(" ---")),
            F.concat(F.lit("Name:    "), or_else(r["name"], "(unknown)")),
            F.concat(F.lit("Email:   "), or_else(r["email"], "(none)")),
            F.concat(F.lit("Phone:   "), or_else(r["phone"], "(none)")),
            F.concat(F.lit("Social:  "), or_else(F.array_join(F.array_sort(r["social"]), "; "), "(none)")),
            F.concat(F.lit("Address: "), or_else(r["address"], "(none)")),
            F.when(F.coalesce(r["page"], F.lit("")) != "", F.concat(F.lit("Page:    "), r["page"])),
        )
        return F.concat(lines, F.lit("\n"))

    head = F.concat_ws(
        "\n",
        F.lit(rule),
        F.concat(F.lit("SITE: "), F.col("site")),
        F.concat(F.lit("Site Name: "), or_else(F.col("business_name"), "(unknown)")),
        F.concat(F.lit("Pages Crawled: "), F.col("pages_crawled").cast("string")),
        F.concat(F.lit("Restaurants Found: "), F.size("listings").cast("string")),
        F.lit(rule),
        F.lit(""),
    )
    body = F.when(F.size("listings") > 0, F.array_join(F.transform("listings", listing), "\n")).otherwise(F.lit("(no individual restaurant records extracted)\n"))
    return sites.select("site", F.concat(head, F.lit("\n"), body).alias("block"))


def report_header(sites: DataFrame) -> DataFrame:
    """``sites, listings, header``: what stands above the blocks of a run."""
    counts = sites.agg(F.count(F.lit(1)).alias("sites"), F.coalesce(F.sum(F.size("listings")), F.lit(0)).alias("listings"))
    lines = F.concat_ws("\n", F.lit("LEAD SCRAPER OUTPUT"), F.concat(F.lit("Sites crawled this run: "), F.col("sites")), F.concat(F.lit("Restaurants this run: "), F.col("listings")), F.lit(""))
    return counts.withColumn("header", lines)


def save_report(sites: DataFrame, path: str) -> None:
    """Adds a run's blocks to the folder of text files ``path``: a header in the first run only, then each site's block, by site."""
    spark = sites.sparkSession
    old = spark.read.text(path) if exists(spark, path) else None
    blocks = report(sites).orderBy("site").select(F.col("block").alias("value"))
    if old is not None:
        if not sites.isEmpty():
            blocks.write.mode("append").text(path)
        return
    head = report_header(sites).select(F.when(F.col("sites") > 0, F.col("header")).otherwise(F.concat("header", F.lit("\n(no new sites crawled this run)"))).alias("value"))
    head.coalesce(1).write.text(path)
    blocks.write.mode("append").text(path)


def save_listings(sites: DataFrame, path: str) -> DataFrame:
    """Merges a run's listings into the CSV folder ``path``; without any listing and file, the header alone is written. Returns what is there now."""
    spark, new = sites.sparkSession, listing_rows(sites)
    columns = [("source_website", "source_website"), ("restaurant_name", "name"), ("email", "email"), ("phone", "phone"), ("address", "address"), ("social", "social_urls"), ("source_page", "page")]
    new = new.select("ord", *(F.coalesce(F.col(b), F.lit("")).alias(a) for a, b in columns))
    names = [a for a, _ in columns]
    read = lambda: spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, header=True, multiLine=True, escape='"').fillna("")
    old = read() if exists(spark, path) else None
    if new.isEmpty() and old is not None:
        return old
    both = new.withColumn("_new", F.lit(1))
    if old is not None:
        both = old.withColumns({"_new": F.lit(0), "ord": F.lit(0)}).unionByName(both)
    rows = first_of_each(both, [F.col(c) for c in names[:4]], ["_new", "ord", "source_page"]).select(names)
    beside = f"{path}.{uuid.uuid4().hex}"
    (rows.coalesce(1) if new.isEmpty() else rows).write.csv(beside, header=True, escape='"', quoteAll=True)
    swap_in(spark, beside, path)
    return read()


def preview(leads: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first rows for a console, blanks as dashes."""
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(F.col(c)).alias(c)
    return leads.orderBy(F.desc("outreach_score"), *order).limit(n).select(*(dash(c) for c in ("business_name", "email", "phone", "website")), "outreach_score")
