"""Not-modified revisits: each is resolved to the latest earlier full response of its canonical URL.

An as-of join without a join: responses and revisits of a URL stand in one order of time,
and each revisit takes the last response before it. A URL's time line is cut into buckets
of ``BUCKET``; each bucket's last response is carried to the next ones over one row a bucket,
and within a bucket a window does the rest, so a URL with a third of all records
is spread over its buckets. Payloads take no part: records refer to them.

A revisit resolves if its validators hold: its ETag equals the response's (weakly, without
``W/``) or, where it has none, its Last-Modified does. The merged headers are the
response's, updated by those that a 304 may send: cache-control, content-location, date,
etag, expires, last-modified, vary.

Header names are compared in lower case.

Defined results: records without a URL or a time are ``no_response`` if revisits, and no response
to any; of responses with the same time the one with the larger id is later; a response
at the revisit's own time is not earlier; a revisit without validators is
``no_validator``; repeated rows are each returned; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUCKET = 1 << 16
#: Of ``site_records``: the time between pages, and the page ids of one version of a site.
STEP = 1 << 10
PERIOD = 128
#: Headers that a 304 response updates: fixed by the HTTP standard.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical(url: Column) -> Column:
    """Scheme-less URL: host in lower case without default port and without www. or m. before a name of two labels or more, no fragment, tracking parameters or closing slash."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    part = lambda k: F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)([^?]*)(?:\?(.*))?$", k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r":(80|443)$", ""), r"^(?:www|m)\.([^.]+\..+)$", "$1")
    query = F.array_join(F.filter(F.split(part(3), "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(r"^(utm_[a-z]+|ref|gclid|fbclid)="))), "&")
    out = F.concat(host, F.regexp_replace(part(2), r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", out)


def lowered(headers: Column) -> Column:
    """Headers with names in lower case; of names that differ in case alone the first counts."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["k"] == n), 1)["v"]))


def resolve(records: DataFrame) -> DataFrame:
    """``record_id, canonical_url, response_id, status, headers`` of each revisit in ``records(record_id, url, at, kind, headers)``, kind response or revisit."""
    rows = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), "at", "kind", lowered(F.col("headers")).alias("headers"))
    rows = rows.withColumn("bucket", F.floor(F.col("at") / BUCKET))
    full = F.when(F.col("kind") == "response", F.struct("at", "record_id", F.col("headers").alias("h")))
    # Records that no time line holds are dealt by their own id.
    loose = F.col("canonical_url").isNull() | F.col("at").isNull()
    key = F.when(loose, F.concat(F.lit("?"), F.coalesce(F.col("record_id").cast("string"), F.lit("")))).otherwise(F.concat(F.coalesce(F.col("bucket").cast("string"), F.lit("")), F.lit(" "), F.col("canonical_url")))
    stands = rows.filter(~loose & (F.col("kind") == "response"))
    last = stands.groupBy("canonical_url", "bucket").agg(F.max_by(full, F.struct("at", "record_id")).alias("last"))
    wanted = rows.filter(~loose & (F.col("kind") == "revisit")).select("canonical_url", "bucket").distinct()
    line = last.join(wanted, ["canonical_url", "bucket"], "full")
    carried = line.withColumn("carried", F.last("last", ignorenulls=True).over(W.partitionBy("canonical_url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    carried = carried.filter("carried IS NOT NULL").select("canonical_url", "bucket", "carried")
    # Responses of the revisit's own time come after it in this order.
    turn = F.when(F.col("kind") == "revisit", 0).otherwise(1)
    near = F.last(full, ignorenulls=True).over(W.partitionBy(key).orderBy("at", turn, "record_id").rowsBetween(W.unboundedPreceding, -1))
    seen = rows.withColumn("near", F.when(~loose, near)).filter(F.col("kind") == "revisit")
    seen = seen.join(carried, ["canonical_url", "bucket"], "left").withColumn("r", F.coalesce("near", "carried"))
    weak = lambda h: F.regexp_replace(F.try_element_at(h, F.lit("etag")), "^W/", "")
    mine, held = F.col("headers"), F.col("r.h")
    tag, since = weak(mine), F.try_element_at(mine, F.lit("last-modified"))
    holds = F.when(tag.isNotNull(), F.coalesce(tag == weak(held), F.lit(False))).otherwise(F.coalesce(since == F.try_element_at(held, F.lit("last-modified")), F.lit(False)))
    status = F.when(F.col("r").isNull(), "no_response").when(tag.isNull() & since.isNull(), "no_validator").when(holds, "resolved").otherwise("changed")
    sent = F.map_filter(mine, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(held, lambda k, _: ~F.array_contains(F.map_keys(sent), k)), sent)
    out = seen.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return out.select("record_id", "canonical_url", F.when(ok, F.col("r.record_id")).alias("response_id"), "status", F.when(ok, merged).alias("headers"))


def site_records(pages: DataFrame) -> DataFrame:
    """Records of the sites of stored pages: many pages on one time line, so that a revisit must look back over other records.

    Each page is a revisit of its site at ``STEP * page_id``; each third is a response of it as well, at that same
    time and so not earlier. The site has a version for every ``PERIOD`` page ids, whose digest is the ETag. The
    revisits of ids 0, 1, 2 and 3 mod 4 have: this period's ETag, weak; that of the period before; no ETag but this
    period's time; none at all.
    """
    site = F.regexp_extract(F.trim("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    period = F.floor(F.col("page_id") / PERIOD)
    tag = lambda n: F.md5(F.concat_ws(":", canonical(site), n.cast("string")))
    day = F.concat(F.lit("day "), F.coalesce(period.cast("string"), F.lit("")))
    response = F.create_map(F.lit("etag"), tag(period), F.lit("last-modified"), day, F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.lit("first"))
    kind = F.pmod("page_id", F.lit(4))
    seen = F.create_map(F.lit("date"), F.lit("second"), F.lit("server"), F.lit("ignored"))
    revisit = F.when(kind == 0, F.map_concat(seen, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag(period))))).when(kind == 1, F.map_concat(seen, F.create_map(F.lit("etag"), tag(period - 1)))).when(kind == 2, F.map_concat(seen, F.create_map(F.lit("last-modified"), day))).otherwise(seen)
    stored = F.when(F.pmod("page_id", F.lit(3)) == 0, F.struct(F.lit(0).alias("n"), F.lit("response").alias("kind"), response.alias("headers")))
    both = pages.select("page_id", F.concat(site, F.when(kind < 2, "/?utm_source=a#top").otherwise("")).alias("url"), F.array_compact(F.array(stored, F.struct(F.lit(1).alias("n"), F.lit("revisit").alias("kind"), revisit.alias("headers")))).alias("r"))
    out = both.select("page_id", "url", F.explode("r").alias("r"))
    return out.select((2 * F.col("page_id") + F.col("r.n")).alias("record_id"), "url", (STEP * F.col("page_id")).alias("at"), "r.kind", "r.headers")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Stored pages have no headers: their sites' records stand for what a crawl would have stored."""
    return resolve(site_records(pages)).withColumn("headers", F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n"))


SQL = r"""
WITH c AS (
  SELECT page_id, page_id // 128 AS period, page_id % 4 AS k, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS host FROM pages
), p AS (
  SELECT *, nullif(regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(?:www|m)\.([^.]+\..+)$', '\1'), '') AS canonical_url FROM c
), v AS (
  SELECT 2 * page_id + 1 AS record_id, canonical_url, 1024 * page_id AS at, k, 'day ' || period::VARCHAR AS since,
    CASE k WHEN 0 THEN 'W/' || md5(concat_ws(':', canonical_url, period::VARCHAR)) WHEN 1 THEN md5(concat_ws(':', canonical_url, (period - 1)::VARCHAR)) END AS tag FROM p
), r AS (
  SELECT 2 * page_id AS record_id, canonical_url, 1024 * page_id AS at, md5(concat_ws(':', canonical_url, period::VARCHAR)) AS tag, 'day ' || period::VARCHAR AS since FROM p WHERE page_id % 3 = 0
), j AS (
  SELECT v.record_id, v.canonical_url, v.tag, r.record_id AS response_id, r.tag AS held, r.since,
    CASE WHEN r.record_id IS NULL THEN 'no_response' WHEN v.k = 3 THEN 'no_validator'
         WHEN v.k IN (0, 1) AND regexp_replace(v.tag, '^W/', '') = r.tag OR v.k = 2 AND v.since = r.since THEN 'resolved' ELSE 'changed' END AS status
  FROM v ASOF LEFT JOIN r ON v.canonical_url = r.canonical_url AND v.at > r.at
)
SELECT record_id, canonical_url, CASE WHEN status = 'resolved' THEN response_id END AS response_id, status,
  CASE WHEN status = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: second' || chr(10) || 'etag: ' || coalesce(tag, held) || chr(10) || 'last-modified: ' || since END AS headers
FROM j
"""
