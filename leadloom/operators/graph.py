"""Links and crawls over a stored link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadloom.functions import entities
from leadloom.functions.semi import json_candidates, parse_json
from leadloom.functions.urls import _contains_any, _let, is_junk_link, is_same_domain, normalize_url
from leadloom.sources.files import written


def internal_links(pages: DataFrame, root: str = "root") -> DataFrame:
    """``page_id, links``: same-site links of a page in document order, each once. Anchors resolve against the site's root."""
    anchors = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"']"), F.lit(1))
    urls = F.transform(anchors, lambda h: normalize_url(entities._unescaped(h), F.col(root)))
    kept = F.filter(urls, lambda u: u.isNotNull() & is_same_domain(u, F.col(root)) & ~is_junk_link(u))
    return pages.select("page_id", "url", F.array_distinct(kept).alias("links"))


def navigation(df: DataFrame, text: str = "text", links: str = "links", response: str | None = None, shown: int = 20) -> DataFrame:
    """Adds ``has_contact_info`` and ``next_link``: the first link that looks like contact, about or team, else the first.

    A model's ``response``, where it is not null, counts unless the page has both contacts and
    such a link: its first JSON object tells, and a link that it made up stands for the first of the
    ``shown`` links that holds it or that it holds.
    """
    found = df.withColumns({
        "_best": F.try_element_at(F.filter(links, lambda u: _contains_any(F.lower(u), ("contact", "about", "team"))), F.lit(1)),
        "_has": (F.size(entities.emails(F.col(text))) > 0) | (F.size(entities.phones(F.col(text))) > 0),
    })
    plain = F.coalesce("_best", F.try_element_at(F.col(links), F.lit(1)))
    if response is None:
        return found.withColumns({"has_contact_info": F.col("_has"), "next_link": plain}).drop("_best", "_has")
    told = F.filter(F.transform(json_candidates(F.col(response)), parse_json), lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull())
    found = found.withColumn("_told", F.try_element_at(told, F.lit(1)))
    said = lambda k: F.coalesce(F.try_variant_get("_told", f"$.{k}", "string"), F.lit(""))
    boolean = F.schema_of_variant(F.try_variant_get("_told", "$.has_contact_info", "variant")) == "BOOLEAN"
    true = F.when(boolean, said("has_contact_info") == "true").otherwise(~said("has_contact_info").isin("", "0", "0.0", "[]", "{}"))
    pick = F.when(said("next_link") != "", said("next_link")).otherwise(F.col("_best"))
    known = F.slice(links, 1, shown)
    like = _let(pick, lambda p: F.when(F.array_contains(known, p), p).otherwise(F.coalesce(F.try_element_at(F.filter(known, lambda u: F.contains(u, p) | F.contains(p, u)), F.lit(1)), p)))
    use = F.col("_told").isNotNull() & ~(F.col("_has") & F.col("_best").isNotNull())
    out = found.withColumns({"has_contact_info": F.when(use, F.coalesce(true, F.lit(False)) | F.col("_has")).otherwise(F.col("_has")), "next_link": F.when(use, F.when(pick.isNotNull(), like)).otherwise(plain)})
    return out.drop("_best", "_has", "_told")


def _in_turn(links: DataFrame, quota: int) -> DataFrame:
    """Of ``site, src, from, dst, link_ord``: page after page of a site, its first ``quota`` links that none before it has taken.

    One row a site holds its level's pages, which the quota of the level before bounds.
    """
    page = links.groupBy("site", "from").agg(F.array_sort(F.collect_list(F.struct("link_ord", "dst"))).alias("links"))
    site = page.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("from", "links"))).alias("pages"))
    none = F.slice(F.array(F.struct(F.lit("").alias("dst"), F.lit(0).cast("long").alias("from"), F.lit(0).cast(links.schema["link_ord"].dataType).alias("link_ord"))), 1, 0)

    def step(done, p):
        fresh = F.filter(p["links"], lambda x: ~F.array_contains(F.transform(done, lambda d: d["dst"]), x["dst"]))
        names = F.slice(F.array_distinct(F.transform(fresh, lambda x: x["dst"])), 1, quota)
        first = F.transform(names, lambda u: F.struct(u.alias("dst"), p["from"].alias("from"), F.element_at(F.filter(fresh, lambda x: x["dst"] == u), 1)["link_ord"].alias("link_ord")))
        return F.concat(done, first)

    return site.select("site", F.explode(F.aggregate("pages", none, step)).alias("x")).select("site", "x.*")


def crawl(roots: DataFrame, edges: DataFrame, max_depth: int = 2, max_pages: int | None = 12, max_links: int = 10, decisions: DataFrame | None = None, failed: DataFrame | None = None, once: bool = False, cache: DataFrame | None = None) -> DataFrame:
    """Breadth-first visits of each root: ``site, url, depth, visit`` (from 0), one round of joins for each level.

    ``roots(url)``; ``edges(src, dst, link_ord)``. A page enqueues its first ``max_links``
    links not visited when it was, and a link counts against that quota even if another
    page enqueued it before; with ``once`` it does not: pages enqueue in turn, each its first
    ``max_links`` links that no page before it has enqueued, and there is no page cap.
    ``decisions(url, next_link)`` switches to guided navigation, one link a page: the decision
    if not yet visited, else the first such link; a page without a row there, whose decision
    failed, enqueues those of its first three that are not visited. Pages in ``failed(url)``
    are visited but not counted, returned or expanded; those in ``cache(url)`` of earlier runs are
    not visited, and without a root a site has no pages.

    Each level is a written table, so that none is computed again for the next.
    """
    edges = edges.select("src", "dst", "link_ord")
    if decisions is not None:
        # The first three links count by place on the page, visited or not.
        edges = edges.withColumn("place", F.row_number().over(W.partitionBy("src").orderBy("link_ord")))
    if cache is not None:
        known = cache.select(F.col("url").alias("dst")).distinct()
        edges = edges.join(known, "dst", "left_anti").select(edges.columns)
        roots = roots.join(known.withColumnRenamed("dst", "url"), "url", "left_anti")
    edges = written(edges, "edges")
    bad = failed.select(F.col("url"), F.lit(True).alias("_bad")) if failed is not None else None
    visited = roots.select(F.col("url").alias("site"), "url").distinct().withColumns({"depth": F.lit(0), "visit": F.lit(0).cast("long"), "ok": F.lit(True)})
    if bad is not None:
        visited = visited.join(bad, "url", "left").withColumn("ok", F.col("_bad").isNull()).drop("_bad")
    visited = frontier = written(visited, "visits")
    for depth in range(1, max_depth + 1):
        page = frontier.filter("ok").select("site", F.col("url").alias("src"), F.col("visit").alias("from"))
        out = page.join(edges, "src")
        if decisions is not None:
            told = decisions.select(F.col("url").alias("src"), F.col("next_link").alias("dst"))
            if cache is not None:
                told = told.join(known.withColumn("_k", F.lit(True)), "dst", "left").select("src", F.when(F.col("_k").isNull(), F.col("dst")).alias("dst"))
            asked = told.select("src").distinct().withColumn("_told", F.lit(True))
            out = out.join(asked, "src", "left").filter(F.col("_told").isNotNull() | (F.col("place") <= 3)).withColumn("_told", F.col("_told").isNotNull())
            next_one = page.join(told.filter("dst IS NOT NULL"), "src").withColumns({"link_ord": F.lit(-1), "place": F.lit(0), "_told": F.lit(True)})
            out = out.unionByName(next_one.select(out.columns))
        seen = visited.select("site", F.col("url").alias("dst"), F.col("visit").alias("at"))
        out = out.join(seen, ["site", "dst"], "left").filter("at IS NULL OR at > from")
        queue = W.partitionBy("site").orderBy("from", "link_ord")
        if once:
            out = _in_turn(out.filter("at IS NULL"), max_links)
        else:
            quota = F.when(F.col("_told"), 1).otherwise(3) if decisions is not None else F.lit(max_links)
            out = out.withColumn("_n", F.row_number().over(W.partitionBy("site", "src").orderBy("link_ord"))).filter(F.col("_n") <= quota).filter("at IS NULL")
        new = out.groupBy("site", F.col("dst").alias("url")).agg(F.min(F.struct("from", "link_ord")).alias("first")).select("site", "url", "first.*")
        if bad is not None:
            new = new.join(bad, "url", "left").withColumn("ok", F.col("_bad").isNull()).drop("_bad")
        else:
            new = new.withColumn("ok", F.lit(True))
        base = visited.groupBy("site").agg((F.max("visit") + 1).alias("base"), F.count_if("ok").alias("pages"))
        new = new.join(base, "site").withColumn("visit", F.row_number().over(queue) - 1 + F.col("base"))
        if max_pages is not None:
            before = F.coalesce(F.sum(F.col("ok").cast("int")).over(queue.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            new = new.withColumn("_before", before + F.col("pages")).filter(F.col("_before") < max_pages)
        frontier = written(new.select("site", "url", F.lit(depth).alias("depth"), "visit", "ok"), "visits")
        visited = visited.unionByName(frontier)
    return visited.filter("ok").select("site", "url", "depth", "visit")
