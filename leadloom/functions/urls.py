"""URL algebra on columns. Everything is native: no Python worker is entered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import patterns as P
from leadloom.functions.text import stripped

Url = Column


def _parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """Scheme (lower case), authority, path and query; missing parts are empty."""
    part = lambda k: F.regexp_extract(url, P.URL_PARTS, k)
    return F.lower(part(1)), part(2), part(3), part(4)


def _cleaned(url: Column) -> Column:
    return F.regexp_replace(stripped(url), r"[\t\r\n]", "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where no common expression is shared: inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _checked(scheme: Column, authority: Column, path: Column, query: Column) -> Column:
    whole = F.concat(scheme, F.lit("://"), F.lower(authority), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & (authority != ""), whole)


def _split(url: Column) -> Column:
    return F.struct(*(x.alias(k) for k, x in zip("sapq", _parts(url), strict=True)))


def _folded(path: Column, base_path: Column) -> Column:
    """A path against a base's: dot segments folded, never above the root; where it is relative, empty middle segments are dropped."""
    above = _let(F.split(base_path, "/"), lambda x: F.when(F.element_at(x, -1) != "", F.slice(x, 1, F.greatest(F.lit(0), F.size(x) - 1))).otherwise(x))
    joined = F.when(F.startswith(path, F.lit("/")), F.split(path, "/")).otherwise(F.concat(above, F.split(path, "/")))
    middle = lambda x: F.filter(F.slice(x, 2, F.size(x) - 2), lambda s: s != "")
    clean = _let(joined, lambda x: F.when((F.size(x) > 2) & ~F.startswith(path, F.lit("/")), F.concat(F.slice(x, 1, 1), middle(x), F.slice(x, -1, 1))).otherwise(x))

    def fold(x: Column) -> Column:
        step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
        out = F.aggregate(x, F.array().cast("array<string>"), step)
        return F.array_join(F.when(F.element_at(x, -1).isin(".", ".."), F.concat(out, F.array(F.lit("")))).otherwise(out), "/")

    return _let(_let(clean, fold), lambda x: F.when(F.startswith(x, F.lit("/")), x).otherwise(F.concat(F.lit("/"), x)))


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """Absolute http(s) URL with lower-case scheme and authority, ``/`` for an empty path and no fragment; else null.

    With ``base``, relative references are resolved first: scheme-relative, root-relative and
    path-relative ones (dot segments folded on the path's segments), and bare queries.
    """
    if base is None:
        return _let(_split(_cleaned(url)), lambda u: _checked(u["s"], u["a"], u["p"], u["q"]))

    def against(u: Column, b: Column) -> Column:
        bare = (u["p"] == "") & (u["a"] == "")
        relative = (u["a"] == "") & ((u["s"] == "") | (u["s"] == b["s"]))
        path = F.when(bare, b["p"]).otherwise(_folded(u["p"], b["p"]))
        inside = _checked(b["s"], b["a"], path, F.when(bare & (u["q"] == ""), b["q"]).otherwise(u["q"]))
        return F.when(relative, inside).otherwise(_checked(F.when(u["s"] == "", b["s"]).otherwise(u["s"]), u["a"], u["p"], u["q"]))

    both = F.struct(_cleaned(url).alias("text"), _cleaned(base).alias("base"))
    return _let(both, lambda x: F.when(x["text"] != "", _let(F.struct(_split(x["text"]).alias("u"), _split(x["base"]).alias("b")), lambda y: against(y["u"], y["b"]))))


def registrable_domain(url: Column) -> Column:
    """Authority in lower case without a leading ``www.``; port and user stay."""
    return F.regexp_replace(F.lower(_parts(F.coalesce(url, F.lit("")))[1]), r"^www\.", "")


def domain_of(url: Column) -> Column:
    return F.coalesce(registrable_domain(normalize_url(url)), F.lit(""))


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def is_external_site(url: Column) -> Column:
    return ~_contains_any(registrable_domain(url), P.ENGINE_DOMAINS)


def is_junk_link(url: Column) -> Column:
    return _contains_any(F.lower(url), P.JUNK_FRAGMENTS)


def is_same_domain(url: Column, root: Column) -> Column:
    return registrable_domain(url) == registrable_domain(root)


def search_target(href: Column) -> Column:
    """The URL behind a result link: engine redirects are unwrapped from ``uddg`` (decoded twice), other engine links are null."""
    _, authority, path, query = _parts(_cleaned(href))
    value = F.regexp_extract(query, r"(?:^|&)uddg=([^&]*)", 1)
    # A query value's plus is a space; the second decoding is of a path, where it stays.
    once = F.try_url_decode(value)
    twice = F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once)
    wrapped = F.rtrim(path, F.lit("/")).isin("/l", "/y.js") & (value != "")
    return F.when(_contains_any(F.lower(authority), P.ENGINE_DOMAINS), F.when(wrapped, normalize_url(twice))).otherwise(normalize_url(href))


def urls_in_text(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(P.U + "(?i)" + P.URL_IN_TEXT), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:)]+$", ""))))
