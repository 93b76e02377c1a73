"""Contacts in text and HTML, by regular expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import patterns as P
from leadloom.functions.text import stripped
from leadloom.functions.urls import _contains_any, _parts, normalize_url

_NONE = "array<string>"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(P.U + pattern), F.lit(group))


def _set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


def emails(text: Column) -> Column:
    """Sorted distinct e-mail addresses in lower case. The cheap test first spares most texts the pattern."""
    return F.when(F.contains(text, F.lit("@")), _set(F.transform(_found(text, "(?i)" + P.EMAIL), F.lower))).otherwise(F.array().cast(_NONE))


def phones(text: Column) -> Column:
    """Sorted distinct phone numbers of 10 to 15 digits, as written."""
    numbers = F.filter(F.transform(_found(text, P.PHONE), stripped), lambda x: F.length(digits_of(x)).between(10, 15))
    return F.when(F.rlike(text, F.lit(r"(?U)\d{3}")), _set(numbers)).otherwise(F.array().cast(_NONE))


def normal_phone(raw: Column) -> Column:
    """North American numbers in one form, others as written."""
    d = digits_of(raw)
    local = lambda x: F.regexp_replace(x, r"^(.{3})(.{3})(.*)$", "($1) $2-$3")
    return F.when((F.length(d) == 11) & F.startswith(d, F.lit("1")), F.concat(F.lit("+1 "), local(F.substring(d, 2, 10)))).when(F.length(d) == 10, local(d)).otherwise(stripped(raw))


def normal_phones(text: Column) -> Column:
    shaped = F.filter(phones(text), lambda x: F.rlike(x, F.lit(P.U + P.PHONE_SHAPE)))
    return _set(F.transform(shaped, normal_phone))


def html_phones(page: Column) -> Column:
    """Phones of a page's source and of its ``tel:`` links."""
    links = F.transform(_found(page, r"(?i)href=[\"']tel:([^\"']+)[\"']", 1), lambda x: stripped(_unescaped(x)))
    return _set(F.concat(normal_phones(page), F.transform(F.filter(links, lambda x: F.length(digits_of(x)) >= 10), normal_phone)))


def _unescaped(text: Column) -> Column:
    """The entities that occur in attributes; &amp; last, so that nothing is decoded twice."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def mailto_emails(page: Column) -> Column:
    found = F.transform(_found(page, r"(?i)href=[\"']mailto:([^\"'?]+)", 1), lambda x: F.lower(stripped(_unescaped(x))))
    return _set(F.filter(found, lambda x: F.contains(x, F.lit("@"))))


def hrefs(page: Column) -> Column:
    return F.transform(_found(page, "(?i)" + P.HREF, 1), lambda x: stripped(_unescaped(x)))


def contact_urls(page: Column, url: Column) -> Column:
    links = F.filter(hrefs(page), lambda h: ~F.rlike(F.lower(h), F.lit("^(mailto|tel):")))
    links = F.filter(F.transform(links, lambda h: normalize_url(h, url)), lambda u: u.isNotNull())
    return _set(F.filter(links, lambda u: _contains_any(F.lower(_parts(u)[2]), P.CONTACT_WORDS)))


def social_urls(page: Column, url: Column) -> Column:
    links = F.filter(F.transform(hrefs(page), lambda h: normalize_url(h, url)), lambda u: u.isNotNull())
    return _set(F.filter(links, lambda u: _contains_any(_parts(u)[1], P.SOCIAL_HOSTS)))


def street_addresses(page: Column) -> Column:
    """US street addresses in a page's source, 15 to 200 characters."""
    found = F.transform(_found(page, "(?i)" + P.STREET), lambda x: stripped(F.regexp_replace(x, r"(?U)\s+", " ")))
    return _set(F.filter(found, lambda x: F.length(x).between(15, 200)))


def microdata_addresses(page: Column) -> Column:
    """Street properties joined with the city, region and postal code that follow within 500 characters."""
    head = r"(?i)itemprop=[\"']streetAddress[\"'][^>]*>[^<]+<"
    # The look-ahead takes what follows without using it up, so that addresses close together each get theirs.
    spans = _found(page, rf"(?s){head}(?=(.{{0,500}}))", 0)
    after = _found(page, rf"(?s){head}(?=(.{{0,500}}))", 1)
    value = lambda text, name: stripped(F.regexp_extract(text, rf"(?i)itemprop=[\"']{name}[\"'][^>]*>([^<]+)<", 1))
    parts = F.zip_with(spans, after, lambda s, a: F.filter(F.array(_unescaped(value(s, "streetAddress")), *(value(a, n) for n in ("addressLocality", "addressRegion", "postalCode"))), lambda x: x != ""))
    return _set(F.transform(parts, lambda p: F.array_join(p, ", ")))
