"""Semi-structured data: model responses (native) and JSON-LD or embedded listings in pages (one Arrow UDF).

A page's JSON-LD has no schema and nests without bound, and listing windows overlap; these
alone are read in Python, all in one pass over a page.
"""

from __future__ import annotations

import html as _html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import patterns as P
from leadloom.functions.classify import infer_tags
from leadloom.functions.text import stripped
from leadloom.functions.urls import _let, normalize_url

# ---- responses of a model ----


def json_candidates(raw: Column) -> Column:
    """Blocks that may be JSON: arrays, else objects, else everything, inside a fence if there is one; longest first, ties by place."""
    text = stripped(F.coalesce(raw, F.lit("")))
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.rlike(text, F.lit(r"(?is)```(?:json)?\s*.*?```")), stripped(fenced)).otherwise(text)
    arrays = F.regexp_extract_all(body, F.lit(r"(?s)\[.*?\]"), F.lit(0))
    objects = F.regexp_extract_all(body, F.lit(r"(?s)\{.*?\}"), F.lit(0))
    found = F.array_distinct(F.when(F.size(arrays) > 0, arrays).when(F.size(objects) > 0, objects).otherwise(F.array(body)))
    ranked = F.array_sort(F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(ranked, lambda r: r["x"]))


def parse_json(text: Column) -> Column:
    """A variant; with trailing commas taken out if it doesn't parse as it is, else null."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_replace(text, r"(?U),\s*([\]}])", "$1")))


def response_json(raw: Column) -> Column:
    """The first candidate that parses."""
    parsed = F.filter(F.transform(json_candidates(raw), parse_json), lambda v: v.isNotNull())
    return F.try_element_at(parsed, F.lit(1))


def lead_list(value: Column) -> Column:
    """``array<variant>`` of objects: an array's, those under ``leads``, or a single object with a name."""
    items = lambda path: F.try_variant_get(value, path, "array<variant>")
    single = F.try_variant_get(value, "$.business_name", "string").isNotNull() | F.try_variant_get(value, "$.business_name", "variant").isNotNull()
    found = F.coalesce(items("$"), items("$.leads"), F.when(single, F.array(value)), F.array().cast("array<variant>"))
    return F.filter(found, lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())


def candidate(item: Column, source_url: Column, website: Column) -> Column:
    """An object as a candidate struct: confidence within 0 and 1 (0.5 if it is none), a relative website resolved, tags inferred anew."""
    field = lambda k: stripped(F.coalesce(F.try_variant_get(item, f"$.{k}", "string"), F.lit("")))
    given = F.try_variant_get(item, "$.confidence_score", "string")
    truth = F.when(F.schema_of_variant(F.try_variant_get(item, "$.confidence_score", "variant")) == "BOOLEAN", F.when(given == "true", 1.0).otherwise(0.0))
    confidence = F.coalesce(truth, given.try_cast("double"), F.lit(0.5))
    read = F.struct(*(field(k).alias(k) for k in ("business_name", "email", "phone", "location", "niche")), confidence.alias("c"), F.when(field("website") != "", field("website")).otherwise(stripped(website)).alias("site"))
    absolute_site = lambda s: F.when((s == "") | F.startswith(s, F.lit("http")), s).otherwise(F.coalesce(normalize_url(s, website), website))
    return _let(
        read,
        lambda r: F.struct(
            r["business_name"].alias("business_name"),
            _let(absolute_site(r["site"]), lambda s: F.when(s != "", s).otherwise(website)).alias("website"),
            F.lower(r["email"]).alias("email"),
            r["phone"].alias("phone"),
            r["location"].alias("location"),
            r["niche"].alias("niche"),
            infer_tags(r["niche"], r["business_name"]).alias("tags"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["c"])).alias("confidence_score"),
            source_url.alias("source_url"),
        ),
    )


def with_response(df: DataFrame, response: str, out: str, source: str = "source_url", website: str = "website") -> DataFrame:
    """Adds ``out``, the candidates of a response column. Each step is a column, so that a response is parsed once."""
    parsed = df.withColumn("_json", response_json(F.col(response)))
    listed = parsed.withColumn("_items", lead_list(F.col("_json")))
    return listed.withColumn(out, F.transform("_items", lambda item: candidate(item, F.col(source), F.col(website)))).drop("_json", "_items")


def chosen_links(raw: Column, links: Column, k: int = 5) -> Column:
    """Links a response names, in its order: of the first array of strings with any known link; else the first ``k``."""
    lists = F.transform(json_candidates(raw), lambda c: F.from_json(F.when(F.rlike(c, F.lit(r"^\[\s*(\"|\])")), c), "array<string>"))
    known = F.filter(F.transform(F.filter(lists, lambda x: x.isNotNull()), lambda x: F.filter(x, lambda u: F.array_contains(links, u))), lambda x: F.size(x) > 0)
    return F.slice(F.coalesce(F.try_element_at(known, F.lit(1)), links), 1, k)


# ---- structured data in pages ----

_STRINGS = T.ArrayType(T.StringType())
_RECORD = T.StructType([*(T.StructField(k, T.StringType()) for k in ("name", "email", "phone", "address")), T.StructField("social", _STRINGS)])
STRUCTURED = T.StructType(
    [T.StructField("names", _STRINGS), T.StructField("addresses", _STRINGS), T.StructField("business", T.BooleanType()), T.StructField("cuisines", _STRINGS), T.StructField("records", T.ArrayType(_RECORD))]
)
_SCRIPT = re.compile(r'<script[^>]+type=["\']application/ld\+json["\'][^>]*>(.*?)</script>', re.I | re.S)
_STRING = r'"\s*:\s*"((?:[^"\\]|\\.)*)"'
_NAME = re.compile(r'"name"\s*:\s*"((?:[^"\\]|\\.)+)"')
_FIELD = {k: re.compile(f'"{k}' + _STRING) for k in ("phone", "email", "address")}
_SOCIAL = re.compile(r'"(?:instagram|facebook|twitter|social)[^"]*' + _STRING, re.I)
_WINDOW = 1200


def _objects(data):
    """JSON-LD objects in document order; lists and graphs are entered."""
    todo = [data]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            if "@graph" in x:
                todo.append(x["@graph"])
            else:
                yield x


def _types(block: dict) -> list:
    kind = block.get("@type")
    return [kind] if isinstance(kind, str) else kind or []


def _text(value) -> str:
    while isinstance(value, list) and value:
        value = value[0]
    return value.strip() if isinstance(value, str) else ""


def short_name(value: str) -> str:
    out = _html.unescape(re.sub(r"\s+", " ", value)).strip()
    for separator in "|–-—·":
        out = out.split(separator, 1)[0].strip()
    return out if len(out) <= 120 else out[:120].rsplit(" ", 1)[0]


def phone_form(raw: str) -> str:
    digits = re.sub(r"\D", "", raw)
    if len(digits) < 10:
        return ""
    lead = "+1 " if len(digits) == 11 and digits[0] == "1" else ""
    if len(digits) == 10 or lead:
        area, middle, last = digits[-10:-7], digits[-7:-4], digits[-4:]
        return f"{lead}({area}) {middle}-{last}"
    return raw.strip()


def _postal(value) -> list[str]:
    out = []
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, str):
            out.append(x.strip())
        elif isinstance(x, dict):
            out.append(", ".join(str(x[k]).strip() for k in P.ADDRESS_PARTS if x.get(k)))
    # A lone string or object that is blank gives no address; in a list, only objects are tested.
    return [a for a in out if a] if not isinstance(value, list) else [a for x, a in zip([x for x in value if isinstance(x, str | dict)], out, strict=True) if a or isinstance(x, str)]


def absolute(url: str, base: str) -> str | None:
    from urllib.parse import urljoin, urlsplit

    try:
        s = urlsplit(urljoin(base, url.strip()))
    except ValueError:
        return None
    if s.scheme not in ("http", "https") or not s.netloc:
        return None
    return f"{s.scheme}://{s.netloc.lower()}{s.path or '/'}" + (f"?{s.query}" if s.query else "")


def _social(value, base: str) -> list[str]:
    found = (absolute(str(x), base) for x in (value if isinstance(value, list) else [value]) if x)
    return sorted({u for u in found if u and any(h in u.split("/")[2].lower() for h in P.SOCIAL_HOSTS)})


def _plain(value: str) -> str:
    """A JSON string's content."""
    try:
        return json.loads(f'"{value}"')
    except ValueError:
        return _html.unescape(value.replace("\\/", "/"))


def _listed(block: dict, base: str) -> dict | None:
    kinds = _types(block)
    name = short_name(_text(block.get("name")))
    if kinds and not set(map(str, kinds)) & set(P.LISTING_TYPES) or len(name) < 2:
        return None
    phone = phone_form(_text(block.get("telephone") or block.get("phone")))
    email, social = _text(block.get("email")).lower(), _social(block.get("sameAs"), base)
    if not (phone or email or social):
        return None
    return {"name": name, "email": email, "phone": phone, "address": next(iter(_postal(block.get("address"))), ""), "social": social}


def _embedded(page: str, base: str):
    for match in _NAME.finditer(page):
        name, window = short_name(_plain(match[1])), page[match.end() : match.end() + _WINDOW]
        got = {k: _plain(m[1]) if (m := p.search(window)) else "" for k, p in _FIELD.items()}
        phone, address = phone_form(got["phone"]), got["address"].strip()
        if not 2 <= len(name) <= 120 or not phone:
            continue
        if len(address) > 200 or "\\" in address[:20]:
            address = ""
        social = sorted({u for m in _SOCIAL.finditer(window) if (u := absolute(_plain(m[1]), base))})
        yield {"name": name, "email": got["email"].lower().strip(), "phone": phone, "address": address, "social": social}


def read_page(page: str | None, base: str | None) -> dict:
    page, base, blocks = page or "", base or "", []
    for m in _SCRIPT.finditer(page):
        try:
            blocks += _objects(json.loads(m[1].strip()))
        except ValueError:
            continue
    named = [b for b in blocks if not _types(b) or set(map(str, _types(b))) & set(P.NAMED_TYPES)]
    cuisines = [c for b in blocks for c in (b.get("servesCuisine") if isinstance(b.get("servesCuisine"), list) else [b.get("servesCuisine")]) if c]
    records: dict[tuple, dict] = {}
    for r in (*filter(None, (_listed(b, base) for b in blocks)), *_embedded(page, base)):
        records.setdefault((r["name"].lower().strip(), r["email"].lower().strip(), re.sub(r"\D", "", r["phone"])), r)
    return {
        "names": [n for b in named if (n := str(b.get("name") or "").strip())],
        "addresses": sorted({a for b in blocks for a in _postal(b.get("address")) if a}),
        "business": any(t in P.HINT_TYPES for b in blocks for t in _types(b)),
        "cuisines": sorted({str(c) for c in cuisines}),
        "records": list(records.values()),
    }


@F.pandas_udf(STRUCTURED)
def structured(page: pd.Series, url: pd.Series) -> pd.DataFrame:
    """JSON-LD names, addresses, types and cuisines of a page, and its listing records without repeats."""
    return pd.DataFrame([read_page(p, u) for p, u in zip(page, url, strict=True)], columns=["names", "addresses", "business", "cuisines", "records"])
