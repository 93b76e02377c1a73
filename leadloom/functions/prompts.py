"""Prompts for a language model as columns; the call itself is a boundary, its answers are input columns.

The texts are fixed values: answers depend on them to the letter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import prompt_text
from leadloom.schema import LEAD_FIELDS

# The wording of each prompt. {names} are filled in by column.
EXTRACTION = """Extract business leads from the following text. Return ONLY a valid JSON array.
Do not include explanation, text, markdown, or comments.
Start with [ and end with ] only.
Each item must have: business_name, website, email, phone, location, niche, confidence_score (0.5-1.0).
confidence_score: 0.5-1.0 for real leads, 0.0 if unsure.
Do not hallucinate. Skip any missing fields.
Do not include any extra text outside the JSON array.
Source page: {source}
Website: {website}
Text:
{text}
"""
REPAIR = """Fix this JSON. Return ONLY valid JSON:
{response}"""
STRICT = """Extract business leads. Return ONLY valid JSON array.
[{"business_name": "", "website": "", "email": "", "phone": "", "location": "", "niche": "", "confidence_score": 0.7}]
Source: {source}
{website}
{text}
"""
SCORE = """
Rate this business lead from 0 to 10.

Criteria:
- Has email or phone?
- Real business?
- Useful for outreach?

Return ONLY a number.

Lead:
{lead}
"""
LINKS = """Select links most likely to contain business contact info.
Prefer:
- official websites
- business directories
- aggregators (e.g. Justdial, Yelp, LBB)
- contact pages
Avoid:
- ads
- news
- job listings
Return ONLY a JSON array of strings containing the selected URLs.
Links:
{links}"""
NAVIGATION = """Analyze the text and decide if it contains business contact information (emails, phone numbers, company name).
If it does, set 'has_contact_info' to true.
If it does NOT, select the best URL from the provided 'Available Links' to click next (e.g., a 'Contact Us' or 'About' page), and set it as 'next_link'.
Return ONLY a JSON object with this schema: {"has_contact_info": boolean, "next_link": string|null}
Available Links:
{links}

Text:
{text}"""
SHOWN_LINKS = 20
NAVIGATION_CHARS = 1500


def filled(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by its column, null as empty; other braces stay."""
    parts, rest = [], template
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), F.coalesce(value.cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def extraction(text: Column, source: Column, website: Column, max_chars: int = 2000) -> Column:
    return filled(EXTRACTION, source=source, website=website, text=prompt_text(text, max_chars))


def strict(text: Column, source: Column, website: Column, max_chars: int = 2000) -> Column:
    """The second try, after an answer that held no leads."""
    return filled(STRICT, source=source, website=website, text=prompt_text(text, max_chars))


def repair(response: Column) -> Column:
    """Asks for the JSON of an answer that didn't parse; null where there was no answer."""
    return F.when(F.coalesce(response, F.lit("")) != "", filled(REPAIR, response=response))


def _quoted(value: Column) -> Column:
    """A value as JSON: the only element of an array, without the brackets."""
    whole = F.to_json(F.array(value))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def score(*fields: Column) -> Column:
    """Of a lead's fields in their order, tags as a list."""
    shown = []
    for name, value in zip(LEAD_FIELDS, fields, strict=True):
        as_json = F.concat(F.lit("["), F.array_join(F.transform(value, _quoted), ", "), F.lit("]")) if name == "tags" else _quoted(value)
        shown += [F.lit(f'{", " if shown else "{"}"{name}": '), as_json]
    return filled(SCORE, lead=F.concat(*shown, F.lit("}")))


def link_choice(links: Column) -> Column:
    return filled(LINKS, links=F.array_join(links, "\n"))


def navigation(text: Column, links: Column) -> Column:
    return filled(NAVIGATION, links=F.array_join(F.slice(links, 1, SHOWN_LINKS), "\n"), text=prompt_text(text, NAVIGATION_CHARS))
