r"""Regular expressions and word lists.

All constants of this file are fixed values: results depend on them to the letter. ``U`` makes
``\w``, ``\d`` and ``\s`` of Java mean what they mean elsewhere for Unicode text.
"""

from __future__ import annotations

U = "(?U)"

_ALNUM = "[a-zA-Z0-9]"
EMAIL_CORE = rf"{_ALNUM}(?:[a-zA-Z0-9._%+-]{{0,62}}{_ALNUM})?@{_ALNUM}(?:[a-zA-Z0-9-]{{0,61}}{_ALNUM})?(?:\.{_ALNUM}(?:[a-zA-Z0-9-]{{0,61}}{_ALNUM})?)+"
EMAIL = rf"(?<![\w.]){EMAIL_CORE}(?![\w.])"
PHONE = r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}|\+?\d{1,3}[-.\s]?\d{6,14}"
PHONE_SHAPE = r"^[\d\s().+\-]{7,25}$"
URL_IN_TEXT = r"https?://[\w\-./?&=%#]+"
EMAIL_DOMAIN = r"^[a-z0-9.-]+\.[a-z]{2,}$"
STREET = (
    r"\d{1,6}\s+[\w\s.'#-]{2,60}(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Lane|Ln\.?|Way|Court|Ct\.?|Place|Pl\.?|Parkway|Pkwy\.?)"
    r"[^<\n]{0,80}(?:[A-Z]{2}\s+\d{5}(?:-\d{4})?|\d{5}(?:-\d{4})?)"
)
HREF = r"href=[\"']([^\"']+)[\"']"
#: A URL's scheme, authority, path and query, as RFC 3986 splits them.
URL_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
LINES = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]"

ENGINE_DOMAINS = ("duckduckgo.com", "duck.com", "bing.com", "microsoft.com", "spreadprivacy.com")
JUNK_FRAGMENTS = ("login", "signin", "signup", "register", "cart", "checkout", "privacy", "terms", "cookie", "wp-admin", "javascript:", "mailto:", "tel:", "#")
DISPOSABLE_DOMAINS = ("mailinator.com", "guerrillamail.com", "tempmail.com", "yopmail.com", "10minutemail.com")

NICHES = {
    "restaurant": ("restaurant", "menu", "dining", "cuisine", "cafe", "bistro"),
    "agency": ("agency", "marketing", "seo", "digital", "consulting"),
    "ecommerce": ("shop", "store", "cart", "buy now", "ecommerce", "products"),
    "startup": ("startup", "founder", "saas", "venture", "seed"),
    "local business": ("plumber", "dentist", "clinic", "salon", "repair", "local"),
}

DROPPED_TAGS = ("script", "style", "noscript", "iframe", "svg", "nav", "footer", "header", "aside", "form", "button")
NOISE = r"cookie|banner|popup|modal|advert|ads|sidebar|menu|nav|footer|header"

# Four lists of our own choice; nothing defines them elsewhere.
CONTACT_WORDS = ("contact", "about", "team", "reach", "support")
SOCIAL_HOSTS = ("facebook", "instagram", "twitter", "linkedin", "youtube", "x.com")
RESTAURANT_WORDS = ("restaurant", "menu", "cuisine", "dining", "cafe", "bistro")
CUISINE_KEYS = ("cuisine", "servesCuisine")

LISTING_TYPES = ("Restaurant", "FoodEstablishment", "LocalBusiness", "Store")
NAMED_TYPES = (*LISTING_TYPES, "Organization")
HINT_TYPES = ("Restaurant", "FoodEstablishment", "LocalBusiness", "Organization")
ADDRESS_PARTS = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
