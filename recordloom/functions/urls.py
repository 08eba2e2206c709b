"""URLs in text, and likely URLs for company names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import first_value, or_empty, strip

# The shape of a URL, and below the two forms in page snapshots.
ANY_URL = r"https?://(?:www\.)?(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?:/[^\s]*)?"

# Legal-form endings, removed one after the other in this order.
LEGAL_FORMS = [
    " inc.", " inc", " llc", " ltd.", " ltd", " corp.", " corp", " corporation", " co.", " co",
    " company", " limited", " gmbh", " ag", " se", " s.a.", " bv",
]
DOMAIN_ENDINGS = [".com", ".ai"]

# Names the rule would get wrong, keyed by the lower-cased name.
KNOWN_COMPANIES = {
    "wistron & wiwynn": "https://www.wiwynn.com/",
    "agile robots se": "https://www.agile-robots.com/",
    "global ai": "https://www.globalai.com/",
    "lightwheel": "https://www.lightwheel.ai/",
    "simplismart": "https://www.simplismart.ai/",
    "asrock rack inc.": "https://www.asrockrack.com/",
    "astris ai, a lockheed martin company": "https://astrisai.com/",
    "centific": "https://www.centific.com/",
    "compal electronics, inc": "https://www.compalserver.com/",
    "ddc solutions (a member of daikin group)": "https://www.ddcsolutions.com/",
    "dream": "https://dreamgroup.com/",
}


def all_urls(c: Column) -> Column:
    return F.regexp_extract_all(or_empty(c), F.lit("(" + ANY_URL + ")"), F.lit(1))


def first_url(c: Column) -> Column:
    """From a page snapshot: a link named by its URL, else a '/url:' entry, else ''."""
    return first_value(
        F.regexp_extract(c, r'- link "(https?://[^"]+)" \[ref=[^\]]+\]:', 1),
        F.regexp_extract(c, r"/url:\s*(https?://\S+)", 1),
    )


def absolute(c: Column, base: str) -> Column:
    return F.when((c != "") & ~F.startswith(c, F.lit("http")), F.concat(F.lit(base), c)).otherwise(c)


def without_fragment(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def company_url(c: Column, strict: bool = False) -> Column:
    """Likely home page of a company name, null when nothing is left of the name.

    ``strict`` also removes domain endings and bracketed remarks.
    """
    name = F.lower(or_empty(c))
    for ending in LEGAL_FORMS + (DOMAIN_ENDINGS if strict else []):
        name = F.regexp_replace(name, r"(?s)^\s*(.*?)\s*" + ending.replace(".", r"\.") + r"\z", "$1")
    if strict:
        name = F.regexp_replace(name, r"\([^)]*\)", "")
    name = F.regexp_replace(name, r"[^a-z0-9\s]", "")
    name = F.replace(strip(name) if strict else name, F.lit(" "), F.lit(""))
    return F.when(name != "", F.concat(F.lit("https://www."), name, F.lit(".com/")))
