"""Page and URL audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import absolute_links, domain, html_lang, html_text

# Domain lists; membership is a substring test on the authority.
GOVERNMENT = (".gov", ".gov.", "europa.eu")
ACADEMIC = (".edu", "arxiv.org", "scholar.google", "jstor.org", "ieee.org", "pubmed", "nature.com", "science.org")
SOCIAL = ("twitter.com", "x.com", "facebook.com", "instagram.com", "tiktok.com", "reddit.com", "threads.net")
NEWS = ("reuters.com", "apnews.com", "bbc.com", "nytimes.com", "wsj.com", "economist.com", "ft.com", "bloomberg.com", "theguardian.com", "techcrunch.com", "arstechnica.com", "wired.com")
BLOGS = ("blog.", "medium.com", "substack.com", "dev.to")
PRIMARY = (".gov", ".edu", "arxiv.org", "nature.com", "science.org", "sec.gov", "who.int", "nih.gov", "cdc.gov", "europa.eu", "pubmed", "scholar.google", "jstor.org", "ieee.org")
OPINION = ("blog.", "medium.com", "substack.com")
PAPER_PATHS = (".pdf", "paper", "research")


def _any(c: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def publisher(url: Column) -> Column:
    d = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(_any(d, GOVERNMENT), "government").when(_any(d, ACADEMIC), "academic").when(_any(d, SOCIAL), "social").when(_any(d, NEWS), "news").when(_any(d, BLOGS), "blog").otherwise("vendor")


def source_tier(url: Column) -> Column:
    d = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    return (
        F.when(_any(d, SOCIAL), "EXCLUDED").when(_any(d, PRIMARY) | _any(path, PAPER_PATHS), "PRIMARY").when(_any(d, NEWS), "SECONDARY")
        .when(_any(d, OPINION), "OPINION").otherwise("VENDOR")
    )


def standard_tag(tag: Column) -> Column:
    """Customary spelling of a language tag: language lower, region upper, script capitalised, hyphens."""
    parts = F.split(F.replace(F.trim(tag), F.lit("_"), F.lit("-")), "-")
    spelt = F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(F.length(p) == 2, F.upper(p)).when(F.length(p) == 4, F.initcap(p)).otherwise(F.lower(p)))
    return F.array_join(spelt, "-")


TAG = r"^[A-Za-z]{2,3}(-[A-Za-z]{4})?(-([A-Za-z]{2}|[0-9]{3}))?(-[A-Za-z0-9]{5,8})*$"


def page_status(tag: Column, detected: Column) -> tuple[Column, Column]:
    """(status, advice) of a page's language tag against the detected language; the first rule that fits decides."""
    # The statuses and sentences of the advice.
    base = F.lower(F.split(F.trim(tag), "[-_]")[0])
    std = standard_tag(tag)
    quote = lambda a, b, c: F.concat(F.lit(a), tag, F.lit(b), std, F.lit(c))
    rules = (
        (F.coalesce(tag, F.lit("")) == "", "Critical", F.lit("HTML lang attribute is missing.")),
        (~F.coalesce(base == detected, F.lit(False)), "Critical", F.lit("The detected text language does not match the HTML tag.")),
        (tag != F.trim(tag), "Fix", quote("Syntax error (whitespace). Change '", "' to '", "'")),
        (~tag.rlike(TAG), "Fix", quote("Invalid BCP 47 syntax. Change '", "' to '", "'")),
        (tag != std, "Keep", F.concat(F.lit("Valid, but standard suggests '"), std, F.lit("'"))),
    )
    status, advice = F.lit("Keep"), F.lit("Perfect")
    for condition, s, a in reversed(rules):
        status, advice = F.when(condition, s).otherwise(status), F.when(condition, a).otherwise(advice)
    return status, advice


def pages_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``lang_tag, body, links`` in one projection."""
    return pages.withColumns({"lang_tag": html_lang(F.col(html)), "body": html_text(F.col(html)), "links": absolute_links(F.col(html)), "site": domain(F.col("url"))})
