"""Text expressions: Column in, Column out, all inside Catalyst. Null stays null unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character replacements of the cleaner, in order.
CLEAN_CHARS = (
    ("ﬁ", "fi"),
    ("ﬂ", "fl"),
    (" ", " "),
    ("–", "-"),
    ("—", "-"),
    ("‘", "'"),
    ("’", "'"),
    ("“", '"'),
    ("”", '"'),
)
# Sensitive-data patterns.
SENSITIVE = {
    "api_key": r"(?i)(api[_-]?key|apikey)[\s:=]+['\"]?([a-zA-Z0-9_\-]{20,})",
    "password": r"(?i)(password|passwd|pwd)[\s:=]+['\"]?([^\s\"']{6,})",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
}
# Keyword lists.
HARMFUL = ("hack", "exploit", "illegal", "bomb", "weapon", "steal", "pirate", "crack password", "bypass security")
BULLISH = ("surge", "gain", "rally", "rise", "bullish", "profit", "growth", "beat", "strong", "up", "higher", "soar", "jump", "outperform")
BEARISH = ("fall", "drop", "plunge", "crash", "bearish", "loss", "decline", "miss", "weak", "down", "lower", "sink", "tumble", "underperform")
SEO_KEYWORDS = ("ai", "automation", "cloud", "assistant")
TONES = (
    ("Positive", ("excited", "amazing", "great", "incredible")),
    ("Negative", ("sad", "terrible", "worst", "angry")),
    ("Polite", ("please", "kindly", "thank")),
)
# Frequent words by which a short text's language is told.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that"),
    "fr": ("le", "les", "et", "des", "une", "est"),
    "de": ("der", "die", "das", "und", "nicht", "ist"),
    "es": ("el", "los", "las", "y", "una", "es"),
}
# Patterns and character entities.
ERROR_PATTERN = "ERROR|FATAL|Exception|Traceback"
EMAIL_EXACT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def squeeze(c: Column) -> Column:
    """Runs of white space (Unicode) become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-cased white-space tokens; empty text has none."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda t: t != "")


def token_set(c: Column) -> Column:
    """Distinct ASCII letter-digit tokens, lower-cased, in order of first appearance."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda t: t != ""))


def clean(c: Column) -> Column:
    """Seven ordered steps for text extracted from documents; null and blank give the empty string."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "\f", "\n")
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    t = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), CLEAN_CHARS, t)
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?imdU)^[ \t]*page\s+\d+(\s+of\s+\d+)?[ \t]*$", "")
    t = F.regexp_replace(t, r"(?imd)^[ \t]*confidential[ \t]*$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def meaningful(c: Column, least: int = 100) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")) >= least


def word_count(c: Column) -> Column:
    return F.size(tokens(F.coalesce(c, F.lit(""))))


def line_count(c: Column) -> Column:
    """Lines by line feed; a final line feed opens no further line, empty text has none."""
    t = F.coalesce(c, F.lit(""))
    return F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, "\n$", ""), "\n", -1)))


def caption_clean(c: Column) -> Column:
    """Caption text without tags, white space collapsed."""
    return squeeze(F.regexp_replace(c, r"<[^>]+>", ""))


def input_clean(c: Column, most: int = 2000) -> Column:
    """Long input is cut and marked, and nothing else is done to it; the rest loses scripts and runs of marks."""
    short = F.regexp_replace(c, r"(?is)<script.*?</script>", "")
    short = F.regexp_replace(short, r"""[<>"';}{]{3,}""", "")
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(squeeze(short))


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL_EXACT)


def sensitive_kinds(c: Column) -> Column:
    """Sorted array of the sensitive-data kinds that occur."""
    hits = [F.when(c.rlike(p), F.lit(k)) for k, p in sorted(SENSITIVE.items())]
    return F.filter(F.array(*hits), lambda k: k.isNotNull())


def contained(c: Column, words) -> Column:
    """The words of a list that occur as substrings, in the list's order."""
    low = F.lower(c)
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def sentiment(c: Column) -> Column:
    up, down = F.size(contained(c, BULLISH)), F.size(contained(c, BEARISH))
    return F.when(up > down * 1.5, "BULLISH").when(down > up * 1.5, "BEARISH").otherwise("NEUTRAL")


def tone(c: Column) -> Column:
    """First tone, in order, one of whose words occurs as a substring."""
    low, out = F.lower(c), F.lit("Neutral")
    for name, words in reversed(TONES):
        out = F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), name).otherwise(out)
    return out


def first_category(c: Column, table, default: str = "general") -> Column:
    """First category of an ordered (name, patterns) table with a pattern that is found, whatever the case."""
    out = F.lit(default)
    for name, patterns in reversed(table):
        hit = reduce(lambda a, b: a | b, [c.rlike(f"(?i){p}") for p in patterns])
        out = F.when(hit, name).otherwise(out)
    return out


def occurrences(c: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def keyword_density(c: Column, words=SEO_KEYWORDS) -> Column:
    low = F.lower(c)
    hits = reduce(lambda a, b: a + b, [occurrences(low, w) for w in words])
    return F.round(hits / F.greatest(F.regexp_count(low, F.lit(r"(?U)\b\w+\b")), F.lit(1)) * 100, 2)


def readability(c: Column) -> Column:
    """Struct of words, sentences, flesch and level; text without words has a null score."""
    words = F.regexp_count(c, F.lit(r"(?U)\b\w+\b"))
    sentences = F.greatest(F.regexp_count(c, F.lit(r"[.!?]")), F.lit(1))
    syllables = F.regexp_count(F.lower(c), F.lit(r"[aeiouy]+"))
    flesch = F.when(words > 0, 206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words))
    level = F.when(flesch > 80, "Easy").when(flesch > 60, "Moderate").when(flesch.isNotNull(), "Hard")
    return F.struct(words.alias("words"), sentences.alias("sentences"), F.round(flesch, 2).alias("flesch"), level.alias("level"))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def domain(url: Column) -> Column:
    """Authority, lower-cased (a port stays), without a leading ``www.``; no authority gives the empty string."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def human_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024.0, 1)))
        .when(n.isNotNull(), F.format_string("%.1f MB", F.bround(n / (1024.0 * 1024.0), 1)))
    )


def safe_name(topic: Column, epoch: Column, most: int = 100) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.lower(topic), r"(?U)\s+", "_"), r"[^a-z0-9_-]", "")
    cut = F.when(F.length(name) > most, F.btrim(F.substring(name, 1, most), F.lit("_"))).otherwise(name)
    return F.concat_ws("_", cut, epoch.cast("string"))


def phone_digits(c: Column) -> Column:
    d = F.regexp_replace(c, r"\D", "")
    return F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)


def trace_name(trace_id: Column) -> Column:
    """The text between ``trace_`` and the first ``0``."""
    return F.regexp_extract(trace_id, r"^trace_([^0]*)", 1)


def first_json(c: Column) -> Column:
    """First brace-to-brace stretch without nesting; empty if none."""
    return F.regexp_extract(c, r"(?s)(\{.*?\})", 1)


def html_text(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", "")
    t = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, t)
    t = F.regexp_replace(t, r"(?i)</(p|div|h[1-6]|li|tr|br)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\n\s*\n", "\n\n"), r"[ \t]+", " ")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def html_lang(c: Column) -> Column:
    """Value of the html element's lang attribute; null where there is none."""
    v = F.regexp_extract(c, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']([^"']*)["']""", 1)
    return F.when(v != "", v)


def absolute_links(c: Column) -> Column:
    links = F.regexp_extract_all(c, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), 1)
    return F.filter(links, lambda u: u.rlike("^https?://"))


def markdown_plain(c: Column) -> Column:
    t = F.regexp_replace(c, r"(\*\*|__)(.*?)\1", "$2")
    t = F.regexp_replace(t, r"(\*|_)(.*?)\1", "$2")
    t = F.regexp_replace(t, r"#+\s*", "")
    t = F.regexp_replace(t, r"(?md)^\|.*\|$", "")
    return F.regexp_replace(F.replace(t, F.lit("<br/>"), F.lit("\n")), r"(?U)^\s+|\s+$", "")


def stop_word_language(c: Column) -> Column:
    """Language with the most stop words among a text's tokens (the first listed on ties); ``und`` without any."""
    words, out, best = tokens(c), F.lit("und"), F.lit(0)
    held = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed)))
    for lang, listed in STOP_WORDS.items():
        n = held(listed)
        out, best = F.when(n > best, lang).otherwise(out), F.greatest(n, best)
    return out


def replace_all(c: Column, pairs) -> Column:
    """Literal replacements in the given order."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def reversed_title(c: Column) -> Column:
    """The reversed string, its words capitalised."""
    return F.array_join(F.transform(tokens(F.reverse(c)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def percent(c: Column) -> Column:
    return F.regexp_replace(c, "%", "").try_cast("double")


def normal_key(c: Column) -> Column:
    return F.lower(F.trim(c))
