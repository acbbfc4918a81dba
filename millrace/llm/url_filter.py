"""URL filtering by rules indexed on their rarest literal token.

A rule names a verdict, a host and a path prefix, or a free pattern. Each is turned into a regular expression over
the lower-cased host and the path, and its literal tokens are the pieces that any matching URL must contain *whole*.
The corpus' own token counts pick the rarest of them; the rule is indexed under that one token. A URL is cut into its
tokens, the tokens fetch candidate rules by an equi-join, and only the candidates run their regular expression.
URLs are deduplicated per (host, path) by a map-side combined aggregation before tokens are exploded, so a hot URL
is judged once.

The rule set is a parameter and small by construction; it is broadcast only up to ``BROADCAST_RULES`` rules, beyond
that the same join runs shuffled, and AQE splits the tokens that most URLs have. Rules without any whole literal token are kept under the empty token, which every
URL carries, so none is lost.

Defined results: null URLs, and those without ``://``, have empty host and path, match no rule and get the default
verdict; repeated rows are judged alike; among rules that fit, the longest wins (host and path together), then the
one that comes first in the rule list.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` fits itself and its subdomains, ``path`` is a literal prefix; or ``pattern`` runs on ``host/path``.

    ``tokens`` are the whole tokens a free pattern needs; for host rules they are derived.
    """

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str | None = None
    tokens: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    def regex(self) -> str:
        if self.pattern is not None:
            return self.pattern
        literal = lambda s: "".join(c if c.isalnum() else "\\" + c for c in s)
        return rf"^(?:[^/]*\.)?{literal(self.host)}\n{literal(self.path)}"

    def literals(self) -> list[str]:
        if self.pattern is not None:
            return list(self.tokens) or [""]
        whole = re.split(r"[./]", self.host)
        path = re.split(r"[^A-Za-z0-9]", self.path)[:-1]  # the last piece may go on in the URL
        return [t for t in [*whole, *path] if t] or [""]


#: The contract's rules, in order.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: The method's own rules for URLs that no listed rule fits: hosts that name a nuisance in a hyphenated label.
DEFAULT_RULES = tuple(
    Rule("block", pattern=rf"^(?:[^/\n]*[.-])?{word}(?:[.-][^\n]*)?\n", tokens=(word,))
    for word in ("ads", "adult", "bets", "casino", "malware", "phishing", "pills", "porn", "spam", "warez")
)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    # Hosts are cut at anything but letters and digits, and also taken by whole label.
    pieces = F.concat(F.split(host, r"[^\p{L}\p{N}]+"), F.split(host, r"\."), F.split(path, r"[^A-Za-z0-9]"))
    return F.array_distinct(F.concat(F.filter(pieces, lambda t: t != ""), F.array(F.lit(""))))


def _index(spark: SparkSession, rules, token_counts: DataFrame | None) -> DataFrame:
    """``token, ord, size, verdict, name, regex``: every rule under its rarest literal token."""
    rows = [(i, level, t, len(r.name), r.verdict, r.name or None, r.regex()) for i, (level, r) in enumerate(rules) for t in set(r.literals())]
    table = spark.createDataFrame(rows, "ord int, level int, token string, size int, verdict string, name string, regex string")
    if token_counts is not None:
        table = table.join(token_counts, "token", "left")
    else:
        table = table.withColumn("n", F.lit(0))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)), "token", "level", "size", "verdict", "name", "regex")).alias("r")
    return table.groupBy("ord").agg(rarest).select("ord", "r.token", "r.level", "r.size", "r.verdict", "r.name", "r.regex")


def judge(urls: DataFrame, *lists, host: str = "host", path: str = "path") -> DataFrame:
    """Distinct ``host, path`` with ``rule, verdict`` of the winning rule, for those that any rule fits. All rule lists are
    looked up at once; a rule of an earlier list wins over any of a later one."""
    spark = urls.sparkSession
    rules = [(level, r) for level, some in enumerate(lists) for r in some]
    if not rules:
        return spark.createDataFrame([], "host string, path string, rule string, verdict string")
    distinct = urls.select(F.col(host).alias("host"), F.col(path).alias("path")).distinct()
    tokens = distinct.withColumn("token", F.explode(_tokens(F.col("host"), F.col("path"))))
    wanted = spark.createDataFrame([(t,) for t in sorted({t for _, r in rules for t in r.literals()})], "token string")
    sized = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda x: x)
    counts = tokens.join(sized(wanted), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    candidates = tokens.join(sized(_index(spark, rules, counts)), "token")
    fits = candidates.filter(F.expr("rlike(concat(host, '\\n', path), regex)"))
    best = F.max_by(F.struct("name", "verdict"), F.struct(-F.col("level"), F.col("size"), -F.col("ord")))
    won = fits.groupBy("host", "path").agg(best.alias("w"))
    return won.select("host", "path", F.col("w.name").alias("rule"), F.col("w.verdict").alias("verdict"))


def url_filter(pages: DataFrame, rules=RULES, default_rules=DEFAULT_RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; columns of those names in the input are replaced."""
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("page"), host.alias("host"), path.alias("path"))
    out = rows.join(judge(rows, rules, default_rules), ["host", "path"], "left")
    kept = [F.col("page").getField(c).alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c == url_col]
    return out.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op10(pages: DataFrame) -> DataFrame:
    return url_filter(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
             THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, arg_max(struct_pack(n := rhost || rpath, v := verdict), length(rhost || rpath)) AS w
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT h.page_id, host, path, w.n AS rule, coalesce(w.v,
  CASE WHEN regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|malware|phishing|pills|porn|spam|warez)([.-]|$)')
       THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m ON h.page_id = m.page_id
"""
