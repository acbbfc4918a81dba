"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every document draws its number of copies from a Poisson distribution whose mean is the repetition rate of its
source; the draw inverts the distribution at a uniform number hashed from seed and id, so a rerun or a lost executor
gives the same copies. Each document is exploded by its count and every copy gets a hashed key that decides its partition
and its place in it: a global shuffle, for which nothing has to be sampled or drawn twice. No source is ever gathered:
rates come from a map-side combined aggregation with one row per source, and the draw is made row by row.

The rate of source s is ``budget * weight(s) / sum of weights / rows(s)``. Default weights are ``rows(s) ** 0.5``
(temperature sampling: small sources are repeated, large ones thinned); the default budget is the number of rows.

Defined results: a null source is a source of its own (its weight is that of the key None); null or repeated ids draw
like any other value (repeated rows share their count but are copied separately); empty or long texts are not looked at;
an empty table gives no rows; sources without a stated weight, or with weight 0 or below, get no copies when weights are
given; columns may have any name, rows travel as one value beside what is computed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.keys import once

#: Terms summed beyond the mean (and below a large one): the tail beyond ``mean + 12 * sqrt(mean) + 30`` is below 1e-15.
TAIL_SD, TAIL = 12, 30
#: Means up to which the sum starts at 0. ``exp(-rate)`` is 0.0 from about 745 on.
DIRECT = 500
#: Sources up to which rates are broadcast, and the salts that split a hot source beyond.
BROADCAST_SOURCES, SALTS = 100_000, 64


def uniform(seed: str, *cols: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_rates(
    docs: DataFrame, source_col: str = "source", weights: dict[str | None, float] | None = None, budget: float | None = None
) -> DataFrame:
    """``source, rows, rate``: one row per source."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weighted = counts.withColumn("w", F.sqrt("rows"))
    else:
        pairs = [F.struct(F.lit(k).cast("string"), F.lit(float(max(v, 0)))) for k, v in weights.items() if k is not None]
        table = F.map_from_entries(F.array(*pairs)) if pairs else F.lit(None).cast("map<string,double>")
        unnamed = F.lit(float(max(weights.get(None, 0.0), 0)))
        weighted = counts.withColumn("w", F.when(F.col("source").isNull(), unnamed).otherwise(F.coalesce(table[F.col("source")], F.lit(0.0))))
    total = weighted.agg(F.sum("w").alias("all_w"), F.sum("rows").alias("all_rows"))  # one row
    goal = F.col("all_rows").cast("double") if budget is None else F.lit(float(budget))
    rate = F.when(F.col("all_w") > 0, goal * F.col("w") / F.col("all_w") / F.col("rows")).otherwise(0.0)
    return weighted.join(F.broadcast(total)).select("source", "rows", rate.alias("rate"))


def poisson_table(rate: Column) -> Column:
    """``k0, cdf``: the distribution's sums at k0, k0 + 1 and so on. Spark has no Poisson quantile, so the terms are summed in an
    array fold, once a source.

    Up to a mean of ``DIRECT`` the sum starts at 0. Beyond, ``exp(-rate)`` nears the least double, so it starts as far below
    the mean as it ends above, at a term taken from its logarithm (Stirling's series; the error is below 1e-14 from 200 on).
    """
    far = rate > DIRECT
    width = TAIL_SD * F.sqrt(rate) + TAIL
    k0 = F.when(far, F.floor(rate - width)).otherwise(0).cast("int")
    last = F.ceil(rate + width).cast("int")
    log_p0 = (k0 - rate) - k0 * F.log1p((k0 - rate) / rate) - F.log(2 * math.pi * k0) / 2 - 1 / (12 * k0) + 1 / (360.0 * k0 * k0 * k0)
    p0 = F.when(far, F.exp(log_p0)).otherwise(F.exp(-rate))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        return F.struct(p.alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + p).alias("cdf"))

    sums = F.aggregate(F.sequence(k0 + 1, last), F.struct(p0.alias("p"), F.array(p0).alias("cdf")), step, lambda acc: acc["cdf"])
    return F.struct(k0.alias("k0"), sums.alias("cdf"))


def poisson_quantile(table: Column, u: Column) -> Column:
    """The least k with CDF(k) >= u, from the distribution's table: as many steps beyond k0 as sums lie below u."""
    cdf = table["cdf"]
    return table["k0"] + F.least(F.size(F.filter(cdf, lambda c: c < u)), F.size(cdf) - 1)


def _with_rate(rows: DataFrame, rates: DataFrame, source: Column) -> DataFrame:
    """Rates reach documents by broadcast when there are few sources, else by a join on source and salt."""
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(rates), source.eqNullSafe(F.col("source")))
    salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    return rows.withColumn("own", own).join(salted, source.eqNullSafe(F.col("source")) & (F.col("own") == F.col("salt")))


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    seed: str = "mix-1",
    budget: float | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    shuffle: bool = True,
) -> DataFrame:
    """``docs`` replicated to the target rates, plus ``copy_no`` (from 1) and ``shuffle_key``, in global random order; columns of those
    two names are replaced."""
    docs = docs.drop("copy_no", "shuffle_key")
    rates = source_rates(docs, source_col, weights, budget).select("source", poisson_table(F.col("rate")).alias("draw"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))  # no name in it can clash with one beside it
    key, u = F.col("doc").getField(id_col), uniform(seed, F.col("doc").getField(id_col))
    drawn = _with_rate(rows, rates, F.col("doc").getField(source_col)).select("doc", once(poisson_quantile(F.col("draw"), u)).alias("n"))
    copies = drawn.filter("n > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))
    order = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), key.cast("string"), F.col("copy_no").cast("string")))
    out = copies.withColumn("shuffle_key", order)
    if shuffle:
        out = out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return out.select("doc.*", "copy_no", "shuffle_key")


def op6(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "lang", "n_chars", "text"))


ORACLE_SQL = """
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(sqrt(n)) AS all_w, sum(n)::DOUBLE AS all_rows FROM c),
r AS (SELECT source, all_rows * sqrt(n) / all_w / n AS rate FROM c, t),
k0 AS (SELECT source, rate, CASE WHEN rate > 500 THEN floor(rate - 12 * sqrt(rate) - 30) ELSE 0 END::BIGINT AS k FROM r),
f AS (SELECT source, rate, k, CASE WHEN rate > 500 THEN exp(k - rate - k * ln(k / rate) - ln(2 * pi() * k) / 2 - 1 / (12.0::DOUBLE * k)
        + 1 / (360.0::DOUBLE * k * k * k)) ELSE exp(-rate) END AS p0 FROM k0),
p AS (SELECT source, rate, k, p0 AS pk, p0 AS cdf FROM f
      UNION ALL SELECT source, rate, k + 1, pk * rate / (k + 1), cdf + pk * rate / (k + 1) FROM p
      WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
u AS (SELECT *, (('0x' || substr(md5('mix-1|' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM documents),
n AS (SELECT u.doc_id, min(p.k) AS copies FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source AND p.cdf >= u.u
      GROUP BY u.doc_id)
SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, g.copy_no::INTEGER AS copy_no,
       md5('mix-1-order|' || d.doc_id || '|' || g.copy_no) AS shuffle_key
FROM documents d JOIN n ON d.doc_id = n.doc_id, LATERAL (SELECT unnest(range(1, n.copies + 1)) AS copy_no) g
"""
