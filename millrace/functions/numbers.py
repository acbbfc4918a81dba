"""Scores, money and thresholds as expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SPREAD = 0.002
# Warning and critical limits, profit and loss tiers (from notional, profit share, loss share).
LIMITS = {"cpu": (80, 95), "memory": (85, 90), "disk": (90, 95)}
TIERS = ((20_000_000, 0.003, 0.0015), (10_000_000, 0.005, 0.0025), (None, 0.01, 0.005))
GRADES = ((85, "Excellent"), (70, "Good"), (50, "Fair"), (None, "Needs Improvement"))


def ladder(x: Column, steps) -> Column:
    """First step whose bound is reached; the step without a bound is the rest."""
    out = F.lit(None)
    for bound, value in reversed(steps):
        out = F.lit(value) if bound is None else F.when(x >= bound, value).otherwise(out)
    return out


def grade(score: Column) -> Column:
    return ladder(score, GRADES)


def buy_price(price: Column) -> Column:
    return price * (1 + SPREAD)


def sell_price(price: Column) -> Column:
    return price * (1 - SPREAD)


def quantise(x: Column, scale: int = 2) -> Column:
    """Half-even rounding of an exact decimal."""
    return F.bround(x.cast(f"decimal(38,{min(scale + 8, 18)})"), scale).cast(f"decimal(38,{scale})")


def swap_pnl(notional: Column, entry: Column, current: Column, years: Column, side: Column) -> Column:
    dv01 = notional * 0.0001 * years
    bps = (current - entry) * 10000
    return F.when(side == "RCV_FIXED", -bps * dv01).otherwise(bps * dv01)


def trade_signal(pnl: Column, profit: Column | float = 50_000, loss: Column | float = -25_000) -> Column:
    return F.when((pnl >= profit) | (pnl <= loss), "CLOSE").otherwise("HOLD")


def profit_target(notional: Column, volatility: float = 0.02) -> Column:
    return F.round(notional * ladder(notional, [(b, p) for b, p, _ in TIERS]) * (1 + volatility * 10), 2)


def stop_loss(notional: Column, volatility: float = 0.02) -> Column:
    return F.round(-notional * ladder(notional, [(b, q) for b, _, q in TIERS]) * (1 + volatility * 10), 2)


def severity(x: Column, kind: str) -> Column:
    """``warning`` above the first limit, ``critical`` from the second, else null."""
    warn, crit = LIMITS[kind]
    return F.when(x > warn, F.when(x < crit, "warning").otherwise("critical"))


def min_max(x: Column, *by: str) -> Column:
    """Scores scaled to 0..1 within a group; where all are equal every one becomes 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high == low, 0.0).otherwise((x - low) / (high - low))


def min_max_eps(x: Column, *by: str, eps: float = 1e-8) -> Column:
    w = Window.partitionBy(*by)
    return (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + eps)


def max_eps(x: Column, *by: str, eps: float = 1e-8) -> Column:
    return x / (F.max(x).over(Window.partitionBy(*by)) + eps)


def fuse(a: Column, b: Column, wa: float = 0.5, wb: float = 0.5) -> Column:
    return wa * F.coalesce(a, F.lit(0.0)) + wb * F.coalesce(b, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, eps: float = 1e-10) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def jaccard(a: Column, b: Column) -> Column:
    """0 where either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def answer_score(query: Column, context: Column, answer: Column, history: Column, answer_length: Column) -> Column:
    """Struct of relevance, accuracy, completeness, consistency, overall and passed, from token sets."""
    past = jaccard(history, answer)
    consistency = F.when((past >= 0.1) | (F.size(history) == 0), 1.0).otherwise(past)
    return answer_marks(jaccard(query, answer), jaccard(context, answer), consistency, answer_length)


def answer_marks(relevance: Column, accuracy: Column, consistency: Column, answer_length: Column) -> Column:
    """The struct of ``answer_score`` from its parts."""
    completeness = F.when(accuracy >= 0.2, F.least(F.lit(1.0), answer_length / 300.0)).otherwise(0.3)
    total = 0.3 * relevance + 0.4 * accuracy + 0.15 * completeness + 0.15 * consistency
    overall = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    three = lambda c, n: F.round(c, 3).alias(n)
    return F.struct(
        three(relevance, "relevance"), three(accuracy, "accuracy"), three(completeness, "completeness"),
        three(consistency, "consistency"), three(overall, "overall"), (overall >= 0.7).alias("passed"),
    )


def band(x: Column, width: float) -> Column:
    return F.when(x > width, "Positive").when(x < -width, "Negative").otherwise("Neutral")


def first_score(*scores: Column) -> Column:
    """First score that is neither null nor zero."""
    return F.coalesce(*[F.nullif(s, F.lit(0.0)) for s in scores])
