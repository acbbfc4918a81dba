"""Query catalogue over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import ledger
from millrace.plans import analytics, relational, surfaces, texts
from millrace.plans.base import Tables

PARTS = (relational.C, analytics.C, texts.C, surfaces.C)


def portfolio_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts by return on a market snapshot: the ten best."""
    t = Tables(spark, sf_dir)
    p = ledger.profit(relational.trades(t), relational.prices(t))
    return p.orderBy(F.desc("roi"), "account").limit(10)


def queries() -> dict:
    return {k: f for c in PARTS for k, f in c.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for c in PARTS for k, s in c.sql.items()}
