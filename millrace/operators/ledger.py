"""Ledger operators. State that one decision hands to the next is an ordered fold: a sorted stream of a key's rows, one
state at a time, so an account of any length costs as many steps as it has rows."""

from __future__ import annotations

import decimal
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import SPREAD
from millrace.operators import scan
from millrace.operators.core import lookup
from millrace.operators.fold import fold

MIN_SHORT = -1000.0


def holdings(trades: DataFrame) -> DataFrame:
    """``account, symbol, quantity``: open positions."""
    return trades.groupBy("account", "symbol").agg(F.sum("signed").alias("quantity")).filter("quantity <> 0")


def valued(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Positions with price (0 where unknown) and value. ``prices`` is ``symbol, price``."""
    p = prices.select(F.col("symbol").alias("__s"), "price")
    return lookup(positions, p, F.col("symbol") == F.col("__s"), "price").drop("__s").withColumn("value", F.col("quantity") * F.col("price"))


def profit(trades: DataFrame, prices: DataFrame, opening: float = 10_000.0) -> DataFrame:
    """``account, spent, cash, value, pnl, roi, n_trades``: cash is the opening balance less net spending; profit is the
    portfolio's worth less the opening balance; return in per cent."""
    # One pass over the trades: what an account did in a symbol adds up to what it did.
    own = trades.groupBy("account", "symbol").agg(F.sum(F.col("signed") * F.col("price")).alias("spent"), F.count(F.lit(1)).alias("n"), F.sum("signed").alias("quantity"))
    sums = [F.sum("spent").alias("spent"), F.sum("n").alias("n_trades"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("stock")]
    out = valued(own, prices).groupBy("account").agg(*sums)
    cash = F.lit(opening) - F.col("spent")
    value = cash + F.col("stock")
    return out.select("account", "spent", cash.alias("cash"), value.alias("value"), (value - opening).alias("pnl"), (100 * (value - opening) / opening).alias("roi"), "n_trades")


def running_position(trades: DataFrame, order: list[str], hot_rows: int | None = None) -> DataFrame:
    """``trades`` with ``position_after``; an account's symbol of any number of trades is scanned over many tasks."""
    return scan.running(trades, ["account", "symbol"], order, "signed", "position_after", "sum", hot_rows)


def average_cost(trades: DataFrame, order: list[str], by: tuple[str, ...] = ("account", "symbol")) -> DataFrame:
    """Moving-average cost with realised profit, quantised half-even at every step; sells beyond the position are
    rejected and change nothing, and so are trades without a quantity or price. Returns ``<by>, <order>, side, quantity,
    price, accepted, position_after, avg_cost_after, realized``."""
    own = [c for c in order if c not in by]
    rows = trades.select(*by, *own, "side", F.col("quantity").cast("decimal(28,8)").alias("quantity"), F.col("price").cast("decimal(28,4)").alias("price"))

    def fresh():
        decimal.setcontext(decimal.Context(prec=60))  # beyond any product of the columns
        cents, parts, units = Decimal("0.01"), Decimal("0.0001"), Decimal("0.00000001")
        held, cost = Decimal(0), Decimal(0)
        even = lambda x: x.quantize(cents, decimal.ROUND_HALF_EVEN)
        mean = lambda: even(cost / held) if held else Decimal("0.00")

        def step(side, q, p):
            nonlocal held, cost
            gain, ok = Decimal("0.00"), q is not None and p is not None and (side == "buy" or q <= held)
            if ok and side == "buy":
                held, cost = held + q, (cost + q * p).quantize(parts, decimal.ROUND_HALF_UP)
            elif ok:
                part = even(mean() * q)
                gain = even(q * p - part)
                held, cost = held - q, Decimal(0) if held == q else even(cost - part)
            return ok, held.quantize(units), mean(), gain

        return step

    adds = "accepted boolean, position_after decimal(28,8), avg_cost_after decimal(28,2), realized decimal(28,2)"
    return fold(rows, list(by), [*own, "side", "quantity", "price"], ["side", "quantity", "price"], fresh, adds)


def admit_funds(trades: DataFrame, order: list[str], opening: float = 10_000.0, short: bool = False) -> DataFrame:
    """Which trades an account accepts, one after another: a buy at price * (1 + spread) needs the cash and a known
    price, a sell at price * (1 - spread) needs the holding (or, where ``short``, that holding * price is above
    MIN_SHORT). Returns ``account, <order>, reason, balance_after``; an accepted trade has a null reason. A null price
    counts as 0."""
    own = [c for c in order if c != "account"]
    cols = list(dict.fromkeys(["account", *own, "symbol", "side"]))
    rows = trades.select(*cols, F.col("quantity").cast("double").alias("quantity"), F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"))

    def fresh():
        cash, held = opening, {}

        def step(side, symbol, q, p):
            nonlocal cash
            have, reason = held.get(symbol, 0.0), None
            buy, sell = p * (1 + SPREAD), p * (1 - SPREAD)
            if q is None or q <= 0:
                reason = "quantity"
            elif side == "buy":
                reason = "funds" if buy * q > cash else "symbol" if p == 0 else None
            elif side == "sell" and (have * p <= MIN_SHORT if short else have < q):
                reason = "holdings"
            if reason is None:
                cash += -buy * q if side == "buy" else sell * q
                held[symbol] = have + (q if side == "buy" else -q)
            return reason, cash

        return step

    reads = ["side", "symbol", "quantity", "price"]
    return fold(rows, ["account"], [*own, "side", "quantity", "price"], reads, fresh, "reason string, balance_after double", ["account", *own])


def unrealised(positions: DataFrame, prices: DataFrame, strict: bool = False) -> DataFrame:
    """``positions`` (account, symbol, quantity, avg_cost) with ``price, market_value, unrealized``, quantised half-even at every
    step. A symbol without a price has price 0, so its whole cost is lost; where ``strict`` it fails the query."""
    p = prices.select(F.col("symbol").alias("of"), F.col("price").cast("decimal(18,2)").alias("price"))
    joined = positions.join(p, F.col("symbol") == F.col("of"), "left").drop("of")
    price = F.coalesce("price", F.raise_error(F.lit("no price")).cast("decimal(18,2)") if strict else F.lit(Decimal("0.00")))
    worth = lambda c: F.bround(F.col("quantity").cast("decimal(18,4)") * c, 2).cast("decimal(28,2)")
    priced = joined.withColumn("price", price.cast("decimal(18,2)"))
    return priced.withColumn("market_value", worth(F.col("price"))).withColumn("unrealized", worth(F.col("price") - F.col("avg_cost").cast("decimal(18,2)")))


def report(profits: DataFrame) -> DataFrame:
    """``account, report``: totals as JSON."""
    return profits.select("account", F.to_json(F.struct(F.col("account"), F.round("value", 2).alias("total_portfolio_value"), F.round("pnl", 2).alias("total_profit_loss"))).alias("report"))


def merge_items(items: DataFrame, order: list) -> DataFrame:
    """Items of equal lower-cased, trimmed name: quantities add up, the first category and price stay."""
    key = F.lower(F.trim("name"))
    first = lambda c: F.min_by(c, F.struct(*order)).alias(c)
    return items.groupBy(key.alias("key")).agg(first("name"), F.sum("quantity").alias("quantity"), first("category"), first("price"))


def stock_after(moves: DataFrame, stock: DataFrame, order: list) -> DataFrame:
    """Sales of a product as long as the running total of accepted ones fits its stock; a refused sale takes nothing.
    Returns ``product, <order>, quantity, accepted, left``. A product without stock has 0; a null quantity is refused."""
    own = [c for c in order if c != "product"]
    rows = moves.select("product", *own, F.col("quantity").cast("double").alias("quantity")).join(stock, "product", "left")
    rows = rows.withColumn("on_hand", F.coalesce(F.col("on_hand").cast("double"), F.lit(0.0)))

    def fresh():
        n = None

        def step(q, on_hand):
            nonlocal n
            n = on_hand if n is None else n
            ok = q is not None and q <= n
            n -= q if ok else 0.0
            return ok, n

        return step

    return fold(rows, ["product"], [*own, "quantity"], ["quantity", "on_hand"], fresh, "accepted boolean, left double", ["product", *own, "quantity"])


def reject_reason(side: Column, quantity: Column, price: Column, symbol: Column) -> Column:
    """First precondition that fails, in order; null for a valid trade."""
    return (
        F.when(F.coalesce(F.trim(symbol), F.lit("")) == "", "symbol")
        .when(~F.coalesce(F.lower(side).isin("buy", "sell"), F.lit(False)), "side")
        .when(~F.coalesce(quantity > 0, F.lit(False)), "quantity")
        .when(~F.coalesce(price > 0, F.lit(False)), "price")
    )
