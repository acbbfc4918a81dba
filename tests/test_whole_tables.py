"""Queries without an SQL form, or whose SQL covers less: every row of the tables gets its result."""

from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Context, Decimal, localcontext

import pandas as pd
import pytest

from millrace.plans import catalogue
from millrace.sources import tables

Q = catalogue.queries()
SPREAD = 0.002


def _decided(trades, short):
    """Reason and balance of each trade of one account, in order."""
    cash, held = 50_000.0, {}
    for r in trades:
        q, p, own = float(r.quantity), float(r.price), held.get(r.symbol, 0.0)
        reason = None
        if q <= 0:
            reason = "quantity"
        elif r.side == "buy":
            reason = "funds" if p * (1 + SPREAD) * q > cash else "symbol" if p == 0 else None
        elif (own * p <= -1000.0) if short else own < q:
            reason = "holdings"
        if reason is None:
            cash += -p * (1 + SPREAD) * q if r.side == "buy" else p * (1 - SPREAD) * q
            held[r.symbol] = own + (q if r.side == "buy" else -q)
        yield reason, cash


@pytest.mark.parametrize("name", ["ldg2_admit_funds", "ldg4_admit_short"])
def test_every_account_gets_decisions(spark, sf_dir, name):
    key = ["account", "ts", "l_orderkey", "l_linenumber", "symbol", "l_suppkey"]
    trades = tables.trades(spark, sf_dir).orderBy(*key).collect()
    got = Q[name](spark, sf_dir).orderBy(*key).collect()
    assert [tuple(r[c] for c in key) for r in got] == [tuple(r[c] for c in key) for r in trades]
    by = {}
    for r in trades:
        by.setdefault(r.account, []).append(r)
    want = [x for a in by for x in _decided(by[a], name == "ldg4_admit_short")]
    assert [r.reason for r in got] == [w[0] for w in want]
    assert [r.balance_after for r in got] == pytest.approx([w[1] for w in want])


def test_average_cost_of_every_trade(spark, sf_dir):
    """Plain decimals, trade by trade."""
    order = ["ts", "l_orderkey", "l_linenumber", "l_suppkey"]
    key = ["account", "symbol", *order]
    got = Q["win5_avg_cost"](spark, sf_dir).orderBy(*key, "side", "quantity", "price").collect()
    assert len(got) == tables.trades(spark, sf_dir).count()
    cent, half = Decimal("0.01"), ROUND_HALF_EVEN
    with localcontext(Context(prec=50)):
        at, shares, cost = None, Decimal(0), Decimal(0)
        for r in got:
            if at != (r.account, r.symbol):
                at, shares, cost = (r.account, r.symbol), Decimal(0), Decimal(0)
            accepted, gain = r.side == "buy" or r.quantity <= shares, Decimal(0)
            if accepted and r.side == "buy":
                cost = (cost + r.quantity * r.price).quantize(Decimal("0.0001"), ROUND_HALF_UP)
                shares += r.quantity
            elif accepted:
                sold = ((cost / shares).quantize(cent, half) * r.quantity).quantize(cent, half)
                gain = (r.quantity * r.price - sold).quantize(cent, half)
                shares -= r.quantity
                cost = (cost - sold).quantize(cent, half) if shares else Decimal(0)
            mean = (cost / shares).quantize(cent, half) if shares else Decimal(0)
            assert (r.accepted, r.position_after, r.avg_cost_after, r.realized) == (accepted, shares, mean, gain)


def test_sketches_are_close(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    r = Q["agg41_sketches"](spark, sf_dir).first()
    assert r["parts"] == pytest.approx(li.select("l_partkey").distinct().count(), rel=0.1)
    values = sorted(x.l_quantity for x in li.select("l_quantity").collect())
    assert values[int(len(values) * 0.49)] <= r["median"] <= values[int(len(values) * 0.51)]


@pytest.fixture(scope="module")
def texts_dir(tmp_path_factory):
    """24 benchmark items found in one document each, and item 5000 in twelve."""
    d = tmp_path_factory.mktemp("texts")
    ids = [*range(24), 5000]
    items = {i: " ".join(f"w{i}x{j}" for j in range(12)) for i in ids}
    docs = [f"start {items[i]} end" for i in ids for _ in range(12 if i == 5000 else 1)]
    pd.DataFrame({"item_id": ids, "text": list(items.values())}).to_parquet(d / "benchmark.parquet")
    pd.DataFrame({"doc_id": range(len(docs)), "text": docs, "lang": "en", "source": "s", "n_chars": [len(x) for x in docs]}).to_parquet(d / "documents.parquet")
    pd.DataFrame({"vec_id": ids, "label": 0, "embedding": [[float(i % 5), 1.0] for i in ids]}).to_parquet(d / "embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["ret2_bm25_topk", "ret8_rerank", "ret11_metrics"])
def test_every_item_is_searched(spark, texts_dir, name):
    assert {r.query_id for r in Q[name](spark, texts_dir).collect()} == {*range(24), 5000}


def test_quality_counts_searched_items(spark, texts_dir):
    assert {r.query_id: (r.mrr, round(r.recall, 3)) for r in Q["ret11_metrics"](spark, texts_dir).collect()} == {**{i: (1.0, 1.0) for i in range(24)}, 5000: (1.0, 0.833)}
    assert {r["size"]: r.mrr for r in Q["ret12_sweep"](spark, texts_dir).collect()} == {100: 1.0, 200: 1.0, 400: 1.0}
    got = {r.method: r for r in Q["ret13_method_report"](spark, texts_dir).collect()}
    assert (got["bm25"].mrr, got["bm25"].recall) == (1.0, round((24 + 10 / 12) / 25, 3))


def test_long_documents(spark, tmp_path):
    texts = ["short", "line of text\n" * 200 + "## **end** of it\n| x | y |\nlast", None]
    sizes = pd.array([5, 3 * 1024 * 1024, None], dtype="Int64")
    pd.DataFrame({"doc_id": range(3), "text": texts, "lang": "en", "source": "s", "n_chars": sizes}).to_parquet(tmp_path / "documents.parquet")
    assert {r.doc_id: r["size"] for r in Q["str12_human_size"](spark, str(tmp_path)).collect()} == {0: "5 B", 1: "3.0 MB", 2: None}
    plain = {r.doc_id: r.plain for r in Q["str30_markdown"](spark, str(tmp_path)).collect()}
    assert plain[1].endswith("line of text\nend of it\n\nlast") and plain[0].endswith("short") and plain[2] is None


def test_answers_are_scored_against_every_item(spark, texts_dir):
    got = {(r.doc_id, r.item_id): r.relevance for r in Q["mth10_answer_score"](spark, texts_dir).collect()}
    assert set(got) == {(d, i) for d in range(36) for i in [*range(24), 5000]}
    assert got[30, 5000] == round(12 / 14, 3) and got[30, 23] == 0
