"""Temporal operators against brute force, with and without hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import lookup as L
from ledgerlight.operators import temporal as T

DAY0 = dt.date(2024, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


@pytest.fixture(params=[None, 5], ids=["plain", "hot"])
def hot(request, monkeypatch):
    """With a threshold of five rows almost every key takes the hot path."""
    if request.param:
        monkeypatch.setattr(L, "HOT_ROWS", request.param)


def random_trades(seed, n=400):
    """A third of the trades sit on one ticker and one person; some keys are unknown."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        skewed = r.random() < 0.34
        ticker = "HOT" if skewed else r.choice(["A", "B", "C", None])
        person = 1 if skewed and r.random() < 0.7 else r.choice([1, 2, 3, 4, 5, None])
        out.append((i, ticker, person, day(r.randrange(0, 120)), r.sample(["x", "y", "z"], r.randrange(0, 3))))
    return out


TRADES = "id int, ticker string, person int, date date, sectors array<string>"


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("tolerance", [None, 4])
def test_asof(spark, hot, direction, tolerance):
    trades = random_trades(1)
    r = random.Random(2)
    prices = {(t, day(n)): float(n) + ord(t[0]) for t in ["HOT", "A", "B"] for n in r.sample(range(0, 130), 40)}
    df = spark.createDataFrame([(t, d, v) for (t, d), v in prices.items()], "ticker string, date date, close double")
    got = {x["id"]: x["close"] for x in T.asof_join(spark.createDataFrame(trades, TRADES), df, "ticker", "date", "close", direction, tolerance).collect()}
    assert len(got) == len(trades)
    for i, ticker, _, d, _ in trades:
        days = [q for t, q in prices if t == ticker and (q >= d if direction == "forward" else q <= d)]
        best = (min(days) if direction == "forward" else max(days)) if days else None
        if best is not None and tolerance is not None and abs((best - d).days) > tolerance:
            best = None
        assert got[i] == (prices[(ticker, best)] if best else None)


def test_nearest_event(spark, hot):
    trades = random_trades(3)
    r = random.Random(4)
    votes = [(r.choice([1, 2, 3, 9]), day(r.randrange(-20, 140))) for _ in range(60)]
    df = spark.createDataFrame(votes, "person int, date date")
    got = {x["id"]: x["gap_days"] for x in T.nearest_event(spark.createDataFrame(trades, TRADES), df, "person", "date", 5).collect()}
    for i, _, person, d, _ in trades:
        gaps = [abs((v - d).days) for p, v in votes if p == person]
        assert got[i] == (min(gaps) if gaps and min(gaps) <= 5 else None)


def test_nearest_category_and_two_tier(spark, hot):
    trades = random_trades(5)
    r = random.Random(6)
    events = [(r.choice([1, 2, 3]), r.choice(["x", "y", "w"]), day(r.randrange(0, 140))) for _ in range(50)]
    df = spark.createDataFrame(events, "person int, sector string, date date")
    left = spark.createDataFrame(trades, TRADES)
    near = {x["id"]: x["gap_days"] for x in T.nearest_category_event(left, df, "sectors", "sector", "date", 10).collect()}
    tiers = {x["id"]: x["gap_days"] for x in T.nearest_two_tier(left, df, "person", "sectors", "sector", "date", 10).collect()}
    for i, _, person, d, sectors in trades:
        gaps = [abs((e - d).days) for _, s, e in events if s in sectors]
        assert near[i] == (min(gaps) if gaps and min(gaps) <= 10 else None)
        own = [(s in sectors, abs((e - d).days)) for p, s, e in events if p == person]
        first = [g for match, g in own if match and g <= 10]
        second = [g for _, g in own if g <= 10]
        assert tiers[i] == (min(first) if first else min(second) if second else None)


@pytest.mark.parametrize("width", [0, 7, 30])
def test_peer_cluster(spark, hot, width):
    trades = random_trades(7)
    got = {x["id"]: x["cluster_score"] for x in T.peer_cluster(spark.createDataFrame(trades, TRADES), "ticker", "person", "date", width).collect()}
    for i, ticker, person, d, _ in trades:
        peers = {p for _, t, p, e, _ in trades if t == ticker and t and p is not None and p != person and abs((e - d).days) <= width}
        assert got[i] == (len(peers) if person is not None and ticker else 0)


def test_busy_days(spark):
    trades = random_trades(8)
    got = [tuple(x) for x in T.busy_days(spark.createDataFrame(trades, TRADES), "ticker", "person", "date", 7, 2, 50).collect()]
    want = {}
    for _, t, p, d, _ in trades:
        if t and p is not None and any(t == u and q is not None and q != p and abs((e - d).days) <= 7 for _, u, q, e, _ in trades):
            want.setdefault((t, d), set()).add(p)
    counted = sorted([(t, d, len(s)) for (t, d), s in want.items() if len(s) >= 2], key=lambda x: (-x[2], x[0], x[1]))
    assert got == counted[:50]


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_k(spark, k):
    trades = random_trades(9)
    r = random.Random(10)
    bills = [(f"b{i:03d}", r.choice(["x", "y", "w"]), day(r.randrange(0, 120)), f"t{i}") for i in range(80)]
    df = spark.createDataFrame(bills, "bill string, sector string, date date, title string")
    out = T.nearest_k(spark.createDataFrame(trades, TRADES), df, "sectors", "sector", "date", "bill", k, 6).collect()
    got = {x["id"]: [(b["gap_days"], b["bill"], b["title"]) for b in (x["nearby"] or [])] for x in out}
    for i, _, _, d, sectors in trades:
        near = sorted((abs((e - d).days), b, t) for b, s, e, t in bills if s in sectors and abs((e - d).days) <= 6)
        assert got[i] == near[:k]


def test_nearby_bills_order(spark):
    """Gaps 3, 5 and 45 days, in that order."""
    trade = spark.createDataFrame([(1, dt.date(2025, 6, 15), ["defense"])], "id int, date date, sectors array<string>")
    bills = spark.createDataFrame(
        [("a", "defense", dt.date(2025, 6, 20)), ("b", "defense", dt.date(2025, 6, 12)), ("c", "defense", dt.date(2025, 5, 1)), ("d", "tech", dt.date(2025, 6, 15))],
        "bill string, sector string, date date")
    [row] = T.nearest_k(trade, bills, "sectors", "sector", "date", "bill").collect()
    assert [(b["bill"], b["gap_days"]) for b in row["nearby"]] == [("b", 3), ("a", 5), ("c", 45)]


def test_price_window(spark, hot):
    trades = [(t[0], t[1], t[3]) for t in random_trades(11)]
    prices = {(t, day(n)): float(n) for t in ["HOT", "A", "B"] for n in range(30, 160, 9)}
    left = spark.createDataFrame(trades, "id int, ticker string, trade_date date")
    right = spark.createDataFrame([(t, d, v) for (t, d), v in prices.items()], "ticker string, price_date date, close double")
    got = {x["id"]: [(c["price_date"], c["close"]) for c in (x["closes"] or [])] for x in T.price_window(left, right, 12, 4).collect()}
    for i, ticker, d in trades:
        series = sorted((q, v) for (t, q), v in prices.items() if t == ticker)
        near = [(q, v) for q, v in series if abs((q - d).days) <= 12]
        assert got[i] == (near or series[:4])


def test_alphas(spark, hot):
    trades = [(t[0], t[1], t[3]) for t in random_trades(12)]
    r = random.Random(13)
    prices = {(t, day(n)): r.uniform(5, 50) for t in ["HOT", "A", "SPY"] for n in r.sample(range(-10, 150), 70)}
    left = spark.createDataFrame(trades, "id int, ticker string, trade_date date")
    right = spark.createDataFrame([(t, d, v) for (t, d), v in prices.items()], "ticker string, price_date date, close double")

    def price(ticker, d, ahead):
        days = [q for t, q in prices if t == ticker and (q >= d if ahead else q <= d)]
        return prices[(ticker, min(days) if ahead else max(days))] if days else None

    def excess(ticker, first, second, ahead):
        p0, p1, s0, s1 = price(ticker, first, ahead), price(ticker, second, ahead), price("SPY", first, ahead), price("SPY", second, ahead)
        return None if None in (p0, p1, s0, s1) else (p1 - p0) / p0 - (s1 - s0) / s0

    got = {x["id"]: x for x in T.add_alphas(left, right).collect()}
    for i, ticker, d in trades:
        for column, want in (("cohort_alpha", excess(ticker, d, d + dt.timedelta(30), True)), ("pre_trade_alpha", excess(ticker, d - dt.timedelta(7), d, False))):
            assert got[i][column] == (pytest.approx(want) if want is not None else None)


def test_spread_join_keeps_every_row(spark, monkeypatch):
    """Hot, cold, unmatched and NULL keys; hot rows are spread over partitions."""
    monkeypatch.setattr(L, "HOT_ROWS", 50)
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 1, None).otherwise(F.col("id") % 5).cast("int").alias("k"))
    values = spark.createDataFrame([(1, "hot"), (2, "two"), (3, None), (99, "never")], "k int, v string")
    out = L.enrich(left, values, ["k"])
    got = {r["id"]: r["v"] for r in out.collect()}
    keys = {r["id"]: r["k"] for r in left.collect()}
    assert len(got) == 1000 and out.count() == 1000
    assert all(got[i] == {1: "hot", 2: "two"}.get(keys[i]) for i in got)
