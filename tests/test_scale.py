"""Shares of tasks and repeated work as tables grow."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.catalog import joins
from ledgerlight.catalog.base import Tables
from ledgerlight.operators import lookup as L
from ledgerlight.operators import temporal as T
from ledgerlight.plans import features as P
from ledgerlight.plans import holdings as H
from ledgerlight.plans.iforest import Forest
from ledgerlight.sources import bucketed as B
from tests.test_stored import plan_of
from tests.test_temporal import TRADES, random_trades


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def same(one, other):
    return sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))


def test_stored_prices_have_more_buckets_on_larger_tables(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(B, "BUCKET_ROWS", 200)
    t = Tables(spark, sf_dir)
    assert joins._stored_prices(t)[1] == math.ceil(t.lineitem.count() / 200) > 16


def test_entities_days_are_dealt_to_the_asked_number_of_tasks(spark, monkeypatch):
    trades = spark.createDataFrame(random_trades(3), TRADES)
    dealt = T.peer_lookup(trades, "ticker", "person", "date", 7, tasks=37)
    assert "hashpartitioning(ticker" in plan_of(dealt) and ", 37)" in plan_of(dealt)
    assert same(dealt, T.peer_lookup(trades, "ticker", "person", "date", 7))
    monkeypatch.setattr(T, "TASK_ROWS", 10)
    assert T.tasks_for(spark.range(1000)) == 100


def test_lookups_are_worked_out_once(spark, monkeypatch):
    trades = spark.createDataFrame(random_trades(4), TRADES)
    plain = T.peer_cluster(trades, "ticker", "person", "date", 7)
    assert plan_of(plain).count("Window [") == 2
    monkeypatch.setattr(L, "HOT_ROWS", 5)
    assert same(plain, T.peer_cluster(trades, "ticker", "person", "date", 7))


def test_first_closes_are_not_repeated_for_every_day(spark, monkeypatch):
    prices = spark.createDataFrame([("A", day(n), float(n)) for n in range(5)], "ticker string, price_date date, close double")
    rows = [(i, "A", day(1000 + i)) for i in range(10)] + [(10, "A", None), (11, None, day(3)), (12, "B", day(3)), (13, "A", day(2))]
    trades = spark.createDataFrame(rows, "id int, ticker string, trade_date date")
    sent, join = [], T.spread_join

    def counted(left, lookup, *args, **kwargs):
        lists = [c for c, kind in lookup.dtypes if kind.startswith("array")]
        sent.append(lookup.agg(F.sum(F.size(F.coalesce(F.col(lists[0]), F.array())))).first()[0])
        return join(left, lookup, *args, **kwargs)

    monkeypatch.setattr(T, "spread_join", counted)
    got = {r["id"]: r["closes"] and len(r["closes"]) for r in T.price_window(trades, prices, days=1, fallback=4).collect()}
    assert got == {**{i: 4 for i in range(10)}, 10: None, 11: None, 12: None, 13: 3}
    assert sum(n or 0 for n in sent) == 3 + 4


def test_days_without_closes_send_nothing(spark, monkeypatch):
    prices = spark.createDataFrame([("A", day(n), float(n)) for n in range(5)] + [("A", None, 9.0), ("C", day(1), None)], "ticker string, price_date date, close double")
    rows = [(i, "A", day(1000 + i)) for i in range(10)] + [(10, "A", day(2)), (11, "A", day(2)), (12, "C", day(1))]
    trades = spark.createDataFrame(rows, "id int, ticker string, trade_date date")
    sent, join = [], T.spread_join

    def counted(left, lookup, *args, **kwargs):
        sent.append(lookup.count())
        return join(left, lookup, *args, **kwargs)

    monkeypatch.setattr(T, "spread_join", counted)
    got = {r["id"]: len(r["closes"]) for r in T.price_window(trades, prices, days=1, fallback=4).collect()}
    assert got == {**{i: 4 for i in range(10)}, 10: 3, 11: 3, 12: 0}
    assert sent == [1, 2]


def test_dossiers_move_trades_once_by_their_id(spark, sf_dir):
    from ledgerlight.catalog import QUERIES

    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {c: spark.conf.get(c) for c in names}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["j01_trade_dossiers"](spark, sf_dir))
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    # Trades, scores, reports and media: one exchange each; columns nobody asks for aren't read for the spread.
    assert plan.count("Exchange hashpartitioning(trade_id") == 4
    assert "amount_lower" not in plan and "feat_cohort_alpha" not in plan


def test_bills_are_put_into_words_once_per_day(spark, sf_dir, monkeypatch):
    from ledgerlight.plans import reports as R

    t, seen, join = Tables(spark, sf_dir), [], T.spread_join

    def noted(left, lookup, keys, *args, **kwargs):
        seen.append((left.columns, lookup.columns))
        return join(left, lookup, keys, *args, **kwargs)

    monkeypatch.setattr(T, "spread_join", noted)
    out = R.evidence_packets(t.scored, t.politicians, t.bills)
    [(left, lookup)] = seen
    assert "full_name" in left and "_section" in lookup
    assert out.columns == [*t.scored.columns, "sectors", "nearby_bills", *R.PERSON, "prompt"]
    lines = [len(r["nearby_bills"] or []) - r["prompt"].count("    Action Date: ") for r in out.where("trade_id like '1%'").collect()]
    assert lines and not any(lines)


def test_table_columns_are_found_once_per_table(spark):
    from ledgerlight.sources.disclosures import trades_from_tables

    header = ["#", "Transaction Date", "Owner", "Ticker", "Asset Name", "Asset Type", "Type", "Amount"]
    body = [["1", "01/02/2024", "Self", "aapl", "Apple", "Stock", "Purchase", "Over $5,000,000"], ["2"], ["", None, ""]]
    tables = spark.createDataFrame(
        [(1, [header, *body]), (2, [None, *body]), (3, [body[0], header, *body]), (4, [header])], "doc_id int, cells array<array<string>>"
    )
    filings = spark.createDataFrame([("1", "A B", "A", "B", "TX", "1/3/2024")], "doc_id string, full_name string, first_name string, last_name string, state_district string, filing_date string")
    out = trades_from_tables(tables, filings, "senate")
    assert [(r["doc_id"], r["position"], r["ticker"], r["trade_type"], str(r["trade_date"])) for r in out.collect()] == [("1", 0, "AAPL", "buy", "2024-01-02")]
    above = plan_of(out).split("posexplode")[0]
    assert "array_position" not in above


def test_quarters_are_compared_once(spark):
    rows = [("1", "C1", "SH", "5000", 8000), ("1", "C1", "SH", "100", 8001), ("2", "C2", "SH", "900", 8001), ("2", "C1", None, "x", 8002)]
    holdings = spark.createDataFrame(rows, "cik string, cusip string, share_type string, shares string, period int")
    tickers = spark.createDataFrame([("C1", "AAA"), ("C2", "BBB")], "cusip string, ticker string")
    found = H.infer_fund_trades(holdings, tickers, {})
    assert plan_of(found).count("FullOuter") == 1 and found.count() > 0


def test_inferred_trades_are_worked_out_once(spark):
    counter = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        counter.add(1)
        return x

    rows = [("1", "f", "A", day(20), "buy"), ("2", "g", "A", day(25), "sell")]
    inferred = spark.createDataFrame(rows, "cik string, fund_name string, ticker string, inferred_date date, trade_type string")
    prices = spark.createDataFrame([(t, day(n), 1.0 + n) for t in ("A", "SPY") for n in range(90)], "ticker string, price_date date, close double")
    out = P.baseline_features(inferred.withColumn("ticker", seen(F.col("ticker"))), prices)
    assert out.count() == 2 and counter.value == 2


def test_forest_walk_against_a_walk_of_single_rows():
    r = np.random.default_rng(3)
    feature, cut = r.integers(0, 3, (5, 7)).astype(np.int16), r.random((5, 7))
    cut[0, 3] = np.inf
    forest = Forest(["a", "b", "c"], feature, cut, r.random((5, 8)), 16)
    values = r.random((100, 3))
    values[7, 1] = np.nan

    def walk(row, tree):
        node = 0
        while node < 7:
            node = 2 * node + 1 + bool(row[feature[tree, node]] >= cut[tree, node])
        return forest.path[tree, node - 7]

    from ledgerlight.plans.iforest import average_path
    want = [2.0 ** (-sum(walk(row, t) for t in range(5)) / 5 / average_path(16)) for row in values]
    assert np.allclose(forest.scores(values), want) and np.array_equal(forest.scores(values), forest.scores(values, block=9))


def unbroadcast_plan(spark, build):
    """The plan of `build()` without adaptive execution and broadcasts of small tables."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {c: spark.conf.get(c) for c in names}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan_of(build())
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def dealings(plan):
    """Keys of the shuffles that deal trades or their answers to parts of a key."""
    return sorted(re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^()]*, _part#\d+L?), \d+\)", plan))


def test_trades_move_once_to_their_person_and_once_to_their_ticker(spark, sf_dir):
    from ledgerlight.catalog import QUERIES

    plan = unbroadcast_plan(spark, lambda: QUERIES["i07_features_v2"](spark, sf_dir))
    # The second one by person is the median's, of persons and days alone.
    assert dealings(plan) == ["politician_id, _part", "politician_id, _part", "ticker, _part"]


def brute_facts(trades, prices, width):
    """{id: (alpha, earlier alpha, peers)} of trades (id, ticker, person, date); day None closes are there before all others."""
    def close(ticker, d, ahead):
        days = [q for t, q in prices if t == ticker and (q >= d if ahead else q <= d)]
        return prices[(ticker, min(days) if ahead else max(days))] if days else None

    def excess(ticker, first, second, ahead):
        p = [close(t, d, ahead) for t in (ticker, "SPY") for d in (first, second)]
        return None if None in p else round((p[1] - p[0]) / p[0] - (p[3] - p[2]) / p[2], 9)

    out = {}
    for i, ticker, person, d in trades:
        if ticker is None or d is None:
            out[i] = (None, None, None)
            continue
        near = {p for _, t, p, e in trades if t == ticker and p is not None and e is not None and abs((e - d).days) <= width}
        out[i] = (excess(ticker, d, d + dt.timedelta(30), True), excess(ticker, d - dt.timedelta(7), d, False), len(near))
    return out


@pytest.mark.parametrize("most", [None, 5, 90])
@pytest.mark.parametrize("width", [0, 1, 7])
def test_ticker_facts_against_brute_force(spark, monkeypatch, most, width):
    """Crowded tickers, whole or in parts; trades without a ticker, person or day; days and persons that repeat."""
    if most:
        monkeypatch.setattr(L, "HOT_ROWS", most)
    trades = [(i, t, p, d) for i, t, p, d, _ in random_trades(21)]
    trades += [(i + 1000, t, p, d) for i, t, p, d in trades[:40]] + [(2000 + i, t, 3, None) for i, t in enumerate(["HOT", "A", None])] + [(2100, "ONLY", None, day(3))]
    r = random.Random(22)
    prices = {(t, day(n)): r.uniform(5, 50) for t in ("HOT", "A", "SPY", "Z") for n in r.sample(range(-10, 150), 50)}
    left = spark.createDataFrame(trades, "id int, ticker string, person int, trade_date date").repartition(3)
    right = spark.createDataFrame([(t, d, v) for (t, d), v in prices.items()] + [(t, d, v - 1) for (t, d), v in prices.items()] + [("A", day(0), None), (None, day(1), 4.0)], "ticker string, price_date date, close double")
    out = T.ticker_facts(left, right, "person", days=width)
    assert out.columns == [*left.columns, "cohort_alpha", "pre_trade_alpha", "peers"]
    got = [(x["id"], tuple(x[c] if x[c] is None or c == "peers" else round(x[c], 9) for c in out.columns[-3:])) for x in out.collect()]
    assert len(got) == len(trades) and dict(got) == brute_facts(trades, prices, width)


@pytest.mark.parametrize("most", [None, 5])
def test_entity_facts_against_brute_force(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(L, "HOT_ROWS", most)
    trades = [(i, p, d) for i, _, p, d, _ in random_trades(23)] + [(1000, 1, None), (1001, None, None), (1002, 9, day(2))]
    r = random.Random(24)
    votes = [(r.choice([1, 2, 3, 8]), day(r.randrange(-20, 140))) for _ in range(50)]
    left = spark.createDataFrame(trades, "id int, person int, date date").repartition(3)
    events = spark.createDataFrame(votes + votes[:9] + [(1, None), (None, day(4))], "person long, date date")
    facts = spark.createDataFrame([(1, "one", {"x": 1.0}), (9, None, {"y": 2.0}), (None, "none", None)], "person long, name string, weights map<string,double>")
    days = {(p, d): i for i, p, d in trades if i % 3 == 0 and p is not None and d is not None}
    matched = spark.createDataFrame([(p, d, i) for (p, d), i in days.items()], "person long, date date, mark int")
    out = T.entity_facts(left, events, "person", "date", 4, facts=facts, matched=matched)
    assert out.columns == ["id", "person", "date", "gap_days", "name", "weights", "mark"]
    got = {x["id"]: tuple(x)[3:] for x in out.collect()}
    assert len(got) == len(trades) == out.count()
    known = {1: ("one", {"x": 1.0}), 9: (None, {"y": 2.0})}
    for i, p, d in trades:
        gaps = [abs((v - d).days) for q, v in votes if q == p] if d else []
        least = min(gaps) if gaps and min(gaps) <= 4 else None
        assert got[i] == (least, *(known.get(p, (None, None)) if d else (None, None)), days.get((p, d)))


def test_trades_of_version_1_move_once_to_their_person_and_once_to_their_ticker(spark, sf_dir, monkeypatch):
    from ledgerlight.catalog import QUERIES

    stored = []
    monkeypatch.setattr(P, "_once", lambda df, name: stored.append(df) or df)

    def build():
        QUERIES["i07_features_v1"](spark, sf_dir)
        return stored[0]

    assert dealings(unbroadcast_plan(spark, build)) == ["politician_id, _part", "ticker, _part"]


def test_deep_trees_against_a_walk_of_single_rows(spark):
    """Levels compared as whole columns and levels looked up give what single rows give, in whatever batches they come."""
    from ledgerlight.plans.iforest import average_path, with_scores

    r = np.random.default_rng(4)
    feature, cut = r.integers(0, 2, (3, 127)).astype(np.int16), r.random((3, 127))
    cut[:, 1::9] = np.inf
    forest = Forest(["a", "b"], feature, cut, r.random((3, 128)), 64)
    values = r.random((500, 2))
    values[3], values[4, 0], values[5, 1], values[6, 0] = np.nan, np.nan, np.inf, -np.inf

    def walk(row, tree):
        node = 0
        while node < 127:
            node = 2 * node + 1 + bool(row[feature[tree, node]] >= cut[tree, node])
        return forest.path[tree, node - 127]

    want = [2.0 ** (-sum(walk(row, t) for t in range(3)) / 3 / average_path(64)) for row in values]
    assert np.allclose(forest.scores(values), want) and np.array_equal(forest.scores(values), forest.scores(values, block=33))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "id int, a double, b double").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {x["id"]: (x["s"], x["t"]) for x in with_scores(df, {"s": forest, "t": Forest(["b", "b"], feature, cut, forest.path, 64)}).collect()}
        alone = with_scores(df, {"t": Forest(["b", "b"], feature, cut, forest.path, 64)}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose([got[i][0] for i in range(500)], want) and {x["id"]: x["t"] for x in alone} == {i: t for i, (_, t) in got.items()}


def test_rows_drawn_for_no_tree_are_left_out_first(spark, monkeypatch):
    from ledgerlight.plans import iforest as IF

    df = spark.range(3000).select("id", (F.col("id") % 97).cast("double").alias("a"))
    drawn = IF.draw_samples(df, ["a"], "id", 3000, trees=3, subsample=8, seeds=[0, 1])
    assert "exists(" in plan_of(drawn)
    monkeypatch.setattr(IF, "MANY_DARTS", 0)
    plain = IF.draw_samples(df, ["a"], "id", 3000, trees=3, subsample=8, seeds=[0, 1])
    assert "exists(" not in plan_of(plain) and same(drawn, plain) and drawn.count() == 48


def test_all_seeds_walk_the_same_blocks(spark, monkeypatch):
    from ledgerlight.plans import iforest as IF

    df = spark.range(600).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 13).cast("double").alias("b"))
    plan = plan_of(IF.seed_stability(df, ["a", "b"], "id", 3, 5))
    assert len(set(re.findall(r"pythonUDF\d+", plan))) == 1


def test_securities_without_a_valid_ticker_are_left_out_before_the_comparison(spark, monkeypatch):
    """The quarters' bounds are those of all holdings of tracked funds, repeated tickers and funds count as before."""
    rows = [("1", "C1", "SH", "500", 8000), ("1", "C1", "SH", "900", 8001), ("1", "BAD", "SH", "900", 8002), ("01", "BAD", None, "900", 7999), ("1", None, "SH", "70", 8000),
            ("2", "C2", "SH", "900", 8001), ("9", "C2", "SH", "900", 8009), ("3", "C2", "SH", "300", None), ("1", "C2", "PRN", "900", 8001), ("2", "C3", "SH", "x", 8001)]
    holdings = spark.createDataFrame(rows, "cik string, cusip string, share_type string, shares string, period int")
    tickers = spark.createDataFrame([("C1", "AAA"), ("C2", "BBB"), ("C2", "BBB"), ("C3", "CCC"), ("BAD", "TOOLONG"), (None, "N")], "cusip string, ticker string")
    funds = spark.createDataFrame([("1", "One"), ("2", "Two"), ("2", "Two"), ("3", "Three")], "cik string, fund_name string")
    found = H.infer_fund_trades(holdings, tickers, funds)
    sold = found.where("cusip = 'C1' AND trade_type = 'sell'").select("shares_delta").collect()
    assert [r[0] for r in sold] == [900]  # 8002 is a quarter, by the holding without a valid ticker
    compared, changes = [], H.quarter_changes
    monkeypatch.setattr(H, "quarter_changes", lambda held, *args: compared.append(sorted({r["cusip"] for r in held.collect()}, key=str)) or changes(held, *args))
    assert same(found, H.infer_fund_trades(holdings, tickers, funds)) and compared == [["C1", "C2", "C3"]]
    monkeypatch.setattr(L, "FEW_KEYS", -1)
    assert same(found, H.infer_fund_trades(holdings, tickers, funds)) and compared[1] == ["BAD", "C1", "C2", "C3", None]


def test_closes_of_other_tickers_are_not_moved(spark, monkeypatch):
    rows = [("1", "f", "A", day(20), "buy"), ("2", "g", "A", day(25), "sell"), ("2", "g", None, day(25), "sell")]
    inferred = spark.createDataFrame(rows, "cik string, fund_name string, ticker string, inferred_date date, trade_type string")
    prices = spark.createDataFrame([(t, day(n), 1.0 + n) for t in ("A", "B", "C", "SPY") for n in range(90)], "ticker string, price_date date, close double")
    moved, gathered = [], T.gathered

    def counted(left, right, *args, **kwargs):
        moved.append(sorted(r["ticker"] for r in right.select("ticker").distinct().collect()))
        return gathered(left, right, *args, **kwargs)

    monkeypatch.setattr(T, "gathered", counted)
    out = P.baseline_features(inferred, prices)
    assert moved == [["A", "SPY"]]
    monkeypatch.setattr(L, "FEW_KEYS", 1)
    assert same(out, P.baseline_features(inferred, prices)) and moved[1] == ["A", "B", "C", "SPY"] and out.count() == 2


def test_features_are_dealt_to_tasks_by_rows(spark, sf_dir, monkeypatch):
    """However few shuffle partitions there are, more trades go to more tasks."""
    from ledgerlight.catalog import QUERIES

    monkeypatch.setattr(T, "TASK_ROWS", 200)
    tasks = math.ceil(Tables(spark, sf_dir).trades.count() / 200)
    plan = unbroadcast_plan(spark, lambda: QUERIES["i07_features_v2"](spark, sf_dir))
    assert len(re.findall(rf"_part#\d+L?, {tasks}\)", plan)) == 2 and tasks > 16
