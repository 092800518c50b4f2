"""Name resolution, dictionaries, merging, cleaning."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlight.operators import clean as C
from ledgerlight.operators import entity as E
from ledgerlight.operators import merge as M
from ledgerlight.operators import quality as Q
from tests.conftest import rows

PEOPLE = [
    (1, "B1", "Smith, Ann Marie"), (2, "B2", "Smith, Bob"), (3, "B3", "Jones, Carl"), (4, "T000278", "Tuberville, Tommy"), (5, "B5", "Doe, Jane"),
]


def people(spark):
    return spark.createDataFrame(PEOPLE, "id int, bioguide_id string, full_name string")


def test_resolve_load(spark):
    trades = spark.createDataFrame([
        (1, "Smith, Ann Marie", None), (2, "Ann Marie Smith", None), (3, "B3", None), (4, "Nobody", "SMITH"), (5, "Nobody", None),
        (6, None, "Jones"), (7, " Jones, Carl ", None), (8, "carl jones", None),
    ], "id int, politician_id string, last_name string")
    got = {r["id"]: r["resolved_id"] for r in E.resolve_entity(trades, people(spark)).collect()}
    # A shared last name goes to the last person; a missing name stays unresolved.
    assert got == {1: 1, 2: 1, 3: 3, 4: 2, 5: None, 6: None, 7: 3, 8: None}


def test_resolve_strict(spark):
    names = [
        ("smith, ann marie", 1), ("Ann Smith", 1), ("ANN MARIE SMITH", 1), ("Carl Q. Jones", 3), ("Carl Jones Jr.", 3),
        ("Mrs Jane Doe", 5), ("X Jones,", 3), ("Zed Smith", None), ("thomas h tuberville", 4), ("Dr", None), (None, None), ("Jane Mrs Doe", 5),
    ]
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(names)], "i int, politician_id string")
    got = {r["i"]: r["resolved_id"] for r in E.resolve_entity(df, people(spark), "strict").collect()}
    assert got == {i: want for i, (_, want) in enumerate(names)}


def test_vote_sector_propagation(spark):
    bills = spark.createDataFrame([("hr1-119", "healthcare"), ("s1-119", "energy")], "bill_id string, related_sector string")
    votes = spark.createDataFrame([(1, "HR1-119", None), (2, "s1-119", "old"), (3, "hr999-119", "old")], "id int, bill_id string, related_sector string")
    got = rows(M.propagate(votes, bills, "bill_id", "related_sector").select("id", "related_sector"))
    assert got == [(1, "healthcare"), (2, "energy"), (3, None)]


def test_backfill_never_overwrites(spark):
    bills = spark.createDataFrame([("hr1", "Health", "u1"), ("hr2", None, None), ("s1", "Energy", None), ("x", None, "u4")], "id string, policy_area string, url string")
    new = spark.createDataFrame([("hr1", "Taxation", "n1"), ("hr2", "Taxation", "n2"), ("s1", "Taxation", "n3")], "id string, policy_area string, url string")
    got = rows(M.backfill(bills, new, "id", ["policy_area", "url"]))
    assert got == [("hr1", "Health", "u1", False), ("hr2", "Taxation", "n2", True), ("s1", "Energy", "n3", True), ("x", None, "u4", False)]


def test_publication_merge(spark):
    bills = spark.createDataFrame([("hr1-119",), ("hr2-119",)], "bill_id string")
    pubs = spark.createDataFrame([("hr1-119", "BILLS-119hr1ih", "2025-01-01"), ("hr1-119", "BILLS-119hr1eh", "2025-02-01"), (None, "X", "2025-03-01")], "bill_id string, package_id string, modified string")
    assert rows(M.latest_metadata(bills, pubs, "bill_id", "modified", ["package_id"])) == [("hr1-119", "BILLS-119hr1eh"), ("hr2-119", None)]


def test_upsert_insert_ignore_and_maps(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert rows(M.upsert_rows(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(M.insert_ignore(old, new, ["k"])) == [(3, "C")]
    assert rows(M.merge_maps([new, old], ["k"])) == [(1, "a"), (2, "B"), (3, "C")]


def test_clean_trades(spark):
    d = dt.date(2024, 1, 1)
    base = [("p", "AAPL", d, "buy", d, 5, 1), ("p", "AAPL", d, "buy", d, 5, 2), ("p", "aapl", d, "buy", d, 5, 3), ("p", "TOOLONG", d, "buy", d, 5, 4),
            ("p", "T", None, "buy", d, 5, 5), ("p", "T", d, "buy", None, 5, 6), ("p", "T", d, "gift", d, 5, 7), ("p", "T", d, "sell", d, 366, 8), ("p", "T", d, "sell", d, 365, 9)]
    df = spark.createDataFrame(base, "politician_id string, ticker string, trade_date date, trade_type string, disclosure_date date, disclosure_lag_days int, n int")
    assert rows(C.clean_trades(df).select("n")) == [(1,), (9,)]


def test_keep_first_cuts_copies_before_the_shuffle(spark):
    df = spark.range(10000).select((F.col("id") % 2).alias("k"), F.lit(1).alias("v"))
    out = M.keep_first(df, ["k"], ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert out.count() == 2


def test_merge_chambers_keeps_missing_tickers(spark):
    house = spark.createDataFrame([("Ann", "CS", "d1"), ("Ann", None, "d2"), ("Ann", "GE", "")], "politician_name string, ticker string, doc_id string")
    senate = spark.createDataFrame([("Bob", "GE")], "politician_name string, ticker string")
    sectors = spark.createDataFrame([("GE", '["defense", "energy"]')], "ticker string, sector string")
    got = C.merge_chambers([house, senate], sectors).select("politician_id", "ticker", "industry_sector", "source_url")
    assert rows(got) == [("Ann", "GE", '["defense", "energy"]', ""), ("Ann", None, None, "https://disclosures-clerk.house.gov/public_disc/ptr-pdfs/d2.pdf"), ("Bob", "GE", '["defense", "energy"]', "")]


def test_not_in_ignores_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (None,)], "k int")
    assert rows(Q.uncovered(left, "k", right)) == [(2,)]


def test_quality_gate_verdicts(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "a int, b string")
    got = {r["column"]: (r["rows_verdict"], r["nulls_verdict"]) for r in Q.quality_gate(df, "t", [("a", 0.5, 2), ("b", 0.5, 10)], strict=True).collect()}
    assert got == {"a": ("ok", "ok"), "b": ("fail", "fail")}
