"""Tables in buckets of their key, quantiles of many keys, records without a schema."""

import json
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import temporal as T
from ledgerlight.operators.quantiles import grouped_percentiles
from ledgerlight.sources import bucketed as B
from ledgerlight.sources import documents as D
from tests.test_temporal import TRADES, day, random_trades


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    prices = [(t, day(n), float(n) + ord(t[0])) for t in ["HOT", "A", "B"] for n in r.sample(range(0, 130), 40)]
    plain = spark.createDataFrame(prices, "ticker string, price_date date, close double")
    name = B.store(plain, f"prices_{uuid.uuid4().hex}", ["ticker"], ["price_date"], 3)
    return spark.createDataFrame(random_trades(6), TRADES), plain, spark.table(name), B.buckets_of(spark, name)


def above_scan(plan: str, table: str) -> list[str]:
    """Operators between the root of a plan and the scan of `table`, nearest last, one list over all its scans."""
    path, found = [], []
    for line in plan.splitlines():
        text = line.lstrip(" :+-")
        depth = len(line) - len(text)
        path = [p for p in path if p[0] < depth] + [(depth, text)]
        if text.startswith("FileScan") and table in text:
            found += [t for _, t in path]
    return found


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_asof_leaves_stored_prices_where_they_are(spark, tables):
    trades, plain, stored, buckets = tables
    for direction in ("forward", "backward"):
        want = T.asof_join(trades, plain.withColumnRenamed("price_date", "date"), "ticker", "date", "close", direction, 20)
        got = T.asof_join(trades, stored.withColumnRenamed("price_date", "date"), "ticker", "date", "close", direction, 20, buckets=buckets)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    lookup = T.asof_lookup(trades, stored.withColumnRenamed("price_date", "date"), "ticker", "date", "close", buckets=buckets)
    above = above_scan(plan_of(lookup), "prices_")
    assert above and not [t for t in above if "Exchange" in t]
    shuffled = T.asof_lookup(trades, stored.withColumnRenamed("price_date", "date"), "ticker", "date", "close")
    assert [t for t in above_scan(plan_of(shuffled), "prices_") if "Exchange" in t]


def test_price_windows_of_stored_prices(spark, tables):
    trades, plain, stored, buckets = tables
    trades = trades.withColumnRenamed("date", "trade_date")
    want = T.price_window(trades, plain, days=2, fallback=3)
    got = T.price_window(trades, stored, days=2, fallback=3, buckets=buckets)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_tables_without_buckets(spark, tables):
    name = B.scratch_name("plain")
    tables[1].write.saveAsTable(name)
    with pytest.raises(ValueError, match="not stored in buckets"):
        B.buckets_of(spark, name)
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("partitions", [1, 7])
def test_grouped_percentiles(spark, partitions):
    r = random.Random(7)
    rows = [("hot", r.randrange(3), float(r.randrange(40))) for _ in range(600)]
    rows += [(k, None, float(r.randrange(5))) for k in "abcdefghij" for _ in range(r.randrange(1, 8))]
    rows += [(None, 1, 3.0), (None, 1, 4.0), ("empty", 1, None), ("one", 1, -2.5)]
    df = spark.createDataFrame(rows, "k string, part int, v double").repartition(partitions)
    shares = {"least": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "most": 1.0}
    got = {(x["k"], x["part"]): x for x in grouped_percentiles(df, ["k", "part"], "v", shares).collect()}
    groups = {}
    for k, part, v in rows:
        if v is not None:
            groups.setdefault((k, part), []).append(v)
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key]["n"] == len(values)
        for name, share in shares.items():
            assert got[key][name] == pytest.approx(float(np.quantile(values, share)))


def test_grouped_percentiles_in_many_ranges_without_broadcast(spark):
    """One key's values lie in many ranges; no table is broadcast."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")
    before = {c: spark.conf.get(c) for c in names}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(5000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
        out = grouped_percentiles(df, ["k"], "v", {"mid": 0.5})
        assert "Broadcast" not in plan_of(out)
        got = {x["k"]: x["mid"] for x in out.collect()}
        hot = [i * 7919 % 5000 for i in range(5000) if i % 10]
        assert got["hot"] == float(np.median(hot)) and len(got) == 501
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def test_grouped_percentiles_of_an_empty_table(spark):
    assert grouped_percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"mid": 0.5}).collect() == []


def test_bills_without_a_schema(spark, tmp_path):
    listed = [
        {"type": "HR", "number": "1", "congress": 119, "title": "One", "latestAction": {"text": "listed", "actionDate": "2025-01-01"}, "fresh": {"deep": [1, 2]}},
        {"type": "S", "number": 2, "congress": "119", "title": "Two", "latestAction": {"text": "listed"}, "n": "many", "fresh": 5},
        {"title": "nothing known", "n": 3},
    ]
    details = [
        {"type": "HR", "number": "1", "congress": 119, "policyArea": {"name": "Health"}, "latestAction": {"text": "detail"}, "sponsors": [{"bioguideId": "B1"}], "n": 4},
        {"type": "HR", "number": "1", "congress": 119, "policyArea": {"name": "Health"}, "latestAction": {"text": "detail"}, "sponsors": [{"bioguideId": "B1"}], "n": 4},
        {"type": "s", "number": "2", "congress": 119, "latestAction": {"text": ""}, "sponsors": []},
        {"policyArea": "not a record"},
    ]
    for name, records in (("listed", listed), ("details", details)):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, records)))
    out = D.flatten_bill_records(
        D.read_variant(spark, str(tmp_path / "listed.json")), D.read_variant(spark, str(tmp_path / "details.json")),
        {"n": ("$.n", "long"), "deep": ("$.fresh.deep[1]", "int")},
    )
    got = {r["title"]: r for r in out.collect()}
    assert len(got) == 3
    one, two, bare = got["One"], got["Two"], got["nothing known"]
    assert (one["id"], one["bill_number"], one["policy_area"], one["related_sector"]) == ("hr1-119", "HR1", "Health", "healthcare")
    assert (one["latest_action"], one["latest_action_date"], one["sponsor_bioguide"], one["n"], one["deep"]) == ("detail", "2025-01-01", "B1", 4, 2)
    assert (two["id"], two["latest_action"], two["sponsor_bioguide"], two["n"], two["deep"]) == ("s2-119", "listed", None, None, None)
    assert (bare["id"], bare["n"], bare["policy_area"]) == (None, 3, None)


def test_variant_records_keep_unknown_fields(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"a": 1, "later": {"x": "y"}}\n{"a": "word"}\n')
    records = D.read_variant(spark, str(tmp_path / "r.json"))
    path = str(tmp_path / "stored")
    records.write.parquet(path)
    read = spark.read.parquet(path).select(D.variant_field("record", "$.a", "int").alias("a"), D.variant_field("record", "$.later.x").alias("x"))
    assert sorted(map(tuple, read.collect()), key=repr) == [(1, "y"), (None, None)]
