"""Isolation forest, scoring and holdings inference."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators.quantiles import exact_percentiles
from ledgerlight.plans import holdings as H
from ledgerlight.plans import iforest as IF
from ledgerlight.plans import models as MS
from ledgerlight.plans import scoring as SC
from tests.conftest import rows

FEATURES = ["a", "b", "c", "flat"]


def sample(spark, n=3000, outliers=30):
    r = np.random.default_rng(0)
    values = r.normal(size=(n, 3))
    values[:outliers] = r.normal(8, 1, size=(outliers, 3))
    data = [(i, *map(float, v), 7.0) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "id long, a double, b double, c double, flat double").repartition(4)


def test_average_path():
    assert [IF.average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert IF.average_path(256) == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_tree_shape_and_constant_feature(spark):
    nodes = IF.fit(sample(spark), FEATURES, "id", trees=20).toPandas()
    assert nodes.tree_id.nunique() == 20
    roots = nodes[nodes.node_id == 0]
    assert (roots["size"] == 256).all() and nodes.depth.max() <= 8
    inner = nodes[nodes.feature >= 0]
    assert FEATURES.index("flat") not in set(inner.feature)
    leaves = nodes[nodes.feature < 0].groupby("tree_id")["size"].sum()
    assert (leaves == 256).all()


def path_length(nodes, row):
    """Walk of one tree, node by node."""
    table, node = nodes.set_index("node_id"), 0
    while table.loc[node, "feature"] >= 0:
        left = row[int(table.loc[node, "feature"])] < table.loc[node, "cut"]
        node = int(table.loc[node, "left" if left else "right"])
    return table.loc[node, "depth"] + IF.average_path(table.loc[node, "size"])


def test_scores_match_plain_walk_and_find_outliers(spark):
    df = sample(spark)
    nodes = IF.fit(df, FEATURES, "id", trees=40).cache()
    forest = IF.Forest.from_nodes(nodes, FEATURES)
    scored = df.withColumn("s", forest.score_column()).toPandas().sort_values("id")
    table = nodes.toPandas()
    for row in scored.head(5).itertuples():
        mean = np.mean([path_length(g, (row.a, row.b, row.c, row.flat)) for _, g in table.groupby("tree_id")])
        assert row.s == pytest.approx(2 ** (-mean / IF.average_path(256)))
    assert scored.s[:30].min() > scored.s[30:].median() + 0.1
    assert set(scored.sort_values("s", ascending=False).head(30).id) == set(range(30))


def test_model_does_not_depend_on_partitioning(spark):
    df = sample(spark, 1500, 5)
    first = IF.fit(df.repartition(1), FEATURES, "id", trees=10).orderBy("tree_id", "node_id").collect()
    second = IF.fit(df.repartition(7, "b"), FEATURES, "id", trees=10).orderBy("tree_id", "node_id").collect()
    assert [r[:3] + r[4:] for r in first] == [r[:3] + r[4:] for r in second]


def test_small_and_pooled_sampling(spark, monkeypatch):
    df = sample(spark, 60, 2)
    nodes = IF.fit(df, FEATURES, "id", trees=5).toPandas()
    assert (nodes[nodes.node_id == 0]["size"] == 60).all()
    big = sample(spark, 4000, 2)
    drawn = IF.draw_samples(big, FEATURES, "id", 4000, trees=5, subsample=64)
    per_tree = drawn.groupBy("tree_id").agg(F.count("*").alias("n"), F.count_distinct("draw").alias("d")).collect()
    assert [(r["n"], r["d"]) for r in per_tree] == [(64, 64)] * 5


def test_stability_and_dual_scoring(spark):
    df = sample(spark)
    assert IF.seed_stability(df, FEATURES, "id", 3, 40).collect()[0][0] >= 0.85
    forest = IF.Forest.from_nodes(IF.fit(df, FEATURES, "id", trees=50), FEATURES)
    feats = df.select(F.col("id").alias("trade_id"), F.col("a").alias("cohort_alpha"), "*")
    forest.features = FEATURES
    out = SC.dual_score(feats, forest, forest, SC.model_version("2026-01-01T0", "2026-02-01T0"), "2026-02-02 00:00:00")
    r = out.where("trade_id = 3").collect()[0]
    assert r["model_version"] == "v2_cohort_2026-01-01_baseline_2026-02-01"
    assert r["cohort_index"] == r["baseline_index"] >= 60 and r["severity_quadrant"] == "SEVERE" and r["cohort_label"] == -1
    checks = SC.model_checks(out).collect()[0]
    assert checks["outlier_rate_ok"] and checks["mean_gap_ok"]


def test_baseline_ignores_constant_features(spark):
    """Features that are constant in training never change a score."""
    df = sample(spark)
    forest = IF.Forest.from_nodes(IF.fit(df, FEATURES, "id", trees=30), FEATURES)
    a, b = np.array([[0.1, 0.2, 0.3, 7.0]]), np.array([[0.1, 0.2, 0.3, -100.0]])
    assert forest.scores(a) == forest.scores(b)


def test_stored_models(spark, tmp_path):
    """Scores of a loaded model are those of the trained one; versions, features and broken trainings are checked."""
    df = sample(spark)
    store = MS.ModelStore(spark, str(tmp_path / "models"))
    with pytest.raises(FileNotFoundError):
        store.load("m", "v1")
    trained = store.train("m", "v1", df, FEATURES, "id", "2026-01-01")
    loaded = store.load("m", "v1", FEATURES)
    values = np.random.default_rng(3).normal(size=(50, 4))
    assert (trained.scores(values) == loaded.scores(values)).all()
    direct = IF.Forest.from_nodes(IF.fit(df, FEATURES, "id"), FEATURES)
    assert (direct.scores(values) == loaded.scores(values)).all()
    with pytest.raises(FileExistsError):
        store.train("m", "v1", df.limit(10), FEATURES, "id")
    for wrong in (FEATURES[::-1], FEATURES[:3], [*FEATURES, "more"]):
        with pytest.raises(ValueError):
            store.load("m", "v1", wrong)
    card = store.card("m", "v1").first()
    raw = 0.5 - direct.scores(np.array(df.select(*FEATURES).collect(), float))
    assert card["n_training_samples"] == 3000 and card["trained_at"] == "2026-01-01" and card["score_mean"] == round(raw.mean(), 4)
    assert card["outlier_pct"] == round((raw < 0).mean() * 100, 2)
    df.sparkSession.createDataFrame([(0,)], "tree_id int").write.parquet(str(tmp_path / "models" / "m" / "v2" / "nodes"))  # broken off
    store.train("m", "v2", df, FEATURES, "id")
    both = IF.with_scores(df, {"one": loaded, "two": store.load("m", "v2")}).where("one <> two").count()
    assert both == 0


def test_numbered_and_donors(spark):
    df = spark.range(1000).select("id", (F.col("id") * 3).alias("a"), F.lit("x").alias("_at2")).repartition(6)
    got = rows(MS.numbered(df, [F.desc("id")], "place").select("id", "place"))
    assert got == sorted(((i, 999 - i) for i in range(1000)), key=repr)
    donors = MS.with_donors(df, ["a"], "id").collect()
    given = {r["id"]: r["donor_a"] for r in donors}
    assert sorted(given.values()) == [3 * i for i in range(1000)] and sum(v == 3 * k for k, v in given.items()) < 12
    again = {r["id"]: r["donor_a"] for r in MS.with_donors(df.repartition(2), ["a"], "id").collect()}
    assert again == given
    assert MS.with_donors(df.limit(0), ["a"], "id").count() == 0


def test_inert_features_and_probes(spark):
    """Features that were constant in training move no index, the others do; an extreme probe is flagged, an ordinary one isn't."""
    df = sample(spark, 4000, 40)
    forest = IF.Forest.from_nodes(IF.fit(df, FEATURES, "id"), FEATURES)
    varied = df.withColumn("flat", F.rand(3) * 100)
    found = {r["feature"]: r for r in MS.feature_inertness(varied, forest, "id").collect()}
    assert found["flat"]["inert"] and found["flat"]["max_shift"] == 0
    assert all(not found[f]["inert"] and found[f]["mean_shift"] > 0.5 for f in "abc")
    table = varied.toPandas().set_index("id")
    given = MS.with_donors(varied.select("id", *FEATURES), FEATURES, "id").toPandas().set_index("id").loc[table.index]
    index = lambda v: np.floor((-np.clip(0.5 - forest.scores(v), -0.5, 0.5) + 0.5) * 100)
    base, moved = table[FEATURES].to_numpy(float), table[FEATURES].copy()
    moved["b"] = given["donor_b"]
    assert found["b"]["mean_shift"] == pytest.approx(np.abs(index(moved.to_numpy(float)) - index(base)).mean(), abs=1e-4)
    assert {r["probe"]: r["ok"] for r in MS.probes(df, forest).collect()} == {"extreme": True, "ordinary": True}


def test_funds_as_a_table(spark):
    """A table of funds gives what the same list gives, however long it is."""
    data = [(str(c), f"S{s}", str(100 * ((c * 7 + s * 3 + p) % 9)), p, "SH" if s else "PRN") for c in range(30) for s in range(4) for p in (8096, 8097, 8098)]
    held = spark.createDataFrame(data, "cik string, cusip string, shares string, period int, share_type string")
    names = spark.createDataFrame([(f"S{s}", "ABCD"[s] * 2) for s in range(4)], "cusip string, ticker string")
    funds = {str(c): f"Fund {c}" for c in range(3, 30)}
    table = spark.createDataFrame(list(funds.items()) + [("777", "absent")], "cik string, fund_name string")
    listed = rows(H.infer_fund_trades(held, names, funds))
    assert rows(H.infer_fund_trades(held, names, table)) == listed and len(listed) > 50
    zero = spark.createDataFrame([("0", "Zero"), ("0005", "Five")], "cik string, fund_name string")
    assert {(r["cik"], r["fund_name"]) for r in H.infer_fund_trades(held, names, zero).collect()} == {("0", "Zero"), ("5", "Five")}


def test_holdings_inference(spark):
    data = [("1", "X", "100", 8096), ("1", "X", "300", 8097), ("1", "Y", "500", 8096), ("1", "Z", "50", 8097), ("1", "X", "bad", 8098), ("9", "X", "900", 8097)]
    held = spark.createDataFrame([(c, s, n, p, "SH", s.lower()) for c, s, n, p in data], "cik string, cusip string, shares string, period int, share_type string, issuer_name string")
    names = spark.createDataFrame([("X", "XX"), ("Y", "YY"), ("Z", "ZZ")], "cusip string, ticker string")
    got = rows(H.infer_fund_trades(held, names, {"1": "One"}).select("cusip", "trade_type", "shares_delta", F.col("inferred_date").cast("string")))
    assert got == [("X", "buy", 200, "2023-12-31"), ("X", "sell", 300, "2024-03-31"), ("Y", "sell", 500, "2023-12-31")]
    moves = rows(H.infer_security_trades(held).select("cusip", "trade_direction", "from_period", "to_period", "share_change"))
    assert ("Y", "exit_position", "2023Q4", "2024Q1", -500.0) in moves and ("X", "increase", "2023Q4", "2024Q1", 1100.0) in moves
    assert ("Z", "exit_position", "2024Q1", "2024Q2", -50.0) in moves


def test_exact_percentiles(spark):
    r = np.random.default_rng(1)
    values = np.concatenate([r.normal(size=2000), np.full(1500, 0.25), r.exponential(size=501)])
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("one", 3.0), ("two", 1.0), ("two", 2.0)], "k string, v double")
    got = {(x["k"], x["q"]): x["v"] for x in exact_percentiles(df, "k", "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert got[("k", q)] == pytest.approx(np.quantile(values, q))
        assert got[("one", q)] == 3.0
    assert got[("two", 0.5)] == 1.5


def test_retrain_triggers(spark):
    import datetime as dt

    data = [(dt.date(2024, 1, 1) + dt.timedelta(days=d), -1 if (d < 8 and i < 3) else 1) for d in range(10) for i in range(10)]
    df = spark.createDataFrame(data, "trade_date date, cohort_label int")
    assert [r["trade_date"].day for r in SC.retrain_triggers(df).orderBy("trade_date").collect()] == [7, 8]
