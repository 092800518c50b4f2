"""Features, holdings inference and models (I)."""

import re

from pyspark.sql import functions as F

from ledgerlight.catalog.base import Tables, letters, query, trade_key
from ledgerlight.functions.vocab import FEATURES_V2
from ledgerlight.plans import holdings as H


def holdings(t: Tables):
    """Lineitem quantities as quarterly holdings."""
    shipped = F.to_date("l_shipdate")
    return t.lineitem.select(
        F.col("l_suppkey").cast("string").alias("cik"), F.concat(F.lit("C"), F.col("l_partkey")).alias("cusip"),
        F.when(F.col("l_linenumber") == 7, "PRN").otherwise("SH").alias("share_type"),
        (F.col("l_quantity") * 100).cast("string").alias("shares"),
        H.period_of(F.year(shipped), F.quarter(shipped)).alias("period"),
        letters(F.col("l_partkey")).alias("issuer_name"),
    )


ALPHA_SQL = """
, k AS (SELECT ticker, trade_date, trade_date + 30 AS ahead, trade_date - 7 AS behind, 'SPY' AS spy FROM (SELECT DISTINCT ticker, trade_date FROM trades)),
a1 AS (SELECT k.*, p.close AS f0 FROM k ASOF LEFT JOIN prices p ON k.ticker = p.ticker AND k.trade_date <= p.price_date),
a2 AS (SELECT k.*, p.close AS f1 FROM a1 k ASOF LEFT JOIN prices p ON k.ticker = p.ticker AND k.ahead <= p.price_date),
a3 AS (SELECT k.*, p.close AS b1 FROM a2 k ASOF LEFT JOIN prices p ON k.ticker = p.ticker AND k.trade_date >= p.price_date),
a4 AS (SELECT k.*, p.close AS b0 FROM a3 k ASOF LEFT JOIN prices p ON k.ticker = p.ticker AND k.behind >= p.price_date),
a5 AS (SELECT k.*, p.close AS sf0 FROM a4 k ASOF LEFT JOIN prices p ON k.spy = p.ticker AND k.trade_date <= p.price_date),
a6 AS (SELECT k.*, p.close AS sf1 FROM a5 k ASOF LEFT JOIN prices p ON k.spy = p.ticker AND k.ahead <= p.price_date),
a7 AS (SELECT k.*, p.close AS sb1 FROM a6 k ASOF LEFT JOIN prices p ON k.spy = p.ticker AND k.trade_date >= p.price_date),
a8 AS (SELECT k.*, p.close AS sb0 FROM a7 k ASOF LEFT JOIN prices p ON k.spy = p.ticker AND k.behind >= p.price_date),
alphas AS (SELECT ticker, trade_date, CASE WHEN f0 <> 0 AND sf0 <> 0 THEN (f1 - f0) / f0 - (sf1 - sf0) / sf0 END AS cohort_alpha,
  CASE WHEN b0 <> 0 AND sb0 <> 0 THEN (b1 - b0) / b0 - (sb1 - sb0) / sb0 END AS pre_trade_alpha FROM a8)
"""

GAPS_SQL = """
, vote_days AS (SELECT DISTINCT o_custkey AS politician_id, CAST(o_orderdate AS DATE) AS d FROM orders),
pairs AS (SELECT DISTINCT politician_id, trade_date FROM trades),
vote_gap AS (SELECT p.politician_id, p.trade_date, min(abs(v.d - p.trade_date)) AS gap FROM pairs p JOIN vote_days v ON v.politician_id = p.politician_id AND abs(v.d - p.trade_date) <= 90 GROUP BY 1, 2),
bill_days AS (SELECT DISTINCT sector, latest_action_date AS d FROM bills WHERE sector IS NOT NULL),
sector_days AS (SELECT DISTINCT unnest(sectors) AS sector, trade_date FROM trades),
sector_gap AS (SELECT s.sector, s.trade_date, min(abs(b.d - s.trade_date)) AS gap FROM sector_days s JOIN bill_days b ON b.sector = s.sector AND abs(b.d - s.trade_date) <= 180 GROUP BY 1, 2),
ex AS (SELECT trade_id, politician_id, trade_date, unnest(sectors) AS sector FROM trades),
bill_gap AS (SELECT trade_id, min(gap) AS gap FROM ex JOIN sector_gap USING (sector, trade_date) GROUP BY 1),
rel AS (SELECT trade_id, max(weight) AS w FROM ex JOIN access USING (politician_id, sector) GROUP BY 1),
stats AS (SELECT politician_id, avg(ln(amount_midpoint + 1)) AS m, stddev_pop(ln(amount_midpoint + 1)) AS sd FROM trades GROUP BY 1 HAVING count(*) >= 5),
clusters AS (SELECT a.trade_id, count(DISTINCT b.politician_id) AS n FROM trades a JOIN trades b ON a.ticker = b.ticker AND a.politician_id <> b.politician_id AND abs(a.trade_date - b.trade_date) <= 7 GROUP BY 1),
raw AS (SELECT t.trade_id, t.politician_id, t.ticker, t.trade_date, v.gap AS vote_days, b.gap AS bill_days, round(coalesce(rel.w, 0), 2) AS committee_relevance,
   CASE WHEN sd > 0 THEN (ln(amount_midpoint + 1) - m) / sd ELSE 0 END AS amount_zscore, CAST(coalesce(c.n, 0) AS INT) AS cluster_score, t.disclosure_lag_days
  FROM trades t LEFT JOIN vote_gap v USING (politician_id, trade_date) LEFT JOIN bill_gap b USING (trade_id) LEFT JOIN rel USING (trade_id) LEFT JOIN stats USING (politician_id) LEFT JOIN clusters c USING (trade_id)),
features AS (SELECT *, CAST(coalesce(vote_days, floor((SELECT median(vote_days) FROM raw)), 7) AS INT) AS proximity_days, CASE WHEN vote_days IS NULL THEN 0 ELSE 1 END AS has_proximity_data,
  CAST(coalesce(bill_days, floor((SELECT median(bill_days) FROM raw)), 90) AS INT) AS bill_proximity, ln(1 + disclosure_lag_days) AS disclosure_lag FROM raw)
"""


def votes(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("politician_id"), F.to_date("o_orderdate").alias("vote_date"))


def seats(t: Tables):
    from ledgerlight.operators.entity import seats as join_seats

    return join_seats(t.memberships, t.committees)


def features(t: Tables):
    from ledgerlight.operators.temporal import tasks_for
    from ledgerlight.plans.features import cohort_features

    return cohort_features(t.trades, t.prices, votes(t), t.bills, seats(t), tasks=tasks_for(t.trades))


@query("i01_alphas", ALPHA_SQL + """
SELECT trade_id, round(cohort_alpha, 6) AS cohort_alpha, round(coalesce(pre_trade_alpha, 0), 6) AS pre_trade_alpha FROM trades JOIN alphas USING (ticker, trade_date)
""")
def i01(t: Tables):
    from ledgerlight.operators.temporal import add_alphas

    out = add_alphas(t.trades.select("trade_id", "ticker", "trade_date"), t.prices)
    return out.select("trade_id", F.round("cohort_alpha", 6).alias("cohort_alpha"), F.round(F.coalesce("pre_trade_alpha", F.lit(0.0)), 6).alias("pre_trade_alpha"))


@query("i01_alpha_calibration", ALPHA_SQL + """
SELECT CASE WHEN abs(cohort_alpha) < 0.05 THEN '<5%' WHEN abs(cohort_alpha) < 0.10 THEN '5-10%' WHEN abs(cohort_alpha) < 0.20 THEN '10-20%' WHEN abs(cohort_alpha) < 0.50 THEN '20-50%' ELSE '>50%' END AS abs_alpha_bucket,
  count(*) AS trades, round(avg(cohort_index), 1) AS avg_cohort, round(avg(baseline_index), 1) AS avg_baseline, count(*) FILTER (severity_quadrant IN ('SEVERE', 'SYSTEMIC')) AS flagged
FROM scored JOIN alphas USING (ticker, trade_date) WHERE cohort_alpha IS NOT NULL GROUP BY 1
""")
def i01c(t: Tables):
    """Flagship: as-of excess returns of every trade, bucketed against the scores."""
    from ledgerlight.operators.analytics import calibration
    from ledgerlight.operators.clean import scoreable
    from ledgerlight.operators.temporal import add_alphas

    rows = t.scored.select("trade_id", "ticker", "trade_date", "cohort_index", "baseline_index", "severity_quadrant")
    return calibration(scoreable(add_alphas(rows, t.prices)), "cohort_alpha")


@query("i02_proximity", GAPS_SQL + "SELECT trade_id, proximity_days, has_proximity_data FROM features")
def i02(t: Tables):
    from ledgerlight.plans.features import proximity_features

    return proximity_features(t.trades, votes(t))


@query("i03_bill_proximity", GAPS_SQL + "SELECT trade_id, bill_proximity FROM features")
def i03(t: Tables):
    from ledgerlight.plans.features import bill_proximity

    return bill_proximity(t.trades, t.bills)


@query("i04_committee_relevance", GAPS_SQL + "SELECT trade_id, committee_relevance FROM features")
def i04(t: Tables):
    from ledgerlight.functions.sectors import parse_sector
    from ledgerlight.operators.entity import access_matrix, add_relevance

    rows = t.trades.select("trade_id", "politician_id", parse_sector("industry_sector").alias("sectors"))
    return add_relevance(rows, access_matrix(seats(t))).select("trade_id", "committee_relevance")


EXACT_NAMES = {
    0: ("House Committee on Armed Services", "defense"), 1: ("Senate Committee on Finance", "finance,healthcare"),
    2: ("House Committee on Natural Resources", "energy,agriculture"), 3: ("Senate Select Committee on Intelligence", "cross:0.5:defense,tech"),
    4: ("House Committee on Rules", ""),
}


@query("i05_exact_relevance", """
, ex AS (SELECT trade_id, politician_id % 5 AS g, politician_id % 2 AS lead, unnest(sectors) AS sector FROM trades),
w(g, sector, base, leader) AS (VALUES (0, 'defense', 0.7, 1.0), (1, 'finance', 0.7, 1.0), (1, 'healthcare', 0.7, 1.0), (2, 'energy', 0.7, 1.0), (2, 'agriculture', 0.7, 1.0), (3, 'defense', 0.5, 0.65), (3, 'tech', 0.5, 0.65)),
r AS (SELECT trade_id, max(CASE WHEN lead = 1 THEN leader ELSE base END) AS v FROM ex JOIN w USING (g, sector) GROUP BY 1)
SELECT t.trade_id, CAST(round(coalesce(r.v, 0), 2) AS DOUBLE) AS committee_relevance FROM trades t LEFT JOIN r USING (trade_id)
""")
def i05(t: Tables):
    from ledgerlight.functions.sectors import parse_sector
    from ledgerlight.operators.entity import access_matrix, add_relevance

    key = F.col("s_suppkey")
    name = F.element_at(F.array(*[F.lit(n) for n, _ in EXACT_NAMES.values()]), (key % 5 + 1).cast("int"))
    rows = t.supplier.select(key.alias("politician_id"), name.alias("committee_name"), F.when(key % 2 == 1, "Ranking Member").otherwise("3").alias("rank_in_committee"))
    trades = t.trades.select("trade_id", "politician_id", parse_sector("industry_sector").alias("sectors"))
    return add_relevance(trades, access_matrix(rows, exact=True)).select("trade_id", "committee_relevance")


@query("i06_zscore_cluster_lag", GAPS_SQL + "SELECT trade_id, round(amount_zscore, 6) AS amount_zscore, cluster_score, round(disclosure_lag, 6) AS disclosure_lag FROM features")
def i06(t: Tables):
    from ledgerlight.operators.temporal import tasks_for
    from ledgerlight.plans.features import behaviour_features

    return behaviour_features(t.trades, tasks_for(t.trades)).withColumns({c: F.round(c, 6) for c in ("amount_zscore", "disclosure_lag")})


@query("i07_features_v2", ALPHA_SQL + GAPS_SQL + """
SELECT trade_id, politician_id, ticker, trade_date, round(cohort_alpha, 6) AS cohort_alpha, round(coalesce(pre_trade_alpha, 0), 6) AS pre_trade_alpha, proximity_days, bill_proximity, has_proximity_data,
  committee_relevance, round(amount_zscore, 6) AS amount_zscore, cluster_score, round(disclosure_lag, 6) AS disclosure_lag FROM features JOIN alphas USING (ticker, trade_date)
""")
def i07(t: Tables):
    out = features(t)
    return out.withColumns({c: F.round(c, d) for c, d in (("cohort_alpha", 6), ("pre_trade_alpha", 6), ("amount_zscore", 6), ("disclosure_lag", 6))})


@query("i07_features_v1", ALPHA_SQL + """
, v AS (SELECT DISTINCT o_custkey AS eid, CAST(o_orderdate AS DATE) AS d, CASE o_orderstatus WHEN 'F' THEN 'defense' WHEN 'O' THEN 'finance' ELSE 'tech' END AS sector FROM orders),
s AS (SELECT t.trade_id, t.politician_id, t.ticker, t.trade_date, t.sectors, t.disclosure_lag_days, a.cohort_alpha FROM trades t JOIN alphas a USING (ticker, trade_date) WHERE a.cohort_alpha IS NOT NULL),
keys AS (SELECT DISTINCT politician_id, trade_date, sectors FROM s),
g AS (SELECT k.politician_id, k.trade_date, k.sectors, min(abs(v.d - k.trade_date)) FILTER (list_contains(k.sectors, v.sector)) AS g1, min(abs(v.d - k.trade_date)) AS g2
  FROM keys k JOIN v ON v.eid = k.politician_id AND abs(v.d - k.trade_date) <= 90 GROUP BY ALL),
x AS (SELECT s.*, coalesce(g1, g2) AS gap FROM s LEFT JOIN g ON g.politician_id = s.politician_id AND g.trade_date = s.trade_date AND g.sectors = s.sectors)
SELECT trade_id, politician_id, ticker, trade_date, round(cohort_alpha, 6) AS cohort_alpha, CAST(coalesce(gap, floor((SELECT median(gap) FROM x)), 7) AS INT) AS proximity_days,
  CASE WHEN gap IS NULL THEN 0 ELSE 1 END AS has_proximity_data, 0.0::DOUBLE AS committee_relevance, disclosure_lag_days AS disclosure_lag FROM x
""")
def i07v1(t: Tables):
    from ledgerlight.operators.temporal import tasks_for
    from ledgerlight.plans.features import cohort_features_v1

    sector = F.when(F.col("o_orderstatus") == "F", "defense").when(F.col("o_orderstatus") == "O", "finance").otherwise("tech")
    tagged = t.orders.select(F.col("o_custkey").alias("politician_id"), F.to_date("o_orderdate").alias("vote_date"), sector.alias("related_sector"))
    out = cohort_features_v1(t.trades, t.prices, tagged, seats(t), tasks=tasks_for(t.trades))
    return out.withColumn("cohort_alpha", F.round("cohort_alpha", 6))


def cusip_map(t: Tables):
    return t.part.select(F.concat(F.lit("C"), F.col("p_partkey")).alias("cusip"), letters(F.col("p_partkey")).alias("ticker"))


def funds(t: Tables):
    return t.supplier.select(F.col("s_suppkey").cast("string").alias("cik"), F.concat(F.lit("Fund"), F.col("s_suppkey")).alias("fund_name"))


def fund_trades(t: Tables):
    from ledgerlight.operators.clean import clean_inferred_trades

    return clean_inferred_trades(H.infer_fund_trades(holdings(t), cusip_map(t), funds(t)))


INFER_SQL = """
, h AS (SELECT CAST(l_suppkey AS VARCHAR) AS cik, l_suppkey, 'C' || l_partkey AS cusip, translate(CAST(l_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS ticker,
   CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INT) AS period, l_quantity * 100 AS shares, l_linenumber FROM lineitem),
q AS (SELECT cik, cusip, ticker, period, sum(shares) AS shares FROM h WHERE l_linenumber <> 7 AND l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY ALL),
m AS (SELECT coalesce(a.cik, b.cik) AS cik, coalesce(a.cusip, b.cusip) AS cusip, coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.period, b.period - 1) AS period, coalesce(b.shares, 0) - coalesce(a.shares, 0) AS delta
  FROM (SELECT * FROM q WHERE period < (SELECT max(period) FROM q)) a FULL JOIN (SELECT * FROM q WHERE period > (SELECT min(period) FROM q)) b ON a.cik = b.cik AND a.cusip = b.cusip AND a.period + 1 = b.period),
inferred AS (SELECT cik, 'Fund' || cik AS fund_name, cusip, ticker, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS trade_type, CAST(abs(delta) AS BIGINT) AS shares_delta,
  CAST(make_date(CAST((period - 1) // 4 AS BIGINT), CAST((period - 1) % 4 * 3 + 1 AS BIGINT), 1) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS inferred_date FROM m WHERE abs(delta) >= 100 AND length(ticker) <= 5)
"""


@query("i08_baseline_features", INFER_SQL + ALPHA_SQL.replace("SELECT DISTINCT ticker, trade_date FROM trades", "SELECT DISTINCT ticker, inferred_date AS trade_date FROM inferred") + """
SELECT cik, fund_name, i.ticker, inferred_date, trade_type, round(cohort_alpha, 6) AS cohort_alpha, round(coalesce(pre_trade_alpha, 0), 6) AS pre_trade_alpha, 7 AS proximity_days, 90 AS bill_proximity, 0 AS has_proximity_data,
  0.0::DOUBLE AS committee_relevance, 0.0::DOUBLE AS amount_zscore, 0 AS cluster_score, 0.0::DOUBLE AS disclosure_lag
FROM (SELECT DISTINCT cik, fund_name, ticker, inferred_date, trade_type FROM inferred) i JOIN alphas a ON a.ticker = i.ticker AND a.trade_date = i.inferred_date WHERE cohort_alpha IS NOT NULL
""")
def i08(t: Tables):
    from ledgerlight.plans.features import baseline_features

    out = baseline_features(fund_trades(t), t.prices)
    return out.withColumns({c: F.round(c, 6) for c in ("cohort_alpha", "pre_trade_alpha")})


@query("i09_infer_fund_trades", INFER_SQL + "SELECT * FROM inferred")
def i09(t: Tables):
    return H.infer_fund_trades(holdings(t), cusip_map(t), funds(t))


@query("i10_infer_security_trades", """
, q AS (SELECT 'C' || l_partkey AS cusip, translate(CAST(l_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS issuer_name, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INT) AS period, sum(l_quantity * 100) AS shares FROM lineitem GROUP BY ALL),
m AS (SELECT coalesce(a.cusip, b.cusip) AS cusip, coalesce(b.issuer_name, a.issuer_name) AS issuer_name, coalesce(a.period, b.period - 1) AS period, coalesce(a.shares, 0) AS shares_prior, coalesce(b.shares, 0) AS shares_current
  FROM (SELECT * FROM q WHERE period < (SELECT max(period) FROM q)) a FULL JOIN (SELECT * FROM q WHERE period > (SELECT min(period) FROM q)) b ON a.cusip = b.cusip AND a.period + 1 = b.period)
SELECT cusip, issuer_name, shares_prior, shares_current, shares_current - shares_prior AS share_change, CASE WHEN shares_prior = 0 THEN 'new_position' WHEN shares_current = 0 THEN 'exit_position'
  WHEN shares_current > shares_prior THEN 'increase' ELSE 'decrease' END AS trade_direction, (period - 1) // 4 || 'Q' || ((period - 1) % 4 + 1) AS from_period, period // 4 || 'Q' || (period % 4 + 1) AS to_period
FROM m WHERE shares_prior <> shares_current
""")
def i10(t: Tables):
    return H.infer_security_trades(holdings(t))


@query("i11_scaling", """
, u AS (SELECT unnest(['price', 'quantity', 'flat']) AS feature, unnest([l_extendedprice, l_quantity, 1.0]) AS x FROM lineitem)
SELECT feature, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM u GROUP BY 1
""")
def i11(t: Tables):
    from ledgerlight.plans.iforest import scaling

    rows = t.lineitem.select(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.lit(1.0).alias("flat"))
    return scaling(rows, ["price", "quantity", "flat"]).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("i11_standardize", """
, s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - m) / sd, 6) AS quantity FROM lineitem, s
""")
def i11s(t: Tables):
    from ledgerlight.plans.iforest import standardize

    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("quantity"))
    return standardize(rows, ["quantity"]).withColumn("quantity", F.round("quantity", 6))


PLAIN = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def plain_rows(t: Tables):
    key = trade_key()
    return t.lineitem.select(key.alias("trade_id"), *PLAIN)


def sql_digits(digest: str, first: int) -> str:
    return f"(CAST('0x' || substr({digest}, {first}, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def sql_unit(*parts: str) -> str:
    """The forest's hash in SQL."""
    return sql_digits(f"md5(concat_ws('|', {', '.join(parts)}))", 1)


def forest_sql(features: list[str], rows: str, seed: int = 42, trees: int = 200, subsample: int = 256, depth: int = 8, p: str = "") -> str:
    """CTEs that grow the forest over `rows` (key, v: the features as a list): `nodes` is the node table.

    For tables of more than 2 * subsample rows. Every level places the drawn rows in their nodes, then cuts these.
    """
    ranges = ", ".join(f"{{0}}(v[{i + 1}])" for i in range(len(features)))
    out = f"""
, {p}rows_in AS ({rows}),
{p}chance AS (SELECT 2.0::DOUBLE * {subsample} / count(*) AS chance, CAST(ceil({trees} * (2.0::DOUBLE * {subsample} / count(*))) AS INT) AS darts FROM {p}rows_in),
{p}thrown AS (
  SELECT key, v, unnest(list_distinct(list_transform(
    list_filter(list_transform(range(0, darts), lambda j: md5(concat_ws('|', key, j, {seed}))), lambda h: {sql_digits("h", 1)} < {trees} * chance / darts),
    lambda h: CAST(floor({sql_digits("h", 14)} * {trees}) AS INT) + {seed * trees}))) AS tree_id FROM {p}rows_in, {p}chance),
{p}level0 AS (SELECT tree_id, 0 AS node_id, v FROM {p}thrown
  QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY {sql_unit("key", "tree_id", "'draw'")}, key) <= {subsample})"""
    for d in range(depth + 1):
        grown = "size > 1 AND len(usable) > 0" if d < depth else "false"
        out += f""",
{p}range{d} AS (SELECT tree_id, node_id, count(*) AS size, [{ranges.format("min")}] AS low, [{ranges.format("max")}] AS high FROM {p}level{d} GROUP BY 1, 2),
{p}usable{d} AS (SELECT *, list_filter(range(0, {len(features)}), lambda i: high[i + 1] > low[i + 1]) AS usable FROM {p}range{d}),
{p}picked{d} AS (SELECT *, CASE WHEN {grown} THEN CAST(usable[CAST(floor({sql_unit("tree_id", "node_id", "'feature'")} * len(usable)) AS INT) + 1] AS INT) ELSE -1 END AS feature FROM {p}usable{d}),
{p}placed{d} AS (SELECT *, CASE WHEN feature >= 0 THEN low[feature + 1] + {sql_unit("tree_id", "node_id", "'cut'")} * (high[feature + 1] - low[feature + 1]) END AS place FROM {p}picked{d}),
{p}cut{d} AS (SELECT tree_id, node_id, feature, size, {d} AS depth,
  CASE WHEN place > low[feature + 1] AND place <= high[feature + 1] THEN place WHEN feature >= 0 THEN high[feature + 1] END AS cut FROM {p}placed{d})"""
        if d < depth:
            out += f""",
{p}level{d + 1} AS (SELECT tree_id, CASE WHEN v[feature + 1] < cut THEN 2 * node_id + 1 ELSE 2 * node_id + 2 END AS node_id, v
  FROM {p}level{d} JOIN {p}cut{d} USING (tree_id, node_id) WHERE feature >= 0)"""
    return out + f",\n{p}nodes AS (" + " UNION ALL ".join(f"SELECT * FROM {p}cut{d}" for d in range(depth + 1)) + ")"


def score_sql(depth: int = 8, subsample: int = 256, p: str = "", rows: str = "rows_in") -> str:
    """CTEs that walk every row of `rows` through all trees: `scored_rows` (key, score)."""
    mean = "(2.0::DOUBLE * (ln({0} - 1.0::DOUBLE) + 0.5772156649::DOUBLE) - 2.0::DOUBLE * ({0} - 1.0::DOUBLE) / {0})"
    steps = f"SELECT key, v, features, cuts, paths, 0 AS node FROM {rows}, {p}lists"
    for _ in range(depth):
        steps = f"SELECT key, v, features, cuts, paths, CASE WHEN features[node + 1] < 0 THEN node WHEN v[features[node + 1] + 1] < cuts[node + 1] THEN 2 * node + 1 ELSE 2 * node + 2 END AS node FROM ({steps})"
    return f""",
{p}paths AS (SELECT tree_id, node_id, feature, cut, depth + CASE WHEN size <= 1 THEN 0 WHEN size = 2 THEN 1 ELSE {mean.format("size")} END AS path FROM {p}nodes),
{p}every AS (SELECT tree_id, node_id FROM (SELECT DISTINCT tree_id FROM {p}nodes), range(0, {2 ** (depth + 1) - 1}) AS r(node_id)),
{p}lists AS (SELECT tree_id, list(feature ORDER BY node_id) AS features, list(cut ORDER BY node_id) AS cuts, list(path ORDER BY node_id) AS paths
  FROM {p}every LEFT JOIN {p}paths USING (tree_id, node_id) GROUP BY 1),
{p}scored_rows AS (SELECT key, any_value(v) AS v, pow(2.0::DOUBLE, -avg(paths[node + 1]) / {mean.format(f"{subsample}.0::DOUBLE")}) AS score FROM ({steps}) GROUP BY key)"""


PLAIN_SQL = forest_sql(PLAIN, f"SELECT trade_id AS key, [{', '.join(f'CAST({f} AS DOUBLE)' for f in PLAIN)}] AS v FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT)) AS trade_id, * FROM lineitem)")


@query("i12_forest_fit", PLAIN_SQL + """
SELECT tree_id, node_id, feature, round(cut, 6) AS cut, CAST(CASE WHEN feature >= 0 THEN 2 * node_id + 1 ELSE -1 END AS INT) AS "left",
  CAST(CASE WHEN feature >= 0 THEN 2 * node_id + 2 ELSE -1 END AS INT) AS "right", depth, size FROM nodes
""")
def i12(t: Tables):
    """Node table of a forest over all lineitems."""
    from ledgerlight.plans.iforest import fit

    return fit(plain_rows(t), PLAIN, "trade_id").withColumn("cut", F.when(F.col("feature") >= 0, F.round("cut", 6)))


@query("i13_forest_score", PLAIN_SQL + score_sql() + """
SELECT key AS trade_id, round(score, 6) AS score, round(0.5::DOUBLE - score, 6) AS raw_score, CASE WHEN 0.5::DOUBLE - score < 0 THEN -1 ELSE 1 END AS label FROM scored_rows
""")
def i13(t: Tables):
    """Score, raw value and label of every lineitem, by a stored model."""
    from ledgerlight.plans import iforest as IF

    rows = IF.spread(plain_rows(t), "trade_id")
    models = store(t)
    models.train("plain", "v1", rows, PLAIN, "trade_id")
    raw = IF.raw_from_score(F.col("score"))
    return IF.with_scores(rows, {"score": models.load("plain", "v1", PLAIN)}).select(
        "trade_id", F.round("score", 6).alias("score"), F.round(raw, 6).alias("raw_score"), IF.label_from_raw(raw).alias("label"))


def store(t: Tables):
    from ledgerlight.plans.models import ModelStore
    from ledgerlight.session import scratch_path

    return ModelStore(t.spark, scratch_path(t.spark, "models"))


def dual_scores(t: Tables):
    from ledgerlight.plans.features import baseline_features
    from ledgerlight.plans.scoring import dual_score, model_version
    from ledgerlight.session import scratch_path
    from ledgerlight.sources.sinks import write_matrix

    # Both matrices are written once: training and scoring read them several times.
    cohort_path, baseline_path = scratch_path(t.spark, "cohort"), scratch_path(t.spark, "baseline")
    def stored(df):
        """Six decimals, as both engines compute them alike."""
        return df.withColumns({f: F.round(f, 6) for f, kind in df.dtypes if kind == "double"})

    write_matrix(stored(features(t).where("cohort_alpha is not null")), cohort_path)
    write_matrix(stored(baseline_features(fund_trades(t), t.prices)).withColumn(
        "row_key", F.concat_ws("-", "cik", "ticker", "inferred_date", "trade_type")), baseline_path)
    cohort, baseline = t.spark.read.parquet(cohort_path), t.spark.read.parquet(baseline_path)
    models = store(t)
    models.train("cohort", "2026-01-01", cohort, FEATURES_V2, "trade_id")
    models.train("baseline", "2026-01-02", baseline, FEATURES_V2, "row_key")
    forests = [models.load(name, version, FEATURES_V2) for name, version in (("cohort", "2026-01-01"), ("baseline", "2026-01-02"))]
    return dual_score(cohort, *forests, model_version("2026-01-01", "2026-01-02"), "2026-01-03 00:00:00")


def dual_sql() -> str:
    """CTEs of both matrices, both forests and the `dual` scores of the cohort's rows."""
    nine = "[" + ", ".join(f"CAST({f} AS DOUBLE)" for f in FEATURES_V2) + "] AS v"
    funds = ALPHA_SQL.replace("SELECT DISTINCT ticker, trade_date FROM trades", "SELECT DISTINCT ticker, inferred_date AS trade_date FROM inferred")
    funds = re.sub(r"\b(k|a[1-8]|alphas)\b", r"fund_\1", funds)
    index = "CAST(floor((-greatest(-0.5::DOUBLE, least(0.5::DOUBLE, {0})) + 0.5::DOUBLE) * 100) AS INT)"
    return ALPHA_SQL + GAPS_SQL + """
, cohort AS (SELECT trade_id, politician_id, ticker, trade_date, round(cohort_alpha, 6) AS cohort_alpha, round(coalesce(pre_trade_alpha, 0), 6) AS pre_trade_alpha, proximity_days, bill_proximity, has_proximity_data,
  round(committee_relevance, 6) AS committee_relevance, round(amount_zscore, 6) AS amount_zscore, cluster_score, round(disclosure_lag, 6) AS disclosure_lag
  FROM features JOIN alphas USING (ticker, trade_date) WHERE cohort_alpha IS NOT NULL)
""" + INFER_SQL + funds + """
, baseline AS (SELECT concat_ws('-', cik, i.ticker, inferred_date, trade_type) AS row_key, round(cohort_alpha, 6) AS cohort_alpha, round(coalesce(pre_trade_alpha, 0), 6) AS pre_trade_alpha, 7 AS proximity_days,
  90 AS bill_proximity, 0 AS has_proximity_data, 0 AS committee_relevance, 0 AS amount_zscore, 0 AS cluster_score, 0 AS disclosure_lag
  FROM (SELECT DISTINCT cik, fund_name, ticker, inferred_date, trade_type FROM inferred) i JOIN fund_alphas a ON a.ticker = i.ticker AND a.trade_date = i.inferred_date WHERE cohort_alpha IS NOT NULL)
""" + forest_sql(FEATURES_V2, f"SELECT trade_id AS key, {nine} FROM cohort", p="c_") + score_sql(p="c_", rows="c_rows_in") \
        + forest_sql(FEATURES_V2, f"SELECT row_key AS key, {nine} FROM baseline", p="b_") + score_sql(p="b_", rows="c_rows_in") + f"""
, dual AS (SELECT c.*, 0.5::DOUBLE - a.score AS cohort_raw, 0.5::DOUBLE - b.score AS baseline_raw,
  {index.format("(0.5::DOUBLE - a.score)")} AS cohort_index, {index.format("(0.5::DOUBLE - b.score)")} AS baseline_index
  FROM cohort c JOIN c_scored_rows a ON a.key = c.trade_id JOIN b_scored_rows b ON b.key = c.trade_id)
"""


@query("i14_dual_score", dual_sql() + f"""
SELECT trade_id, politician_id, ticker, trade_date, round(cohort_raw, 6) AS cohort_raw_score, CASE WHEN cohort_raw < 0 THEN -1 ELSE 1 END AS cohort_label, cohort_index,
  round(baseline_raw, 6) AS baseline_raw_score, CASE WHEN baseline_raw < 0 THEN -1 ELSE 1 END AS baseline_label, baseline_index,
  CASE WHEN cohort_index >= 60 AND baseline_index >= 60 THEN 'SEVERE' WHEN baseline_index >= 60 THEN 'SYSTEMIC' WHEN cohort_index >= 60 THEN 'OUTLIER' ELSE 'UNREMARKABLE' END AS severity_quadrant,
  cohort_index >= 70 OR baseline_index >= 70 AS audit_triggered, {", ".join(f"round({f}, 4) AS feat_{f}" if f == "disclosure_lag" else f"{f} AS feat_{f}" for f in FEATURES_V2)},
  'v2_cohort_2026-01-01_baseline_2026-01-02' AS model_version, TIMESTAMP '2026-01-03 00:00:00' AS scored_at FROM dual
""")
def i14(t: Tables):
    """Features, both forests and quadrants end to end."""
    return dual_scores(t).withColumns({c: F.round(c, 6) for c in ("cohort_raw_score", "baseline_raw_score")})


@query("i15_training_stats", """
, r AS (SELECT (50 - cohort_index) / 100.0::DOUBLE AS x FROM scored)
SELECT count(*) AS n_training_samples, round(count(*) FILTER (x < 0) * 100.0::DOUBLE / count(*), 2) AS outlier_pct, round(min(x), 4) AS score_min, round(max(x), 4) AS score_max, round(avg(x), 4) AS score_mean, round(stddev_pop(x), 4) AS score_std FROM r
""")
def i15(t: Tables):
    from ledgerlight.plans.iforest import training_stats

    return training_stats(t.scores.select(((50 - F.col("cohort_index")) / 100.0).alias("raw_score")))


@query("i15_model_card", PLAIN_SQL + score_sql() + """
, r AS (SELECT 0.5::DOUBLE - score AS x FROM scored_rows)
SELECT count(*) AS n_training_samples, round(count(*) FILTER (x < 0) * 100.0::DOUBLE / count(*), 2) AS outlier_pct, round(min(x), 4) AS score_min, round(max(x), 4) AS score_max,
  round(avg(x), 4) AS score_mean, round(stddev_pop(x), 4) AS score_std, 'l_extendedprice,l_quantity,l_discount,l_tax' AS features, '2026-01-01' AS trained_at FROM r
""")
def i15c(t: Tables):
    """What is stored with a model."""
    from ledgerlight.plans.iforest import spread

    models = store(t)
    models.train("plain", "v1", spread(plain_rows(t), "trade_id"), PLAIN, "trade_id", "2026-01-01")
    return models.card("plain", "v1").withColumn("features", F.array_join("features", ","))


POLITICAL = ["committee_relevance", "has_proximity_data"]
ORDER_FEATURES = ["price", "day", *POLITICAL]


def order_rows(t: Tables, trained: bool):
    """Orders as trades; a baseline model is trained with political features that never vary."""
    political = [F.lit(0.0), F.lit(0.0)] if trained else [F.col("o_custkey") % 5 / 4.0, (F.col("o_orderkey") % 2).cast("double")]
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("trade_id"), F.col("o_totalprice").cast("double").alias("price"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double").alias("day"), *[c.alias(n) for c, n in zip(political, POLITICAL)],
    )


ORDER_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS key, [CAST(o_totalprice AS DOUBLE), CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE), {0}, {1}] AS v FROM orders"""


@query("i16_feature_inertness", forest_sql(ORDER_FEATURES, ORDER_SQL.format("0.0::DOUBLE", "0.0::DOUBLE")) + f"""
, real_rows AS ({ORDER_SQL.format("o_custkey % 5 / 4.0::DOUBLE", "CAST(o_orderkey % 2 AS DOUBLE)")}),
taking AS (SELECT key, v, row_number() OVER (ORDER BY md5('to' || key), key) AS place FROM real_rows),
giving AS (SELECT v AS d, row_number() OVER (ORDER BY md5('from' || key), key) AS place FROM real_rows),
variants AS (SELECT '0|' || key AS key, v FROM real_rows UNION ALL
  SELECT i || '|' || key, list_transform(range(1, 5), lambda j: CASE WHEN j = i THEN d[j] ELSE v[j] END) FROM taking JOIN giving USING (place), range(1, 5) AS r(i))
""" + score_sql(rows="variants") + """
, indexed AS (SELECT CAST(split_part(key, '|', 1) AS INT) AS variant, split_part(key, '|', 2) AS trade_id, floor((-greatest(-0.5::DOUBLE, least(0.5::DOUBLE, 0.5::DOUBLE - score)) + 0.5::DOUBLE) * 100) AS idx FROM scored_rows),
shifts AS (SELECT ['price', 'day', 'committee_relevance', 'has_proximity_data'][a.variant] AS feature, abs(a.idx - b.idx) AS shift FROM indexed a JOIN indexed b ON a.trade_id = b.trade_id AND b.variant = 0 WHERE a.variant > 0)
SELECT feature, round(avg(shift), 4) AS mean_shift, CAST(max(shift) AS DOUBLE) AS max_shift, max(shift) <= 0 AS inert FROM shifts GROUP BY feature
""")
def i16f(t: Tables):
    """How far each feature moves the indices of a baseline model."""
    from ledgerlight.plans.models import feature_inertness

    models = store(t)
    models.train("baseline", "v1", order_rows(t, trained=True), ORDER_FEATURES, "trade_id")
    return feature_inertness(order_rows(t, trained=False), models.load("baseline", "v1", ORDER_FEATURES), "trade_id")


@query("i16_probes", PLAIN_SQL + f"""
, probe_rows AS (SELECT 'extreme' AS key, [{", ".join(f"2 * max({f}) - min({f})" for f in PLAIN)}]::DOUBLE[] AS v FROM lineitem UNION ALL SELECT 'ordinary', [{", ".join(f"median({f})" for f in PLAIN)}]::DOUBLE[] FROM lineitem)
""" + score_sql(rows="probe_rows") + """
, i AS (SELECT key AS probe, CAST(floor((-greatest(-0.5::DOUBLE, least(0.5::DOUBLE, 0.5::DOUBLE - score)) + 0.5::DOUBLE) * 100) AS INT) AS index FROM scored_rows)
SELECT probe, index, CASE WHEN probe = 'extreme' THEN index >= 65 ELSE index < 40 END AS ok FROM i
""")
def i16p(t: Tables):
    """An extreme and an ordinary row, made of the training data."""
    from ledgerlight.plans.iforest import spread
    from ledgerlight.plans.models import probes

    models, rows = store(t), spread(plain_rows(t), "trade_id")
    models.train("plain", "v1", rows, PLAIN, "trade_id")
    return probes(rows, models.load("plain", "v1", PLAIN))


@query("i16_model_checks", dual_sql() + """
, checks AS (SELECT round(count(*) FILTER (cohort_raw < 0)::DOUBLE / count(*), 4) AS outlier_rate, round(abs(avg(cohort_index) - avg(baseline_index)), 4) AS mean_gap,
  round(count(*) FILTER (cohort_index >= 55 AND baseline_index >= 55)::DOUBLE / count(*), 4) AS both_high_rate, round(corr(cohort_index, baseline_index), 4) AS correlation FROM dual)
SELECT *, outlier_rate BETWEEN 0.01 AND 0.20 AS outlier_rate_ok, mean_gap < 20 AS mean_gap_ok, both_high_rate >= 0.003 AS both_high_ok, coalesce(correlation < 0.80, true) AS correlation_ok FROM checks
""")
def i16(t: Tables):
    """Thresholds on the end-to-end scores."""
    from ledgerlight.plans.scoring import model_checks

    return model_checks(dual_scores(t))


@query("i16_seed_stability")
def i16s(t: Tables):
    """Label agreement of forests grown from ten seeds of 200 trees in one job."""
    from ledgerlight.plans.iforest import seed_stability

    return seed_stability(plain_rows(t), PLAIN, "trade_id")


@query("i17_flagged_by_day", """
SELECT trade_id, trade_date, greatest(cohort_index, baseline_index) AS max_index, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY greatest(cohort_index, baseline_index) DESC, trade_id) AS INT) AS day_rank, full_name, r.headline, r.narrative FROM flagged f LEFT JOIN reports r USING (trade_id) LEFT JOIN politicians p ON p.id = f.politician_id
""")
def i17(t: Tables):
    from ledgerlight.plans.reports import flagged_by_day

    return flagged_by_day(t.scored, t.politicians, t.reports).select("trade_id", "trade_date", "max_index", "day_rank", "full_name", "headline", "narrative")


@query("i18_retrain_days", """
, d AS (SELECT trade_date, count(*) FILTER (cohort_index >= 60)::DOUBLE / count(*) AS rate FROM scored GROUP BY 1),
w AS (SELECT trade_date, min(rate) OVER (ORDER BY trade_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS lowest, count(*) OVER (ORDER BY trade_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS days FROM d)
SELECT trade_date, round(lowest, 4) AS lowest_rate FROM w WHERE days = 7 AND lowest > 0.25
""")
def i18(t: Tables):
    from ledgerlight.plans.scoring import retrain_triggers

    return retrain_triggers(t.scores, outlier=F.col("cohort_index") >= 60)


@query("i18_correlation_trigger", "SELECT round(corr(cohort_index, baseline_index), 4) AS correlation, corr(cohort_index, baseline_index) < 0 AS retrain FROM scored")
def i18c(t: Tables):
    from ledgerlight.plans.scoring import correlation_trigger

    return correlation_trigger(t.scores)
