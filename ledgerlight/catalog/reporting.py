"""Aggregations (D)."""

from pyspark.sql import functions as F

from ledgerlight.catalog.base import Tables, letters, query, trade_key
from ledgerlight.functions import sectors as S
from ledgerlight.functions import vocab as V
from ledgerlight.operators import analytics as A
from ledgerlight.operators import entity as E
from ledgerlight.operators import merge as M
from ledgerlight.operators import metrics as W
from ledgerlight.operators import quality as Q
from ledgerlight.operators.quantiles import grouped_percentiles
from ledgerlight.plans.features import add_sectors
from ledgerlight.session import scratch_path
from ledgerlight.sources import sinks as K

Q4 = "severity_quadrant"
SEV = "count(*) FILTER (severity_quadrant = 'SEVERE')"
SYS = "count(*) FILTER (severity_quadrant = 'SYSTEMIC')"
OUT = "count(*) FILTER (severity_quadrant = 'OUTLIER')"
UNR = "count(*) FILTER (severity_quadrant = 'UNREMARKABLE')"
FLG = "count(*) FILTER (severity_quadrant IN ('SEVERE', 'SYSTEMIC'))"
ANO = "count(*) FILTER (severity_quadrant <> 'UNREMARKABLE')"


@query("d01_systemic_stats", f"""
, b AS (SELECT count(*) AS total_scored, {SEV} AS severe_count, {SYS} AS systemic_count, {OUT} AS outlier_count, {UNR} AS unremarkable_count,
  count(*) FILTER (audit_triggered) AS audit_triggered_count, round(avg(cohort_index), 2) AS avg_cohort_index, round(avg(baseline_index), 2) AS avg_baseline_index FROM scored)
SELECT *, round(severe_count * 100.0::DOUBLE / total_scored, 2) AS severe_pct, round(systemic_count * 100.0::DOUBLE / total_scored, 2) AS systemic_pct,
  round(outlier_count * 100.0::DOUBLE / total_scored, 2) AS outlier_pct, round(unremarkable_count * 100.0::DOUBLE / total_scored, 2) AS unremarkable_pct,
  round(audit_triggered_count * 100.0::DOUBLE / total_scored, 2) AS audit_triggered_pct FROM b
""")
def d01(t: Tables):
    return A.systemic_stats(t.scores)


@query("d02_profile_aggregates", f"""
, persons AS (SELECT id, full_name FROM politicians UNION ALL SELECT c_custkey + 1000000, c_name FROM customer),
g AS (SELECT politician_id, count(*) AS total_trades, {SEV} AS severe_count, {SYS} AS systemic_count, {OUT} AS outlier_count, {UNR} AS unremarkable_count,
  round(avg(cohort_index), 2) AS avg_cohort, round(avg(baseline_index), 2) AS avg_baseline FROM scored GROUP BY 1)
SELECT p.id, p.full_name, coalesce(total_trades, 0) AS total_trades, coalesce(severe_count, 0) AS severe_count, coalesce(systemic_count, 0) AS systemic_count,
  coalesce(outlier_count, 0) AS outlier_count, coalesce(unremarkable_count, 0) AS unremarkable_count, coalesce(avg_cohort, 0) AS avg_cohort, coalesce(avg_baseline, 0) AS avg_baseline
FROM persons p LEFT JOIN g ON g.politician_id = p.id
""")
def d02(t: Tables):
    idle = t.customer.select((F.col("c_custkey") + 1000000).alias("id"), F.col("c_name").alias("full_name"))
    return A.profile_aggregates(t.politicians.select("id", "full_name").unionByName(idle), t.scored)


@query("d03_quadrant_health", """
SELECT severity_quadrant, count(*) AS trade_count, round(avg(cohort_index), 1) AS avg_cohort, round(avg(baseline_index), 1) AS avg_baseline,
  count(*) FILTER (audit_triggered) AS audits_triggered, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM scored GROUP BY 1
""")
def d03(t: Tables):
    return A.quadrant_health(t.scores)


@query("d04_amount_stats", """
SELECT politician_id, round(avg(ln(amount_midpoint + 1)), 6) AS log_amt_mean, round(stddev_pop(ln(amount_midpoint + 1)), 6) AS log_amt_std, count(*) AS n_trades
FROM trades WHERE politician_id IS NOT NULL AND amount_midpoint IS NOT NULL GROUP BY 1 HAVING count(*) >= 5
""")
def d04(t: Tables):
    return A.amount_stats(t.trades).withColumns({c: F.round(c, 6) for c in ("log_amt_mean", "log_amt_std")})


@query("d05_most_flagged_people", f"""
SELECT politician_id, full_name, party, chamber, state, count(*) AS flagged, {SEV} AS severe, {SYS} AS systemic, round(avg(cohort_index), 1) AS avg_cohort,
  round(avg(baseline_index), 1) AS avg_baseline, count(DISTINCT ticker) AS unique_tickers
FROM flagged f JOIN politicians p ON p.id = f.politician_id GROUP BY ALL ORDER BY flagged DESC, politician_id LIMIT 20
""")
def d05(t: Tables):
    return A.most_flagged_people(t.scored, t.politicians)


@query("d06_most_flagged_tickers", f"""
SELECT ticker, industry_sector, count(*) AS flagged, {SEV} AS severe, {SYS} AS systemic, count(*) FILTER (trade_type = 'buy') AS buys,
  count(*) FILTER (trade_type = 'sell') AS sells, count(DISTINCT politician_id) AS unique_politicians, round(avg(feat_cohort_alpha), 3) AS avg_alpha
FROM flagged GROUP BY 1, 2 ORDER BY flagged DESC, ticker, industry_sector NULLS FIRST LIMIT 20
""")
def d06(t: Tables):
    return A.most_flagged_tickers(t.scored)


@query("d07_flagged_by_month", f"""
SELECT strftime(trade_date, '%Y-%m') AS month, count(*) AS flagged, {SEV} AS severe, {SYS} AS systemic FROM flagged GROUP BY 1 ORDER BY 1 DESC LIMIT 24
""")
def d07(t: Tables):
    return A.flagged_by_month(t.scored)


@query("d08_top_anomalous_people", f"""
SELECT politician_id, full_name, party, chamber, state, count(*) AS anomalous, {SEV} AS severe, {SYS} AS systemic, {OUT} AS outlier,
  round(avg(cohort_index), 1) AS avg_cohort, round(avg(baseline_index), 1) AS avg_baseline, max(cohort_index) AS max_cohort
FROM scored f JOIN politicians p ON p.id = f.politician_id WHERE severity_quadrant <> 'UNREMARKABLE' GROUP BY ALL ORDER BY anomalous DESC, politician_id LIMIT 50
""")
def d08(t: Tables):
    return A.top_anomalous_people(t.scored, t.politicians)


@query("d09_flag_rates", f"""
SELECT politician_id, full_name, party, chamber, count(DISTINCT trade_id) AS total_trades, {FLG} AS flagged, round(avg(baseline_index), 1) AS avg_baseline,
  round({FLG} * 100.0::DOUBLE / count(DISTINCT trade_id), 1) AS flag_rate_pct
FROM scored f JOIN politicians p ON p.id = f.politician_id GROUP BY ALL HAVING count(DISTINCT trade_id) >= 10 ORDER BY flag_rate_pct DESC, politician_id LIMIT 25
""")
def d09(t: Tables):
    return A.flag_rates(t.scored, t.politicians)


@query("d10_flagged_sectors", f"""
SELECT coalesce(industry_sector, 'UNMAPPED') AS sector, count(*) AS flagged, {SEV} AS severe, {SYS} AS systemic, round(avg(feat_cohort_alpha), 3) AS avg_alpha,
  count(DISTINCT politician_id) AS unique_politicians FROM flagged GROUP BY 1
""")
def d10(t: Tables):
    return A.flagged_sectors(t.scored)


@query("d11_party_flags", f"""
SELECT party, count(*) AS total_trades, {FLG} AS flagged, round({FLG} * 100.0::DOUBLE / count(*), 2) AS flag_rate_pct, {SEV} AS severe, {SYS} AS systemic,
  round(avg(cohort_index), 1) AS avg_cohort, round(avg(baseline_index), 1) AS avg_baseline FROM scored f JOIN politicians p ON p.id = f.politician_id GROUP BY 1
""")
def d11(t: Tables):
    return A.party_flags(t.scored, t.politicians)


@query("d12_weekly_clusters", """
SELECT ticker, CAST(isoyear(trade_date) * 100 + weekofyear(trade_date) AS INT) AS trade_week, min(trade_date) AS week_start, max(trade_date) AS week_end,
  count(DISTINCT politician_id) AS unique_politicians, count(*) AS total_trades, round(avg(baseline_index), 1) AS avg_baseline, round(avg(feat_cohort_alpha), 3) AS avg_alpha,
  string_agg(DISTINCT full_name, ', ' ORDER BY full_name) AS who
FROM flagged f JOIN politicians p ON p.id = f.politician_id GROUP BY 1, 2 HAVING count(DISTINCT politician_id) >= 2
ORDER BY unique_politicians DESC, avg_baseline DESC, ticker, trade_week LIMIT 20
""")
def d12(t: Tables):
    return A.weekly_clusters(t.scored, t.politicians)


@query("d13_alpha_by_population", """
SELECT p.population, count(*) AS n, round(avg(feat_cohort_alpha), 4) AS mean_alpha, round(stddev_pop(feat_cohort_alpha), 4) AS std_alpha
FROM scored s JOIN (VALUES ('ALL'), ('SYSTEMIC'), ('SEVERE'), ('UNREMARKABLE')) p(population) ON p.population IN ('ALL', s.severity_quadrant) GROUP BY 1
""")
def d13(t: Tables):
    return A.alpha_by_population(t.scores)


@query("d14_calibration", f"""
SELECT CASE WHEN abs(feat_cohort_alpha) < 0.05 THEN '<5%' WHEN abs(feat_cohort_alpha) < 0.10 THEN '5-10%' WHEN abs(feat_cohort_alpha) < 0.20 THEN '10-20%'
  WHEN abs(feat_cohort_alpha) < 0.50 THEN '20-50%' ELSE '>50%' END AS abs_alpha_bucket,
  count(*) AS trades, round(avg(cohort_index), 1) AS avg_cohort, round(avg(baseline_index), 1) AS avg_baseline, {FLG} AS flagged FROM scored GROUP BY 1
""")
def d14(t: Tables):
    return A.calibration(t.scores)


@query("d15_watch_list", f"""
SELECT politician_id, full_name, party, count(*) AS total_trades, {FLG} AS flagged, round(avg(baseline_index), 1) AS avg_baseline, round(avg(abs(feat_cohort_alpha)), 3) AS avg_abs_alpha
FROM scored f JOIN politicians p ON p.id = f.politician_id WHERE full_name ILIKE '%lastB%' OR full_name ILIKE '%firstC%' OR full_name ILIKE '%GH%' GROUP BY ALL
""")
def d15(t: Tables):
    return A.watch_list(t.scored, t.politicians, ["lastB", "firstC", "GH"])


@query("d16_volume_bias", f"""
, g AS (SELECT politician_id, count(*) AS total, {ANO} AS anom FROM scored WHERE politician_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
r AS (SELECT corr(total, anom) AS r_count, corr(total, anom::DOUBLE / total) AS r_rate FROM g)
SELECT round(r_count, 6) AS r_count, round(r_rate, 6) AS r_rate, CASE WHEN abs(r_rate) < 0.3 THEN 'LOW' WHEN abs(r_rate) < 0.5 THEN 'MODERATE' ELSE 'HIGH' END AS verdict FROM r
""")
def d16(t: Tables):
    return A.volume_bias(t.scored).withColumns({c: F.round(c, 6) for c in ("r_count", "r_rate")})


@query("d17_top_rates", f"""
SELECT politician_id, full_name, party, count(*) AS total, {ANO} AS anom, round({ANO} * 100.0::DOUBLE / count(*), 1) AS rate
FROM scored f JOIN politicians p ON p.id = f.politician_id GROUP BY ALL HAVING count(*) >= 10 ORDER BY rate DESC, politician_id LIMIT 10
""")
def d17(t: Tables):
    return A.top_rates(t.scored, t.politicians)


@query("d18_feature_distribution", """
, u AS (SELECT severity_quadrant <> 'UNREMARKABLE' AS anomalous, unnest(['cohort_alpha', 'proximity_days', 'has_proximity_data', 'committee_relevance', 'disclosure_lag']) AS feature,
  unnest([feat_cohort_alpha, feat_proximity_days::DOUBLE, feat_has_proximity_data::DOUBLE, feat_committee_relevance, feat_disclosure_lag]) AS x FROM scored)
SELECT feature, anomalous, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max FROM u GROUP BY 1, 2
""")
def d18(t: Tables):
    return A.feature_distribution(t.scores)


@query("d19_party_bias", f"""
SELECT party, count(*) AS total, {ANO} AS anomalous, round({ANO} * 100.0::DOUBLE / count(*), 1) AS rate, {SEV} AS severe, {SYS} AS systemic, {OUT} AS outlier
FROM scored f JOIN politicians p ON p.id = f.politician_id GROUP BY 1
""")
def d19(t: Tables):
    return A.party_bias(t.scored, t.politicians)


BUCKET = f"""count(*) AS total, {ANO} AS anom, round({ANO} * 100.0::DOUBLE / count(*), 1) AS rate, round(avg(cohort_index), 1) AS avg_cohort"""


@query("d20_sector_rates", f"SELECT industry_sector, {BUCKET}, round(avg(baseline_index), 1) AS avg_baseline FROM scored GROUP BY 1")
def d20(t: Tables):
    return A.sector_rates(t.scored)


@query("d21_lag_buckets", f"""
SELECT CASE WHEN feat_disclosure_lag <= 7 THEN '0-7d' WHEN feat_disclosure_lag <= 30 THEN '8-30d' WHEN feat_disclosure_lag <= 60 THEN '31-60d'
  WHEN feat_disclosure_lag <= 90 THEN '61-90d' ELSE '90d+' END AS lag_bucket, {BUCKET}, round(avg(baseline_index), 1) AS avg_baseline FROM scored GROUP BY 1
""")
def d21(t: Tables):
    return A.lag_buckets(t.scores)


@query("d22_alpha_buckets", f"""
SELECT CASE WHEN feat_cohort_alpha < -0.10 THEN 'large_loss (<-10%)' WHEN feat_cohort_alpha < -0.03 THEN 'moderate_loss (-10% to -3%)'
  WHEN feat_cohort_alpha < 0.03 THEN 'normal (-3% to +3%)' WHEN feat_cohort_alpha < 0.10 THEN 'moderate_gain (+3% to +10%)' ELSE 'large_gain (>+10%)' END AS alpha_bucket,
  {BUCKET} FROM scored GROUP BY 1
""")
def d22(t: Tables):
    return A.alpha_buckets(t.scores)


@query("d23_scorecards", f"""
SELECT v.pattern, politician_id, full_name, party, count(*) AS total, {ANO} AS anom, round({ANO} * 100.0::DOUBLE / count(*), 1) AS rate, {SEV} AS severe,
  round(avg(cohort_index), 1) AS avg_cohort, round(avg(baseline_index), 1) AS avg_baseline, max(cohort_index) AS max_cohort
FROM scored f JOIN politicians p ON p.id = f.politician_id JOIN (VALUES ('LastD'), ('FirstEF'), ('nobody')) v(pattern) ON contains(lower(full_name), lower(v.pattern)) GROUP BY ALL
""")
def d23(t: Tables):
    return A.scorecards(t.scored, t.politicians, ["LastD", "FirstEF", "nobody"])


@query("d24_index_deciles", """
, u AS (SELECT 'cohort' AS model, cohort_index AS x FROM scored UNION ALL SELECT 'baseline', baseline_index FROM scored)
SELECT model, CAST(floor(x / 10) * 10 AS INT) AS bucket, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY model), 1) AS pct FROM u GROUP BY 1, 2
""")
def d24(t: Tables):
    return A.index_deciles(t.scores)


@query("d25_relevance_buckets", f"""
SELECT CASE WHEN feat_committee_relevance = 0 THEN 'none (0.0)' WHEN feat_committee_relevance < 0.5 THEN 'low (0.01-0.49)'
  WHEN feat_committee_relevance < 0.8 THEN 'medium (0.5-0.79)' ELSE 'high (0.8-1.0)' END AS cr_bucket, {BUCKET} FROM scored GROUP BY 1
""")
def d25(t: Tables):
    return A.relevance_buckets(t.scores)


COMPARED_SQL = """
, compared AS (SELECT trade_id, politician_id AS politician_id_v2, severity_quadrant AS q2, cohort_index AS c2, baseline_index AS b2, (cohort_index + 7) % 101 AS c1, (baseline_index + 13) % 101 AS b1,
    CASE WHEN (cohort_index + 7) % 101 >= 60 AND (baseline_index + 13) % 101 >= 60 THEN 'SEVERE' WHEN (baseline_index + 13) % 101 >= 60 THEN 'SYSTEMIC'
      WHEN (cohort_index + 7) % 101 >= 60 THEN 'OUTLIER' ELSE 'UNREMARKABLE' END AS q1,
    (cohort_index + 7) % 101 >= 70 OR (baseline_index + 13) % 101 >= 70 AS audit1, audit_triggered AS audit2 FROM scored)
"""


def first_run(t: Tables):
    from ledgerlight.functions import scores as N

    c, b = ((F.col("cohort_index") + 7) % 101).cast("int"), ((F.col("baseline_index") + 13) % 101).cast("int")
    return t.scores.select(
        "trade_id", "politician_id", c.alias("cohort_index"), b.alias("baseline_index"),
        N.quadrant(c, b).alias("severity_quadrant"), N.audit_flag(c, b).alias("audit_triggered"),
    )


def compared(t: Tables):
    second = t.scores.select(*first_run(t).columns)
    return M.compare_runs(first_run(t), second, "trade_id")


@query("d26_transition_cube", COMPARED_SQL + """
SELECT q1 AS severity_quadrant_v1, q2 AS severity_quadrant_v2, count(*) AS n FROM compared GROUP BY CUBE (q1, q2)
""")
def d26(t: Tables):
    return A.transition_cube(compared(t))


@query("d26_transition_matrix", COMPARED_SQL + """
SELECT coalesce(q1, 'All') AS severity_quadrant_v1, count(*) FILTER (q2 = 'SEVERE') AS "SEVERE", count(*) FILTER (q2 = 'SYSTEMIC') AS "SYSTEMIC",
  count(*) FILTER (q2 = 'OUTLIER') AS "OUTLIER", count(*) FILTER (q2 = 'UNREMARKABLE') AS "UNREMARKABLE", count(*) AS "All" FROM compared GROUP BY ROLLUP (q1)
""")
def d26m(t: Tables):
    return A.transition_matrix(compared(t))


@query("d27_run_comparison", COMPARED_SQL + """
, k1 AS (SELECT q1 AS kind, count(*) AS n_v1 FROM compared GROUP BY 1 UNION ALL SELECT 'Audit triggered', count(*) FROM compared WHERE audit1),
k2 AS (SELECT q2 AS kind, count(*) AS n_v2 FROM compared GROUP BY 1 UNION ALL SELECT 'Audit triggered', count(*) FROM compared WHERE audit2),
n AS (SELECT count(*) AS n FROM compared)
SELECT kind, n_v1, round(n_v1 * 100.0::DOUBLE / (SELECT n FROM n), 1) AS pct_v1, n_v2, round(n_v2 * 100.0::DOUBLE / (SELECT n FROM n), 1) AS pct_v2, n_v2 - n_v1 AS delta FROM k1 JOIN k2 USING (kind)
""")
def d27(t: Tables):
    return A.run_comparison(first_run(t), t.scores)


@query("d28_changed_quadrants", COMPARED_SQL + """
SELECT count(*) AS matched, count(*) FILTER (q1 <> q2) AS changed, round(count(*) FILTER (q1 <> q2) * 100.0::DOUBLE / count(*), 1) AS changed_pct FROM compared
""")
def d28(t: Tables):
    return A.changed_quadrants(compared(t))


@query("d28_newly_severe", COMPARED_SQL + """
SELECT trade_id, q1 AS severity_quadrant_v1, CAST(c1 AS INT) AS cohort_index_v1, c2 AS cohort_index_v2 FROM compared WHERE q2 = 'SEVERE' AND q1 <> 'SEVERE'
""")
def d28n(t: Tables):
    return A.newly_severe(compared(t)).select("trade_id", "severity_quadrant_v1", "cohort_index_v1", "cohort_index_v2")


@query("d29_score_summary", """
SELECT severity_quadrant, round(avg(cohort_index), 1) AS cohort_mean, median(cohort_index) AS cohort_median, round(stddev_samp(cohort_index), 1) AS cohort_std, max(cohort_index) AS cohort_max,
  round(avg(baseline_index), 1) AS baseline_mean, median(baseline_index) AS baseline_median, round(stddev_samp(baseline_index), 1) AS baseline_std, max(baseline_index) AS baseline_max FROM scored GROUP BY 1
""")
def d29(t: Tables):
    return A.score_summary(t.scores, ["severity_quadrant"])


@query("d30_lag_dominance", """
, p AS (SELECT avg(feat_disclosure_lag) FILTER (severity_quadrant <> 'UNREMARKABLE') AS f, avg(feat_disclosure_lag) FILTER (severity_quadrant = 'UNREMARKABLE') AS u FROM scored)
SELECT round(f, 6) AS flagged_lag, round(u, 6) AS unflagged_lag, round(f / u, 6) AS ratio FROM p
""")
def d30(t: Tables):
    return A.lag_dominance(t.scores).select(*[F.round(c, 6).alias(c) for c in ("flagged_lag", "unflagged_lag", "ratio")])


@query("d31_named_comparison", COMPARED_SQL + """
SELECT v.pattern, CAST(count(*) AS BIGINT) AS trades, count(*) FILTER (q1 <> 'UNREMARKABLE') AS flagged_v1, count(*) FILTER (q2 <> 'UNREMARKABLE') AS flagged_v2,
  round(avg(c1), 1) AS cohort_avg_v1, round(avg(c2), 1) AS cohort_avg_v2, round(avg(b1), 1) AS baseline_avg_v1, round(avg(b2), 1) AS baseline_avg_v2
FROM compared c JOIN politicians p ON p.id = c.politician_id_v2 JOIN (VALUES ('LastD'), ('FirstE'), ('nobody')) v(pattern) ON contains(lower(full_name), lower(v.pattern)) GROUP BY 1
""")
def d31(t: Tables):
    return A.named_comparison(compared(t), t.politicians, ["LastD", "FirstE", "nobody"])


@query("d32_describe", """
, u AS (SELECT unnest(['price', 'quantity', 'discount']) AS "column", unnest([l_extendedprice, l_quantity, l_discount]) AS x FROM lineitem)
SELECT "column", count(*) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, round(quantile_cont(x, 0.25), 6) AS p25,
  round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, max(x) AS max FROM u GROUP BY 1
""")
def d32(t: Tables):
    df = t.lineitem.select(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    out = A.describe(df, ["price", "quantity", "discount"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query("d33_median_of_real_values", """
SELECT CAST(floor(median(CASE WHEN feat_proximity_days < 60 THEN feat_proximity_days END)) AS INT) AS median_days FROM scored
""")
def d33(t: Tables):
    real = F.when(F.col("feat_proximity_days") < 60, F.col("feat_proximity_days"))
    counts = t.scores.groupBy(real.alias("d")).agg(F.count("*").alias("n_rows"))
    return counts.agg(F.floor(F.percentile("d", 0.5, F.col("n_rows"))).cast("int").alias("median_days"))


@query("d33_medians_by_person", """
SELECT politician_id, count(*) AS n, quantile_cont(amount_midpoint, 0.25) AS p25, quantile_cont(amount_midpoint, 0.5) AS median,
  quantile_cont(amount_midpoint, 0.9) AS p90 FROM trades WHERE amount_midpoint IS NOT NULL GROUP BY 1
""")
def d33_by_person(t: Tables):
    return grouped_percentiles(t.trades, ["politician_id"], "amount_midpoint", {"p25": 0.25, "median": 0.5, "p90": 0.9})


@query("d33_medians_by_ticker", """
SELECT ticker, trade_type, count(*) AS n, median(disclosure_lag_days) AS median_lag FROM trades WHERE disclosure_lag_days IS NOT NULL GROUP BY 1, 2
""")
def d33_by_ticker(t: Tables):
    return grouped_percentiles(t.trades, ["ticker", "trade_type"], "disclosure_lag_days", {"median_lag": 0.5})


@query("d34_position_sums", """
SELECT CAST(l_suppkey AS VARCHAR) AS cik, 'C' || l_partkey AS cusip, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INT) AS period, sum(l_quantity * 100) AS shares,
  min(translate(CAST(l_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ')) AS issuer_name FROM lineitem GROUP BY 1, 2, 3
""")
def d34(t: Tables):
    from ledgerlight.catalog.models import holdings
    from ledgerlight.plans.holdings import positions

    return positions(holdings(t), ["cik", "cusip"])


PROFILED = {
    "trades": "trade_id politician_id ticker trade_type trade_date disclosure_lag_days disclosure_date amount_midpoint amount_lower amount_upper industry_sector".split(),
    "bills": "bill_id bill_number title policy_area latest_action_date url".split(),
    "reports": "id trade_id headline narrative evidence_json disclaimer video_prompt narration_script citation_image_prompts model".split(),
}


@query("d35_null_profile", ", u AS (" + " UNION ALL ".join(
    f"""SELECT '{table}' AS "table", '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS total FROM {table}"""
    for table, columns in PROFILED.items() for c in columns
) + ")\nSELECT *, round(nulls * 100.0::DOUBLE / total, 1) AS null_pct FROM u")
def d35(t: Tables):
    """Every column of three tables, one pass over each."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [Q.null_profile(getattr(t, n).select(*columns), n) for n, columns in PROFILED.items()])


@query("d36_coverage", """
, cov AS (SELECT 'prices' AS source, translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS ticker FROM part WHERE p_size > 10
  UNION ALL SELECT 'map', translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') FROM part WHERE p_brand = 'Brand#1'),
g AS (SELECT ticker, count(*) AS n FROM trades GROUP BY 1), s AS (SELECT DISTINCT source FROM cov)
SELECT s.source, count(*) AS keys, count(c.ticker) AS covered, CAST(coalesce(sum(g.n) FILTER (c.ticker IS NULL), 0) AS BIGINT) AS rows_uncovered
FROM g CROSS JOIN s LEFT JOIN cov c ON c.ticker = g.ticker AND c.source = s.source GROUP BY 1
""")
def d36(t: Tables):
    part = t.part.withColumn("ticker", letters(F.col("p_partkey")))
    return Q.coverage(t.trades, "ticker", {
        "prices": part.withColumn("ticker", F.when(F.col("p_size") > 10, F.col("ticker"))),
        "map": part.withColumn("ticker", F.when(F.col("p_brand") == "Brand#1", F.col("ticker"))),
    })


@query("d37_bill_population", """
SELECT count(*) AS total, count(*) FILTER (policy_area <> '') AS has_policy_area, count(*) FILTER (url <> '') AS has_url, count(*) FILTER (title <> '') AS has_title FROM bills
""")
def d37(t: Tables):
    return Q.population(t.bills, ["policy_area", "url", "title"])


GATE_SQL = """
, n AS (SELECT count(*) AS total, count(*) FILTER (policy_area IS NULL) AS pa, count(*) FILTER (url IS NULL) AS u FROM bills)
SELECT 'bills' AS "table", 'policy_area' AS "column", total, pa AS nulls, round(pa::DOUBLE / total, 4) AS null_share, CASE WHEN total < 100 THEN 'warn' ELSE 'ok' END AS rows_verdict,
  CASE WHEN pa::DOUBLE / total > 0.5 THEN 'warn' ELSE 'ok' END AS nulls_verdict FROM n
UNION ALL SELECT 'bills', 'url', total, u, round(u::DOUBLE / total, 4), CASE WHEN total < 100000000 THEN 'warn' ELSE 'ok' END, CASE WHEN u::DOUBLE / total > 0.3 THEN 'warn' ELSE 'ok' END FROM n
"""


@query("d38_quality_gate", GATE_SQL)
def d38(t: Tables):
    return Q.quality_gate(t.bills, "bills", [("policy_area", 0.5, 100), ("url", 0.3, 100000000)])


@query("d38_gate_on_write", GATE_SQL)
def d38w(t: Tables):
    """The same verdicts from the job that writes the table."""
    table = K.VersionedTable(t.spark, scratch_path(t.spark, "gated"))
    return W.write_gated(t.bills, "bills", [("policy_area", 0.5, 100), ("url", 0.3, 100000000)], table.replace)


@query("d39_report_problems", """
, p AS (SELECT trade_id, concat_ws('; ',
  CASE WHEN length(headline) > 120 THEN 'headline too long (' || length(headline) || ' chars)' END, CASE WHEN coalesce(headline, '') = '' THEN 'missing headline' END,
  CASE WHEN coalesce(narrative, '') = '' THEN 'missing narrative' END,
  CASE WHEN coalesce(evidence_json, '{}') = '{}' THEN 'empty evidence_json' WHEN json_extract(evidence_json, '$.key_factors') IS NULL THEN 'no key_factors in evidence'
    WHEN json_extract(evidence_json, '$.score_driver') IS NULL THEN 'no score_driver in evidence' END,
  CASE WHEN coalesce(disclaimer, '') = '' THEN 'missing disclaimer' END,
  CASE WHEN severity_quadrant = 'SEVERE' AND coalesce(video_prompt, '') = '' THEN 'SEVERE but no video_prompt' END,
  CASE WHEN severity_quadrant = 'SEVERE' AND coalesce(narration_script, '') = '' THEN 'SEVERE but no narration_script' END) AS problems FROM reports)
SELECT trade_id, problems FROM p WHERE problems <> ''
""")
def d39(t: Tables):
    return Q.report_problems(t.reports).where(F.size("problems") > 0).select("trade_id", F.array_join("problems", "; ").alias("problems"))


@query("d39_report_summary", """
SELECT count(*) AS total, count(*) FILTER (severity_quadrant = 'SEVERE') AS severe, count(*) FILTER (severity_quadrant = 'SYSTEMIC') AS systemic,
  count(*) FILTER (length(headline) > 120) AS long_headlines, count(*) FILTER (narrative IS NULL) AS missing_narrative, count(*) FILTER (evidence_json IS NULL) AS missing_evidence,
  count(*) FILTER (disclaimer IS NULL) AS missing_disclaimer, count(*) FILTER (severity_quadrant = 'SEVERE' AND video_prompt IS NULL) AS severe_no_video,
  count(*) FILTER (severity_quadrant = 'SEVERE' AND narration_script IS NULL) AS severe_no_narration, count(*) FILTER (json_array_length(citation_image_prompts) > 0) AS with_bills,
  count(*) FILTER (coalesce(json_array_length(citation_image_prompts), 0) = 0) AS without_bills FROM reports
""")
def d39s(t: Tables):
    return Q.report_summary(t.reports)


@query("d39_media_field_gaps", """
SELECT severity_quadrant, count(*) AS total, count(video_prompt) AS has_video, count(*) - count(video_prompt) AS no_video, count(narration_script) AS has_narration,
  count(*) - count(narration_script) AS no_narration FROM reports GROUP BY 1
""")
def d39m(t: Tables):
    return Q.media_field_gaps(t.reports)


TOKENS = """count(*) AS n_reports, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt, CAST(sum(output_tokens) AS BIGINT) AS total_output, round(avg(prompt_tokens), 4) AS avg_prompt,
 round(avg(output_tokens), 4) AS avg_output, min(output_tokens) AS min_output, max(output_tokens) AS max_output FROM reports"""


@query("d40_tokens_by_model", f"SELECT model, {TOKENS} GROUP BY 1")
def d40(t: Tables):
    return Q.token_stats(t.reports, F.col("model"))


@query("d40_tokens_by_driver", f"SELECT evidence_json ->> '$.score_driver' AS driver, {TOKENS} WHERE evidence_json IS NOT NULL GROUP BY 1")
def d40d(t: Tables):
    return Q.token_stats(t.reports.where("evidence_json is not null"), F.get_json_object("evidence_json", "$.score_driver").alias("driver"))


@query("d41_access_matrix", "SELECT politician_id, sector, weight FROM access")
def d41(t: Tables):
    return E.access_matrix(E.seats(t.memberships, t.committees)).withColumn("weight", F.round("weight", 6))


IMPACT_SQL = """
, ex AS (SELECT trade_id, politician_id, unnest(sectors) AS sector FROM trades),
multi AS (SELECT trade_id, max(weight) AS w FROM ex JOIN access USING (politician_id, sector) GROUP BY 1),
single AS (SELECT t.trade_id, a.weight AS w FROM trades t JOIN access a ON a.politician_id = t.politician_id AND a.sector = t.industry_sector),
cr AS (SELECT t.trade_id, t.ticker, coalesce(s.w, 0) AS cr_single, round(coalesce(m.w, 0), 2) AS cr_multi FROM trades t LEFT JOIN multi m USING (trade_id) LEFT JOIN single s USING (trade_id))
"""


def impact(t: Tables):
    access = E.access_matrix(E.seats(t.memberships, t.committees))
    tagged = t.trades.withColumn("sectors", F.array("industry_sector"))
    single = E.add_relevance(tagged, access, "cr_single").drop("sectors")
    return E.add_relevance(single.withColumn("sectors", S.parse_sector("industry_sector")), access, "cr_multi")


@query("d42_relevance_impact", IMPACT_SQL + """
SELECT count(*) AS trades, count(*) FILTER (cr_single > 0) AS single_nonzero, count(*) FILTER (cr_multi > 0) AS multi_nonzero, count(*) FILTER (cr_multi > 0 AND cr_single = 0) AS gained,
  count(*) FILTER (cr_multi > cr_single AND cr_single > 0) AS improved, round(avg(cr_single), 4) AS mean_single, round(avg(cr_multi), 4) AS mean_multi,
  round(stddev_samp(cr_single), 4) AS std_single, round(stddev_samp(cr_multi), 4) AS std_multi, round((var_samp(cr_multi) / var_samp(cr_single) - 1) * 100, 1) AS variance_gain_pct,
  count(*) FILTER (cr_multi > 0) - count(*) FILTER (cr_single > 0) AS net FROM cr
""")
def d42(t: Tables):
    return A.relevance_impact(impact(t))


@query("d42_top_gaining_tickers", IMPACT_SQL + """
SELECT ticker, count(*) AS n FROM cr WHERE cr_multi > 0 AND cr_single = 0 GROUP BY 1 ORDER BY n DESC, ticker LIMIT 15
""")
def d42t(t: Tables):
    return A.top_gaining_tickers(impact(t))


def bridge(t: Tables):
    return add_sectors(t.trades, mode="load").select("trade_id", F.explode("sectors").alias("sector"))


@query("d43_bridge_distribution", "SELECT sector, count(*) AS n FROM (SELECT unnest(sectors) AS sector FROM trades) GROUP BY 1")
def d43(t: Tables):
    return A.bridge_distribution(bridge(t))


@query("d43_multi_sector_trades", "SELECT trade_id, array_to_string(list_sort(sectors), ',') AS sectors FROM trades WHERE len(sectors) > 1")
def d43m(t: Tables):
    return A.multi_sector_trades(bridge(t))


@query("d44_amount_buckets", """
SELECT CASE WHEN amount_midpoint <= 15000 THEN 'A_lt15K' WHEN amount_midpoint <= 50000 THEN 'B_15K-50K' WHEN amount_midpoint <= 250000 THEN 'C_50K-250K'
  WHEN amount_midpoint <= 1000000 THEN 'D_250K-1M' ELSE 'E_1M+' END AS bucket, count(*) AS n FROM trades GROUP BY 1
""")
def d44(t: Tables):
    return A.amount_buckets(t.trades)


@query("d44_date_range", "SELECT min(trade_date) AS first_date, max(trade_date) AS last_date FROM trades WHERE trade_date BETWEEN '1996-01-01' AND '2000-12-31'")
def d44r(t: Tables):
    return A.date_range(t.trades, "1996-01-01", "2000-12-31")


@query("d44_trader_depth", """
SELECT count(*) FILTER (c >= 45) AS enough, count(*) FILTER (c < 45) AS too_few FROM (SELECT o_custkey, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
""")
def d44d(t: Tables):
    trades = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("politician_id"))
    return A.trader_depth(trades, 45)


@query("d45_flagged_quadrant_sector", "SELECT severity_quadrant, industry_sector, count(*) AS n FROM flagged GROUP BY 1, 2")
def d45(t: Tables):
    return A.flagged_quadrant_sector(t.scored)


@query("d45_bills_by_area", "SELECT policy_area, count(*) AS n FROM bills WHERE policy_area <> '' GROUP BY 1")
def d45b(t: Tables):
    return A.bills_by_area(t.bills)


@query("d46_untagged_committees", "SELECT name FROM committees WHERE sector_tag IS NULL")
def d46(t: Tables):
    return Q.untagged_committees(t.committees)


@query("d46_tickers_without_sector", "SELECT ticker, count(*) AS n_trades FROM trades WHERE industry_sector IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def d46s(t: Tables):
    return Q.tickers_without_sector(t.trades)


@query("d46_tickers_without_price", """
SELECT ticker, count(*) AS n_trades, min(trade_date) AS first_date, max(trade_date) AS last_date FROM trades
WHERE ticker NOT IN (SELECT translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') FROM part WHERE p_size > 10) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25
""")
def d46p(t: Tables):
    return Q.tickers_without_price(t.trades, t.part.select(F.when(F.col("p_size") > 10, letters(F.col("p_partkey"))).alias("ticker")))


@query("d46_bridge_coverage", """
SELECT count(*) AS trades, count(*) FILTER (line_number > 3) AS in_bridge, count(*) FILTER (line_number > 3 AND industry_sector IS NULL) AS bridge_only FROM trades
""")
def d46b(t: Tables):
    linked = t.lineitem.select(F.when(F.col("l_linenumber") > 3, trade_key()).alias("trade_id"))
    return Q.bridge_coverage(t.trades, linked)


@query("d47_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def d47(t: Tables):
    return Q.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("d48_row_counts", """
, c AS (SELECT 'region' AS "table", count(*) AS n_rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'conversations', count(*) FROM conversations)
SELECT * FROM c UNION ALL SELECT 'TOTAL', CAST(sum(n_rows) AS BIGINT) FROM c
""")
def d48(t: Tables):
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    return Q.row_counts({n: getattr(t, n) for n in names})


@query("d49_tickers_by_sector", """
SELECT p_brand AS sector, translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS ticker, count(*) OVER (PARTITION BY p_brand) AS n FROM part
""")
def d49(t: Tables):
    return A.tickers_by_sector(t.part.select(F.col("p_brand").alias("sector"), letters(F.col("p_partkey")).alias("ticker")))


@query("d50_quadrant_counts", "SELECT severity_quadrant, count(*) AS n FROM scored GROUP BY 1 UNION ALL SELECT 'FLAGGED', count(*) FROM flagged")
def d50(t: Tables):
    return A.quadrant_counts(t.scores)
