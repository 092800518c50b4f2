"""Evidence reports (J)."""

from pyspark.sql import functions as F

from ledgerlight.catalog.base import Tables, query, trade_key
from ledgerlight.plans import reports as P


def trade_media(t: Tables):
    """Two files for every trade of an even order."""
    key = trade_key()
    return t.lineitem.where("l_orderkey % 2 = 0").select(
        key.alias("trade_id"), F.explode(F.array(F.lit("video"), F.lit("audio"))).alias("asset_type"), F.col("l_shipdate").alias("generated_at")
    ).select(F.concat_ws(":", "trade_id", "asset_type").alias("id"), "trade_id", "asset_type", "generated_at", F.lit("s3://m").alias("storage_url"), F.lit("ready").alias("generation_status"))


@query("j01_trade_dossiers", """
SELECT t.trade_id, p.full_name, t.cohort_index, array_to_string(t.sectors, ',') AS sectors, r.headline, r.id IS NOT NULL AS has_report,
  CASE WHEN CAST(split_part(t.trade_id, '-', 1) AS BIGINT) % 2 = 0 THEN 2 ELSE 0 END AS n_media, CASE WHEN CAST(split_part(t.trade_id, '-', 1) AS BIGINT) % 2 = 0 THEN 'video,audio' ELSE '' END AS media
FROM scored t LEFT JOIN politicians p ON p.id = t.politician_id LEFT JOIN reports r USING (trade_id)
""")
def j01(t: Tables):
    out = P.trade_dossiers(t.trades, t.scores, t.politicians, t.reports, trade_media(t))
    media = F.array_join(F.transform("media_assets", lambda m: m["asset_type"]), ",")
    return out.select(
        "trade_id", "full_name", "cohort_index", F.array_join("sectors", ",").alias("sectors"), F.col("audit_report.headline").alias("headline"),
        F.col("audit_report").isNotNull().alias("has_report"), F.col("n_media").cast("int").alias("n_media"), F.coalesce(media, F.lit("")).alias("media"))


@query("j02_person_dossiers", """
, latest AS (SELECT politician_id, string_agg(trade_id, ',' ORDER BY trade_date DESC, trade_id DESC) AS trades, count(r_id) AS n_reports FROM
  (SELECT s.politician_id, s.trade_id, s.trade_date, r.id AS r_id FROM scored s LEFT JOIN reports r USING (trade_id) QUALIFY row_number() OVER (PARTITION BY s.politician_id ORDER BY s.trade_date DESC, s.trade_id) <= 50) GROUP BY 1)
SELECT p.id, p.full_name, count(*) AS total_trades, count(*) FILTER (severity_quadrant = 'SEVERE') AS severe_count, round(avg(cohort_index), 2) AS avg_cohort, any_value(l.trades) AS trades, any_value(l.n_reports) AS n_reports
FROM politicians p JOIN scored s ON s.politician_id = p.id JOIN latest l ON l.politician_id = p.id GROUP BY 1, 2
""")
def j02(t: Tables):
    out = P.person_dossiers(t.politicians, t.trades, t.scores, t.reports)
    ids = F.array_join(F.transform("trades", lambda x: x["trade_id"]), ",")
    told = F.size(F.filter("trades", lambda x: x["audit_report_id"].isNotNull())).cast("long")
    return out.select("id", "full_name", "total_trades", "severe_count", "avg_cohort", ids.alias("trades"), told.alias("n_reports"))


@query("j03_evidence_packets", """
, keys AS (SELECT DISTINCT sectors, trade_date FROM trades),
ranked AS (SELECT k.sectors, k.trade_date, b.bill_id, b.title, b.policy_area, b.latest_action_date, b.url, row_number() OVER (PARTITION BY k.sectors, k.trade_date ORDER BY abs(b.latest_action_date - k.trade_date), b.bill_id) AS rn
  FROM keys k JOIN bills b ON list_contains(k.sectors, b.sector) AND b.latest_action_date BETWEEN k.trade_date - 90 AND k.trade_date + 90),
best AS (SELECT sectors, trade_date, string_agg('  - ' || bill_id || ': ' || title || chr(10) || '    Policy Area: ' || policy_area || chr(10) || '    Action Date: ' || latest_action_date || chr(10) || '    URL: ' || coalesce(url, 'N/A'), chr(10) ORDER BY rn) AS lines FROM ranked WHERE rn <= 3 GROUP BY 1, 2)
SELECT s.trade_id, 'Politician: ' || p.full_name || ' (' || p.bioguide_id || ')' || chr(10) || 'Ticker: ' || s.ticker || chr(10) || 'Trade Type: ' || trade_type || chr(10) || 'Trade Date: ' || s.trade_date || chr(10) || 'Disclosure Date: ' || disclosure_date || chr(10)
  || 'Disclosure Lag Days: ' || disclosure_lag_days || chr(10) || 'Amount Midpoint: ' || amount_midpoint || chr(10) || 'Industry Sector: ' || CASE WHEN len(s.sectors) > 0 THEN array_to_string(s.sectors, ', ') ELSE 'None' END || chr(10) || chr(10)
  || 'Cohort Index: ' || cohort_index || chr(10) || 'Baseline Index: ' || baseline_index || chr(10) || 'Severity Quadrant: ' || severity_quadrant AS head, coalesce(best.lines, '') AS bills
FROM scored s JOIN politicians p ON p.id = s.politician_id LEFT JOIN best ON best.sectors = s.sectors AND best.trade_date = s.trade_date
""")
def j03(t: Tables):
    out = P.evidence_packets(t.scored, t.politicians, t.bills)
    head = F.substring_index("prompt", "\n\nFeature Snapshot", 1)
    bills = F.regexp_extract("prompt", r"(?s)±90 days\):\n(.*)\n$", 1)
    return out.select("trade_id", head.alias("head"), bills.alias("bills"))


@query("j04_rule_reports", """
SELECT trade_id, ticker || ' trade flagged as ' || lower(severity_quadrant) || ' by dual-model analysis' AS headline, CASE severity_quadrant WHEN 'SEVERE' THEN 'very_high' WHEN 'SYSTEMIC' THEN 'high' WHEN 'OUTLIER' THEN 'medium' ELSE 'low' END AS risk_level,
  'This trade received cohort index ' || cohort_index || ' and baseline index ' || baseline_index || ', placing it in the ' || severity_quadrant || ' quadrant. The score reflects statistical anomaly features, not proof of wrongdoing.' AS narrative,
  CASE WHEN severity_quadrant = 'SEVERE' THEN 'both' ELSE 'baseline' END AS score_driver, 'proximity_days=' || feat_proximity_days AS factor,
  CASE WHEN severity_quadrant = 'SEVERE' THEN 'Desk X flagged a ' || ticker || ' trade in the SEVERE quadrant based on dual-model anomaly signals.' END AS narration_script FROM scored
""")
def j04(t: Tables):
    out = P.rule_reports(t.scored, brand="Desk X")
    return out.select(
        "trade_id", "headline", "risk_level", "narrative", F.get_json_object("evidence_json", "$.score_driver").alias("score_driver"),
        F.get_json_object("evidence_json", "$.key_factors[2]").alias("factor"), "narration_script")


@query("j04_report_defaults", """
SELECT r.trade_id, coalesce(headline, 'Automated audit report') AS headline, coalesce(narrative, 'No narrative generated.') AS narrative, coalesce(disclaimer, 'Automated analysis; interpret with caution.') AS disclaimer, coalesce(evidence_json, '{}') AS evidence_json,
  CASE WHEN r.severity_quadrant = 'SEVERE' THEN coalesce(narration_script, 'The desk flagged a ' || ticker || ' trade in the SEVERE quadrant based on dual-model anomaly signals.') END AS narration_script,
  CASE r.severity_quadrant WHEN 'SEVERE' THEN 'very_high' ELSE 'high' END AS risk_level FROM reports r JOIN trades USING (trade_id)
""")
def j04d(t: Tables):
    return P.fill_report_defaults(t.reports.where(F.col("trade_id").isNotNull()).withColumn("risk_level", F.lit(None).cast("string")), t.scored).select(
        "trade_id", "headline", "narrative", "disclaimer", "evidence_json", "narration_script", "risk_level")


@query("j05_daily_digests", """
, r AS (SELECT f.*, p.full_name, row_number() OVER (PARTITION BY trade_date ORDER BY greatest(cohort_index, baseline_index) DESC, trade_id) AS rn FROM flagged f LEFT JOIN politicians p ON p.id = f.politician_id)
SELECT trade_date AS report_date, count(*) AS n_trades, 'This is The desk for ' || trade_date || '. Today''s highest-risk activity includes ' || string_agg(full_name || ' ' || trade_type || ' ' || ticker || ' (' || severity_quadrant || ')', '; ' ORDER BY rn) FILTER (rn <= 3)
  || '. These flags are statistical anomalies for public-interest review and not proof of misconduct.' AS narration_script, '""" + P.DIGEST_PROMPT.replace("'", "''") + """' AS video_prompt, 'pending' AS generation_status FROM r GROUP BY 1
""")
def j05(t: Tables):
    return P.daily_digests(t.scored, t.politicians)


@query("j05_digest_members", "SELECT trade_date AS report_date, trade_id, greatest(cohort_index, baseline_index) AS max_index FROM flagged")
def j05m(t: Tables):
    return P.digest_members(t.scored)


@query("j05_covered_ids", """
SELECT trade_date AS report_date, count(*) AS n_trades, string_agg(trade_id, ',' ORDER BY greatest(cohort_index, baseline_index) DESC, trade_id) AS trade_ids_covered FROM flagged GROUP BY 1
""")
def j05c(t: Tables):
    """The ids a day's digest covers, highest index first."""
    listed = P.with_covered_ids(P.daily_digests(t.scored, t.politicians), P.digest_members(t.scored))
    return listed.select("report_date", "n_trades", F.array_join("trade_ids_covered", ",").alias("trade_ids_covered"))


@query("j05_quiet_digests", """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS report_date, 'This is The desk for ' || CAST(o_orderdate AS DATE) || '. No SEVERE or SYSTEMIC trades were recorded today.' AS narration_script FROM orders
WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT trade_date FROM scored WHERE severity_quadrant = 'SEVERE' AND line_number = 1)
""")
def j05q(t: Tables):
    few = t.scored.where((F.col("severity_quadrant") == "SEVERE") & (F.split("trade_id", "-").getItem(1) == "1"))
    digests = P.daily_digests(few, t.politicians)
    days = t.orders.select(F.to_date("o_orderdate").alias("report_date"))
    return P.quiet_digest(days, digests).select("report_date", "narration_script")


@query("j06_report_queue", """
SELECT trade_id, severity_quadrant FROM flagged WHERE trade_date >= '1997-01-01' AND trade_id NOT IN (SELECT trade_id FROM reports WHERE trade_id IS NOT NULL)
ORDER BY CASE severity_quadrant WHEN 'SEVERE' THEN 1 ELSE 2 END, greatest(cohort_index, baseline_index) DESC, trade_id LIMIT 100
""")
def j06(t: Tables):
    return P.report_queue(t.scored, t.reports, 100, since="1997-01-01").select("trade_id", "severity_quadrant")


@query("j07_readiness", """
SELECT s.trade_id, coalesce(video_prompt IS NOT NULL AND narration_script IS NOT NULL, false) AS has_media, CAST(length(video_prompt) AS INT) AS video_prompt_length, CAST(length(narration_script) AS INT) AS narration_length, left(narration_script, 200) AS narration_preview
FROM scored s LEFT JOIN reports r USING (trade_id) WHERE s.severity_quadrant = 'SEVERE'
""")
def j07(t: Tables):
    return P.readiness(t.scored, t.reports).select("trade_id", "has_media", "video_prompt_length", "narration_length", "narration_preview")
