"""Windows (E), sorted and paged reads (F), set operations (G)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlight.catalog.base import Tables, letters, query
from ledgerlight.operators import entity as E
from ledgerlight.operators import merge as M
from ledgerlight.operators import quality as Q
from ledgerlight.operators import ranking as R
from ledgerlight.operators.clean import merge_chambers
from ledgerlight.streaming import incremental as I


@query("e01_share_of_total", """
SELECT ticker[1:1] AS letter, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM trades GROUP BY 1
""")
def e01(t: Tables):
    grouped = t.trades.groupBy(F.left("ticker", F.lit(1)).alias("letter")).agg(F.count("*").alias("n"))
    return grouped.withColumn("pct", Q.share_pct(F.col("n"), F.sum("n").over(Window.partitionBy())))


@query("e02_range_frame_peers", """
SELECT DISTINCT a.ticker, a.trade_date, (SELECT count(DISTINCT b.politician_id) FROM trades b WHERE b.ticker = a.ticker AND b.trade_date BETWEEN a.trade_date - 90 AND a.trade_date + 90) AS peers FROM trades a
""")
def e02(t: Tables):
    from ledgerlight.operators.temporal import peer_lookup, tasks_for

    return peer_lookup(t.trades, "ticker", "politician_id", "trade_date", 90, tasks_for(t.trades)).select("ticker", "trade_date", "peers")


@query("e03_keep_latest", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) = 1
""")
def e03(t: Tables):
    order = [F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_extendedprice"]
    return M.keep_first(t.lineitem, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")


@query("e04_latest_ready_video", """
SELECT trade_id, id, storage_url FROM media WHERE asset_type = 'video' AND generation_status = 'ready'
QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY generated_at DESC, id DESC) = 1
""")
def e04(t: Tables):
    return R.latest_ready_asset(t.media)


@query("e05_first_ready_citations", """
SELECT trade_id, id, storage_url, CAST(row_number() OVER (PARTITION BY trade_id ORDER BY generated_at, id) AS INT) AS position FROM media
WHERE asset_type = 'citation_image' AND generation_status = 'ready' QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY generated_at, id) <= 3
""")
def e05(t: Tables):
    return R.first_ready_assets(t.media).select("trade_id", "id", "storage_url", "position")


@query("e06_closest_events", """
, c AS (SELECT user_id, event_id AS click_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'click'),
p AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'),
r AS (SELECT p.event_id, c.click_id, abs(c.d - p.d) AS gap FROM p JOIN c ON c.user_id = p.user_id AND abs(c.d - p.d) <= 90
  QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(c.d - p.d), c.click_id) <= 3)
SELECT p.event_id, coalesce(string_agg(click_id || ':' || gap, ',' ORDER BY gap, click_id), '') AS nearest FROM p LEFT JOIN r USING (event_id) GROUP BY 1
""")
def e06(t: Tables):
    from ledgerlight.operators.temporal import nearest_k_by

    rows = t.events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    left = rows.where("event_type = 'purchase'").select("event_id", "user_id", "day")
    clicks = rows.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "day")
    near = nearest_k_by(left, clicks, "user_id", "day", "click_id", max_days=90)
    text = F.array_join(F.transform("nearby", lambda e: F.concat_ws(":", e["click_id"], e["gap_days"])), ",")
    return near.select("event_id", F.coalesce(text, F.lit("")).alias("nearest"))


@query("e07_fill_forward", """
, d AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, max(CASE WHEN l_linenumber = 1 THEN l_tax END) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, day, last_value(v IGNORE NULLS) OVER (PARTITION BY l_partkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM d
""")
def e07(t: Tables):
    from ledgerlight.operators.temporal import asof_lookup

    rows = t.lineitem.select("l_partkey", F.to_date("l_shipdate").alias("day"), F.when(F.col("l_linenumber") == 1, F.col("l_tax")).alias("filled"))
    return asof_lookup(rows.drop("filled"), rows, "l_partkey", "day", "filled", "backward").select("l_partkey", "day", "filled")


BOARD = "greatest(cohort_index, baseline_index)"


@query("f01_leaderboard", f"""
SELECT trade_id, ticker, full_name, party, {BOARD} AS max_index FROM (SELECT * FROM scored WHERE severity_quadrant = 'SYSTEMIC' ORDER BY {BOARD} DESC, trade_date DESC, trade_id LIMIT 50 OFFSET 20) s
LEFT JOIN politicians p ON p.id = s.politician_id
""")
def f01(t: Tables):
    return R.leaderboard(t.scored, t.politicians, "systemic", 50, 20).select("trade_id", "ticker", "full_name", "party", "max_index")


@query("f01_leaderboard_total", "SELECT count(*) AS total FROM scored WHERE severity_quadrant = 'SYSTEMIC'")
def f01t(t: Tables):
    return R.leaderboard_total(t.scored, "SYSTEMIC")


@query("f02_list_people", "SELECT * FROM politicians WHERE lower(full_name) LIKE '%b%' OR lower(bioguide_id) LIKE '%b%' OR lower(state) LIKE '%b%' ORDER BY full_name, id LIMIT 10 OFFSET 5")
def f02(t: Tables):
    return R.list_people(t.politicians, "B", 10, 5)


@query("f02_list_people_total", "SELECT count(*) AS total FROM politicians WHERE lower(full_name) LIKE '%nation_1%' OR lower(bioguide_id) LIKE '%nation_1%' OR lower(state) LIKE '%nation_1%'")
def f02t(t: Tables):
    return R.list_people_total(t.politicians, "NATION_1")


@query("f03_recent_trades", f"""
SELECT trade_id, trade_date, ticker, {BOARD} AS max_index FROM scored WHERE politician_id = 7 ORDER BY trade_date DESC, trade_id LIMIT 50
""")
def f03(t: Tables):
    return R.recent_trades(t.scored, t.politicians, "7").select("trade_id", "trade_date", "ticker", "max_index")


@query("f03_recent_trades_by_key", "SELECT trade_id, trade_date FROM scored WHERE politician_id = 12 ORDER BY trade_date DESC, trade_id LIMIT 20")
def f03k(t: Tables):
    return R.recent_trades(t.scored, t.politicians, "Supplier#000000012", 20).select("trade_id", "trade_date")


@query("f04_top_combined", "SELECT trade_id, cohort_index + baseline_index AS combined_score FROM scored ORDER BY 2 DESC, 1 LIMIT 20")
def f04(t: Tables):
    return R.top_combined(t.scores).select("trade_id", "combined_score")


@query("f05_severe_first", f"""
SELECT trade_id, severity_quadrant FROM scored ORDER BY array_position(['SEVERE', 'SYSTEMIC', 'OUTLIER', 'UNREMARKABLE'], severity_quadrant), {BOARD} DESC, trade_id LIMIT 40
""")
def f05(t: Tables):
    return R.severe_first(t.scored, 40).select("trade_id", "severity_quadrant")


@query("f06_extreme_alpha", """
SELECT trade_id, full_name, round(feat_cohort_alpha * 100, 1) AS alpha_pct FROM (SELECT * FROM scored WHERE abs(feat_cohort_alpha) > 0.15 ORDER BY abs(feat_cohort_alpha) DESC, trade_id LIMIT 20) s
LEFT JOIN politicians p ON p.id = s.politician_id
""")
def f06(t: Tables):
    return R.extreme_alpha(t.scored, t.politicians).select("trade_id", "full_name", "alpha_pct")


@query("f07_late_filers", """
SELECT trade_id, chamber, disclosure_lag_days FROM (SELECT * FROM scored WHERE disclosure_lag_days > 45 ORDER BY disclosure_lag_days DESC, trade_id LIMIT 20) s
LEFT JOIN politicians p ON p.id = s.politician_id
""")
def f07(t: Tables):
    return R.late_filers(t.scored, t.politicians).select("trade_id", "chamber", "disclosure_lag_days")


@query("f08_case_by_name", """
SELECT trade_id, full_name, ticker, round(feat_cohort_alpha, 3) AS alpha_30d FROM flagged f JOIN politicians p ON p.id = f.politician_id
WHERE full_name ILIKE '%LastBB%' ORDER BY baseline_index DESC, trade_id
""")
def f08(t: Tables):
    return R.case_trades(t.scored, t.politicians, name="lastbb", quadrants=["SEVERE", "SYSTEMIC"], order="baseline_index").select(
        "trade_id", "full_name", "ticker", "alpha_30d")


@query("f08_case_by_ticker_dates", """
SELECT trade_id, full_name, party FROM scored f JOIN politicians p ON p.id = f.politician_id
WHERE ticker = 'BCD' AND trade_date BETWEEN '1997-01-01' AND '1999-12-31'
""")
def f08t(t: Tables):
    return R.case_trades(t.scored, t.politicians, ticker="bcd", since="1997-01-01", until="1999-12-31").select("trade_id", "full_name", "party")


@query("f08_case_limited", """
SELECT trade_id, baseline_index FROM flagged f JOIN politicians p ON p.id = f.politician_id WHERE contains(lower(full_name), 'firstc') ORDER BY baseline_index DESC, trade_id LIMIT 20
""")
def f08l(t: Tables):
    return R.case_trades(t.scored, t.politicians, name="FirstC", quadrants=["SEVERE", "SYSTEMIC"], order="baseline_index", limit=20).select(
        "trade_id", "baseline_index")


OVERLAP = """
, m AS (SELECT politician_id, string_agg(DISTINCT c.name, '; ' ORDER BY c.name) AS committees FROM memberships m JOIN committees c ON c.id = m.committee_id GROUP BY 1)
"""


@query("f09_committee_overlap", OVERLAP + """
SELECT trade_id, full_name, committees FROM (SELECT * FROM flagged WHERE feat_committee_relevance > 0 ORDER BY feat_committee_relevance DESC, cohort_index + baseline_index DESC, trade_id LIMIT 20) f
LEFT JOIN politicians p ON p.id = f.politician_id LEFT JOIN m ON m.politician_id = f.politician_id
""")
def f09(t: Tables):
    return R.committee_overlap(t.scored, t.politicians, E.seats(t.memberships, t.committees)).select("trade_id", "full_name", "committees")


@query("f09_committee_overlap_sector", OVERLAP + """
SELECT trade_id, full_name, committees FROM flagged f LEFT JOIN politicians p ON p.id = f.politician_id LEFT JOIN m ON m.politician_id = f.politician_id
WHERE feat_committee_relevance >= 0.7 AND industry_sector = 'healthcare'
""")
def f09s(t: Tables):
    seats = E.seats(t.memberships, t.committees)
    return R.committee_overlap(t.scored, t.politicians, seats, 0.7, True, "healthcare", None).select("trade_id", "full_name", "committees")


@query("f10_media_queue", f"""
SELECT s.trade_id, r.id AS audit_report_id, {BOARD} AS max_index FROM scored s JOIN reports r USING (trade_id)
WHERE s.severity_quadrant = 'SEVERE' AND video_prompt IS NOT NULL AND narration_script IS NOT NULL ORDER BY 3 DESC, 1 LIMIT 100
""")
def f10(t: Tables):
    return R.media_queue(t.scored, t.reports).select("trade_id", "audit_report_id", "max_index")


def daily(t: Tables):
    return t.orders.groupBy(F.to_date("o_orderdate").alias("report_date")).agg(F.count("*").alias("n_trades"))


@query("f11_latest_report", "SELECT CAST(o_orderdate AS DATE) AS report_date, count(*) AS n_trades FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 1")
def f11(t: Tables):
    return R.latest_report(daily(t))


@query("f11_report_of_day", "SELECT CAST(o_orderdate AS DATE) AS report_date, count(*) AS n_trades FROM orders WHERE CAST(o_orderdate AS DATE) = '1998-03-03' GROUP BY 1")
def f11d(t: Tables):
    return R.report_of(daily(t), "1998-03-03")


@query("f12_price_series", "SELECT price_date, close FROM prices WHERE ticker = 'SPY' AND price_date >= '1996-01-01' ORDER BY price_date LIMIT 200")
def f12(t: Tables):
    return R.price_series(t.prices, "spy", since="1996-01-01")


@query("f13_top_contributors", """
SELECT committee_id, contributor_name, total FROM (SELECT c_nationkey AS committee_id, c_name AS contributor_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY committee_id ORDER BY total DESC, contributor_name) <= 200
""")
def f13(t: Tables):
    paid = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("committee_id"), F.col("c_name").alias("contributor_name"), F.col("o_totalprice").cast("decimal(15,2)").alias("amount"))
    return R.top_contributors(paid).withColumn("total", F.col("total").cast("double"))


@query("g01_union_chambers", """
, u AS (SELECT politician_id::VARCHAR AS politician_id, ticker, trade_date, trade_type, 'House' AS chamber FROM trades WHERE line_number <= 4
 UNION ALL SELECT politician_id::VARCHAR, ticker, trade_date, trade_type, 'Senate' FROM trades WHERE line_number >= 4)
SELECT politician_id, ticker, trade_date, trade_type, min(chamber) AS chamber FROM u WHERE ticker NOT IN ('CS', 'OT', 'ST', 'HN', 'PS', 'CT', 'OI') GROUP BY 1, 2, 3, 4
""")
def g01(t: Tables):
    line = F.split("trade_id", "-").getItem(1).cast("int")
    rows = t.trades.select(
        F.col("politician_id").cast("string").alias("politician_name"), "ticker", "trade_date", "trade_type", line.alias("line"))
    house = rows.where("line <= 4").withColumn("chamber", F.lit("House")).drop("line")
    senate = rows.where("line >= 4").withColumns({"chamber": F.lit("Senate"), "doc_id": F.lit("")}).drop("line")
    return merge_chambers([house, senate]).select("politician_id", "ticker", "trade_date", "trade_type", "chamber")


@query("g02_union_positions", """
SELECT user_id AS politician_id, event_id AS vote_id, 'yes' AS position FROM events UNION ALL SELECT o_custkey, o_orderkey, 'no' FROM orders
""")
def g02(t: Tables):
    first = t.events.select(F.col("user_id").alias("politician_id"), F.col("event_id").alias("vote_id"), F.lit("yes").alias("position"))
    second = t.orders.select(F.col("o_orderkey").alias("vote_id"), F.col("o_custkey").alias("politician_id"), F.lit("no").alias("position"))
    return M.union_aligned([first, second])


@query("g03_union_of_samples", """
(SELECT trade_id, severity_quadrant FROM reports WHERE severity_quadrant = 'SEVERE' ORDER BY id LIMIT 1)
UNION ALL (SELECT trade_id, severity_quadrant FROM reports WHERE severity_quadrant = 'SYSTEMIC' ORDER BY id DESC LIMIT 4)
""")
def g03(t: Tables):
    first = t.reports.where("severity_quadrant = 'SEVERE'").orderBy("id").limit(1)
    second = t.reports.where("severity_quadrant = 'SYSTEMIC'").orderBy(F.desc("id")).limit(4)
    return M.union_aligned([d.select("trade_id", "severity_quadrant") for d in (first, second)])


def _cusips(t: Tables):
    return t.lineitem.select(F.concat(F.lit(" CU"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lit("X0 ")).alias("cusip"))


def _mapping(t: Tables):
    return t.part.where("p_size > 20").select(F.concat(F.lit("CU"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("X")).alias("cusip")).distinct()


CUSIPS = """
, w AS (SELECT DISTINCT 'CU' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || 'X' AS cusip FROM lineitem),
k AS (SELECT DISTINCT 'CU' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || 'X' AS cusip FROM part WHERE p_size > 20)
"""


@query("g04_unmapped_keys", CUSIPS + "SELECT cusip FROM w EXCEPT SELECT cusip FROM k")
def g04(t: Tables):
    return I.unmapped_cusips(_cusips(t), _mapping(t))


@query("g05_mapped_keys", CUSIPS + "SELECT cusip FROM w INTERSECT SELECT cusip FROM k")
def g05(t: Tables):
    return I.mapped_cusips(_cusips(t), _mapping(t))


@query("g06_distinct_keys", CUSIPS + "SELECT cusip AS k1, NULL::DATE AS k2 FROM w UNION ALL SELECT DISTINCT ticker, trade_date FROM trades")
def g06(t: Tables):
    pairs = t.trades.select(F.col("ticker").alias("k1"), F.col("trade_date").alias("k2")).distinct()
    return I.cusips_of(_cusips(t)).select(F.col("cusip").alias("k1"), F.lit(None).cast("date").alias("k2")).unionByName(pairs)


@query("g07_map_precedence", """
, b AS (SELECT p_partkey AS k, p_type AS v FROM part WHERE p_size <= 30), o AS (SELECT p_partkey AS k, 'override' AS v FROM part WHERE p_size <= 10),
a AS (SELECT p_partkey AS k, 'added' AS v FROM part WHERE p_size >= 25)
SELECT k, coalesce(o.v, b.v, a.v) AS v FROM b FULL JOIN o USING (k) FULL JOIN a USING (k)
""")
def g07(t: Tables):
    base = t.part.where("p_size <= 30").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("v"))
    over = t.part.where("p_size <= 10").select(F.col("p_partkey").alias("k"), F.lit("override").alias("v"))
    more = t.part.where("p_size >= 25").select(F.col("p_partkey").alias("k"), F.lit("added").alias("v"))
    return M.merge_maps([over, base, more], ["k"])
