"""Cleaning pipelines and filters (B)."""

from pyspark.sql import functions as F

from ledgerlight.catalog.base import Tables, query
from ledgerlight.operators import clean as C
from ledgerlight.operators import merge as M
from ledgerlight.operators import metrics as W
from ledgerlight.session import scratch_path
from ledgerlight.sources import sinks as K

DEDUP = "QUALIFY row_number() OVER (PARTITION BY politician_id, ticker, trade_date, trade_type ORDER BY trade_id, disclosure_lag_days, disclosure_date, amount_midpoint) = 1"


@query("b01_clean_trades", f"""
SELECT trade_id, politician_id, ticker, trade_date, trade_type FROM trades
WHERE regexp_full_match(ticker, '[A-Z]{{1,5}}') AND trade_date IS NOT NULL AND disclosure_date IS NOT NULL AND disclosure_lag_days BETWEEN 0 AND 365 {DEDUP}
""")
def b01(t: Tables):
    return C.clean_trades(t.trades).select("trade_id", "politician_id", "ticker", "trade_date", "trade_type")


@query("b02_clean_inferred", """
SELECT politician_id AS cik, ticker, trade_date AS inferred_date, trade_type, min(amount_midpoint // 100) AS shares_delta FROM trades
WHERE amount_midpoint // 100 >= 100 AND regexp_full_match(ticker, '[A-Z]{1,5}') GROUP BY 1, 2, 3, 4
""")
def b02(t: Tables):
    rows = t.trades.select(
        F.col("politician_id").alias("cik"), "ticker", F.col("trade_date").alias("inferred_date"), "trade_type",
        F.floor(F.col("amount_midpoint") / 100).cast("long").alias("shares_delta"))
    return C.clean_inferred_trades(rows)


@query("b03_drop_artifacts", """
, x AS (SELECT trade_id, CASE line_number WHEN 1 THEN 'cs' WHEN 2 THEN 'ST' WHEN 3 THEN NULL ELSE ticker END AS ticker FROM trades)
SELECT * FROM x WHERE ticker IS NULL OR upper(ticker) NOT IN ('CS', 'OT', 'ST', 'HN', 'PS', 'CT', 'OI')
""")
def b03(t: Tables):
    line = F.split("trade_id", "-").getItem(1)
    ticker = F.when(line == "1", "cs").when(line == "2", "ST").when(line == "3", None).otherwise(F.col("ticker"))
    return C.drop_artifact_tickers(t.trades.select("trade_id", ticker.alias("ticker")))


@query("b04_normalize_feed", """
, f AS (SELECT trade_id, politician_id::VARCHAR AS politician_id, ticker, trade_type, trade_date, disclosure_lag_days,
  CASE line_number WHEN 1 THEN 1001 WHEN 2 THEN 15001 WHEN 3 THEN 1000001 ELSE 1001 END AS amount_lower,
  CASE line_number WHEN 1 THEN 8000 WHEN 2 THEN 32500 WHEN 3 THEN 3000000 ELSE 8000 END AS amount_midpoint FROM trades WHERE line_number <> 5)
SELECT politician_id, ticker, trade_type, trade_date, min(amount_midpoint) AS amount_midpoint FROM f
WHERE length(ticker) <= 5 AND trade_date >= '1998-01-01' AND disclosure_lag_days BETWEEN 0 AND 365 GROUP BY 1, 2, 3, 4
""")
def b04(t: Tables):
    line = F.split("trade_id", "-").getItem(1)
    kind = F.col("trade_type")
    feed = t.trades.select(
        F.concat(F.lit(" "), F.col("politician_id")).alias("Representative"), F.concat(F.lower("ticker"), F.lit(" ")).alias("Ticker"),
        F.when(line == "5", "Gift").when(kind == "buy", "Purchase").when(kind == "sell", "Sale (Full)").otherwise("Exchange").alias("Transaction"),
        F.when(line == "1", "$1,001 - $15,000").when(line == "2", "$15,001 - $50,000").when(line == "3", "OVER $1,000,000").otherwise("").alias("Amount"),
        F.date_format("trade_date", "yyyy-MM-dd").alias("TransactionDate"), F.date_format("disclosure_date", "M/d/yyyy").alias("DisclosureDate"),
        F.lit("c").alias("Company"), F.lit(None).cast("string").alias("AssetType"), F.lit("u").alias("Source"))
    cleaned = C.normalize_feed(feed, "1998-01-01")
    return cleaned.groupBy("politician_id", "ticker", "trade_type", "trade_date").agg(F.min("amount_midpoint").alias("amount_midpoint"))


@query("b05_equity_only", """
, x AS (SELECT trade_id, CASE WHEN line_number <> 3 THEN ticker END AS ticker, trade_type, CASE line_number WHEN 1 THEN 'Corporate Bond' WHEN 2 THEN 'Stock' END AS asset_type FROM trades)
SELECT trade_id, asset_type FROM x WHERE coalesce(asset_type, '') <> 'Corporate Bond' AND ticker IS NOT NULL
""")
def b05(t: Tables):
    line = F.split("trade_id", "-").getItem(1)
    rows = t.trades.select(
        "trade_id", F.when(line != "3", F.col("ticker")).alias("ticker"), "trade_type",
        F.when(line == "1", "Corporate Bond").when(line == "2", "Stock").alias("asset_type"))
    return C.equity_only(rows).select("trade_id", "asset_type")


@query("b06_disclosure_lag", """
SELECT trade_id, CASE WHEN line_number NOT IN (3, 4) THEN disclosure_lag_days END AS disclosure_lag_days FROM trades
""")
def b06(t: Tables):
    line = F.split("trade_id", "-").getItem(1)
    rows = t.trades.select(
        "trade_id",
        F.when(line == "3", "not a date").when(line == "1", F.date_format("trade_date", "MM/dd/yyyy")).otherwise(F.col("trade_date").cast("string")).alias("trade_date"),
        F.when(line == "4", None).when(line == "2", F.date_format("disclosure_date", "MMMM d, yyyy")).otherwise(F.col("disclosure_date").cast("string")).alias("disclosure_date"))
    return C.add_disclosure_lag(rows).select("trade_id", "disclosure_lag_days")


@query("b07_unified_projection", """
SELECT politician_id::VARCHAR AS politician_id, ticker, NULL::VARCHAR AS company_name, trade_type, trade_date, disclosure_date, disclosure_lag_days, amount_lower, amount_upper, amount_midpoint,
  NULL::VARCHAR AS asset_type, industry_sector, NULL::VARCHAR AS source_url, NULL::VARCHAR AS chamber, NULL::VARCHAR AS first_name, NULL::VARCHAR AS last_name, NULL::VARCHAR AS source FROM trades
""")
def b07(t: Tables):
    return C.to_unified(t.trades)


@query("b08_price_tickers", "SELECT DISTINCT ticker FROM trades WHERE regexp_full_match(ticker, '[A-Za-z]{1,5}') UNION SELECT 'SPY'")
def b08(t: Tables):
    return C.price_tickers(t.trades)


@query("b09_keep_resolved", "SELECT count(*) FILTER (industry_sector IS NOT NULL) AS kept, count(*) FILTER (industry_sector IS NULL) AS dropped FROM trades")
def b09(t: Tables):
    return C.split_resolved(t.trades, ["politician_id", "industry_sector"])[1]


@query("b09_write_resolved", """
SELECT count(*) FILTER (industry_sector IS NOT NULL) AS kept, count(*) FILTER (industry_sector IS NULL) AS dropped,
  count(*) FILTER (politician_id IS NULL) AS null_politician_id, count(*) FILTER (industry_sector IS NULL) AS null_industry_sector,
  count(*) FILTER (industry_sector IS NOT NULL) AS stored FROM trades
""")
def b09w(t: Tables):
    """The counts come from the job that writes the rows; `stored` is counted on the written table."""
    table = K.VersionedTable(t.spark, scratch_path(t.spark, "resolved"))
    counts = W.write_resolved(t.trades, ["politician_id", "industry_sector"], table.replace)
    return table.read().agg(*[F.lit(n).alias(c) for c, n in counts.items()], F.count(F.lit(1)).alias("stored"))


@query("b10_only_funds", "SELECT l_suppkey AS cik, count(*) AS n FROM lineitem WHERE l_suppkey IN (7, 11, 42) GROUP BY 1")
def b10(t: Tables):
    rows = t.lineitem.select(F.lpad(F.col("l_suppkey").cast("string"), 10, "0").alias("cik"))
    kept = C.only_funds(rows, {"7": "a", "11": "b", "42": "c"})
    return kept.groupBy(F.col("cik").cast("long").alias("cik")).agg(F.count("*").alias("n"))


@query("b11_share_positions", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'F'")
def b11(t: Tables):
    rows = t.lineitem.withColumn("share_type", F.when(F.col("l_linestatus") == "F", "SH").otherwise("PRN"))
    return C.share_positions(rows).select("l_orderkey", "l_linenumber", "l_partkey")


@query("b12_scoreable", "SELECT trade_id FROM scored WHERE line_number <> 7")
def b12(t: Tables):
    line = F.split("trade_id", "-").getItem(1)
    rows = t.scores.withColumn("cohort_alpha", F.when(line != "7", F.col("feat_cohort_alpha")))
    return C.scoreable(rows).select("trade_id")


@query("b13_search_people", "SELECT id, full_name FROM politicians WHERE lower(full_name) LIKE '%nation_1%' OR lower(bioguide_id) LIKE '%nation_1%' OR lower(state) LIKE '%nation_1%'")
def b13(t: Tables):
    return C.search_people(t.politicians, "Nation_1").select("id", "full_name")


@query("b14_optional_filters", "SELECT trade_id FROM scored WHERE severity_quadrant = 'OUTLIER' AND trade_date >= '1997-05-01' AND trade_date <= '1999-05-01'")
def b14(t: Tables):
    return C.optional_filters(t.scored, quadrants=["outlier"], since="1997-05-01", until="1999-05-01").select("trade_id")


@query("b15_select_person", "SELECT id, bioguide_id FROM politicians WHERE id = 17 OR bioguide_id = 'Supplier#000000023'")
def b15(t: Tables):
    both = [C.select_person(t.politicians, k) for k in ("17", "Supplier#000000023")]
    return M.union_aligned(both).select("id", "bioguide_id")


@query("b16_report_eligible", "SELECT severity_quadrant, count(*) AS n FROM flagged GROUP BY 1")
def b16(t: Tables):
    return C.report_eligible(t.scored).groupBy("severity_quadrant").agg(F.count("*").alias("n"))
