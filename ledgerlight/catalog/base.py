"""Registry of the queries and the roles the driver tables play in them.

Each entry pairs a Spark query with the SQL another engine runs on the same tables. The stand-ins
below use whole tables: `lineitem` rows are trades, `supplier` the people, `part` the companies,
`orders` bills and votes, `events` member votes against purchases.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions import scores as N

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(t: Tables) -> DataFrame` under `name`, with its SQL twin where there is one."""
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"{BASE_SQL}\n{sql.strip()}"
        return fn

    return register


def letters(number: Column) -> Column:
    return F.translate(number.cast("string"), "0123456789", "ABCDEFGHIJ")


def trade_key() -> Column:
    """The row's own values as its id."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_extendedprice"))


def trade_columns() -> dict[str, Column]:
    part, line, late = F.col("l_partkey"), F.col("l_linenumber"), (F.col("l_orderkey") % 120).cast("int")
    price, shipped = F.floor("l_extendedprice").cast("long"), F.to_date("l_shipdate")
    flag = F.col("l_returnflag")
    return {
        "trade_id": trade_key(),
        "politician_id": F.col("l_suppkey"),
        "ticker": letters(part),
        "trade_type": F.when(flag == "A", "buy").when(flag == "R", "sell").otherwise("exchange"),
        "trade_date": shipped,
        "disclosure_lag_days": late,
        "disclosure_date": F.date_add(shipped, late),
        "amount_midpoint": price,
        "amount_lower": price - 500,
        "amount_upper": price + 500,
        "industry_sector": (
            F.when(line == 7, '["tech", "defense"]').when(line == 6, "['healthcare', 'finance']")
            .when(part % 8 == 0, "defense").when(part % 8 == 1, "finance").when(part % 8 == 2, "healthcare")
            .when(part % 8 == 3, "energy").when(part % 8 == 4, "tech").when(part % 8 == 5, "telecom")
            .when(part % 8 == 6, "agriculture")
        ),
    }


def score_columns() -> dict[str, Column]:
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    cohort = F.floor(F.col("l_extendedprice") / 1050).cast("int")
    baseline = F.floor(F.col("l_quantity") * 2).cast("int")
    return {
        "cohort_index": cohort,
        "baseline_index": baseline,
        "severity_quadrant": N.quadrant(cohort, baseline),
        "audit_triggered": N.audit_flag(cohort, baseline),
        "feat_cohort_alpha": F.round((F.col("l_discount") - F.col("l_tax")) * 5, 2),
        "feat_pre_trade_alpha": F.round(F.col("l_tax") - 0.04, 2),
        "feat_proximity_days": (part % 91).cast("int"),
        "feat_bill_proximity": (F.col("l_suppkey") % 181).cast("int"),
        "feat_has_proximity_data": line % 2,
        "feat_committee_relevance": (
            F.when(line == 2, 0.4).when(line == 3, 0.52).when(line == 4, 0.7).when(line == 5, 1.0).otherwise(0.0)
        ),
        "feat_amount_zscore": F.round((F.col("l_quantity") - 25.5) / 14.5, 4),
        "feat_cluster_score": (part % 6).cast("int"),
        "feat_disclosure_lag": (F.col("l_orderkey") % 120).cast("double"),
    }


def _select(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


class Tables:
    """Driver tables and stand-ins, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def trades(self) -> DataFrame:
        return _select(self.lineitem, trade_columns())

    @cached_property
    def scores(self) -> DataFrame:
        keys = {k: v for k, v in trade_columns().items() if k in ("trade_id", "politician_id", "ticker", "trade_date")}
        return _select(self.lineitem, keys | score_columns())

    @cached_property
    def scored(self) -> DataFrame:
        """Trades with their scores, from one scan."""
        return _select(self.lineitem, trade_columns() | score_columns())

    @cached_property
    def politicians(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
            self.region, F.col("n_regionkey") == F.col("r_regionkey")
        ).select(
            key.alias("id"), F.col("s_name").alias("bioguide_id"),
            F.concat(F.lit("Last"), letters(key), F.lit(", First"), letters(key % 97)).alias("full_name"),
            F.when(key % 3 == 0, "D").when(key % 3 == 1, "R").otherwise("I").alias("party"),
            F.col("n_name").alias("state"), F.col("r_name").alias("chamber"),
        )

    @cached_property
    def prices(self) -> DataFrame:
        """Highest unit price per (ticker, ship date); the benchmark is the day's whole value over its whole quantity."""
        daily = self.lineitem.groupBy("l_partkey", F.to_date("l_shipdate").alias("price_date")).agg(
            F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("close")
        ).select(letters(F.col("l_partkey")).alias("ticker"), "price_date", "close")
        bench = self.lineitem.groupBy(F.to_date("l_shipdate").alias("price_date")).agg(
            (F.sum(F.floor("l_extendedprice")) / F.sum("l_quantity")).alias("close")
        ).select(F.lit("SPY").alias("ticker"), "price_date", "close")
        return daily.unionByName(bench)

    @cached_property
    def bills(self) -> DataFrame:
        """Orders as bills: the segment decides the policy area; urgent orders lack one."""
        segment = F.col("c_mktsegment")
        area = (
            F.when(F.col("o_orderpriority") == "1-URGENT", None)
            .when(segment == "AUTOMOBILE", "Defense").when(segment == "BUILDING", "Taxation")
            .when(segment == "FURNITURE", "Energy").when(segment == "HOUSEHOLD", "Health")
            .otherwise("Commerce")
        )
        return self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.concat(F.lit("hr"), F.col("o_orderkey"), F.lit("-119")).alias("bill_id"),
            F.concat(F.lit("HR"), F.col("o_orderkey")).alias("bill_number"),
            F.concat(F.lit("Act "), F.col("o_orderpriority")).alias("title"),
            area.alias("policy_area"),
            F.to_date("o_orderdate").alias("latest_action_date"),
            F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("https://b/"), F.col("o_orderkey"))).alias("url"),
        )

    @cached_property
    def reports(self) -> DataFrame:
        """Evidence reports on all flagged trades, some with gaps; those of two line numbers name their trade."""
        flagged = self.scored.where(F.col("severity_quadrant").isin("SEVERE", "SYSTEMIC"))
        number = F.split("trade_id", "-").getItem(1).cast("int")
        lag = F.col("disclosure_lag_days")
        # Reports on other lines don't name their trade.
        return flagged.select(
            F.concat(F.lit("r"), F.col("trade_id")).alias("id"), F.when(number <= 2, F.col("trade_id")).alias("trade_id"), "severity_quadrant",
            F.when(lag != 7, F.concat(F.lit("Trade in "), F.col("ticker"), F.repeat(F.lit(" flagged"), lag % 20))).alias("headline"),
            F.when(lag % 10 != 3, F.concat(F.lit("Narrative "), F.col("trade_id"))).alias("narrative"),
            F.when(lag % 11 == 0, None).when(lag % 11 == 1, F.lit("{}"))
            .when(lag % 11 == 2, F.lit('{"key_factors": ["a"]}'))
            .otherwise(F.concat(F.lit('{"key_factors": ["a", "b"], "score_driver": "'),
                                F.when(lag % 2 == 0, "both").otherwise("baseline"), F.lit('"}'))).alias("evidence_json"),
            F.when(lag % 13 != 5, F.lit("Not a finding.")).alias("disclaimer"),
            F.when((lag % 5 != 1) & (F.col("severity_quadrant") == "SEVERE"), F.lit("Newsroom")).alias("video_prompt"),
            F.when((lag % 7 != 2) & (F.col("severity_quadrant") == "SEVERE"),
                   F.concat(F.lit("Script for "), F.col("ticker"))).alias("narration_script"),
            F.when(lag % 3 == 0, F.lit('["x", "y"]')).when(lag % 3 == 1, F.lit("[]")).alias("citation_image_prompts"),
            F.when(lag % 2 == 0, "fallback").otherwise("m1").alias("model"),
            (lag + 100).alias("prompt_tokens"), (lag + 10).alias("output_tokens"),
        )

    @cached_property
    def media(self) -> DataFrame:
        """Media files: events stand in, `user_id` for the trade."""
        kind = F.col("event_type")
        return self.events.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("trade_id"),
            F.when(kind.isin("view", "click"), "citation_image").when(kind == "purchase", "video").otherwise("audio").alias("asset_type"),
            F.when(F.col("value") < 20, "ready").otherwise("pending").alias("generation_status"),
            F.concat(F.lit("s3://m/"), F.col("event_id")).alias("storage_url"), F.col("ts").alias("generated_at"),
        )

    @cached_property
    def committees(self) -> DataFrame:
        """One committee per (nation, region); keywords rotate through its name."""
        names = [
            "Committee on Armed Services", "Select Committee on Intelligence", "Committee on Appropriations",
            "Committee on Finance", "Committee on Energy and Natural Resources", "Committee on Veterans Affairs",
            "Committee on Rules",
        ]
        key = F.col("n_nationkey")
        name = F.element_at(F.array(*[F.lit(n) for n in names]), (key % 7 + 1).cast("int"))
        return self.nation.select(
            key.alias("id"), F.concat(name, F.lit(" "), F.col("n_name")).alias("name"),
            F.when(key % 4 == 0, "tech").when(key % 4 == 1, "energy").alias("sector_tag"),
        )

    @cached_property
    def memberships(self) -> DataFrame:
        """Every supplier sits in two committees."""
        roles = F.element_at(
            F.array(F.lit("member"), F.lit("chair"), F.lit("ranking_member"), F.lit("vice_chair"), F.lit("member")),
            (F.col("s_suppkey") % 5 + 1).cast("int"),
        )
        return self.supplier.select(
            F.col("s_suppkey").alias("politician_id"),
            F.explode(F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 7) % 25)).alias("committee_id"),
            roles.alias("role"),
        )


BASE_SQL = r"""
WITH trades AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT)) AS trade_id,
    l_suppkey AS politician_id,
    translate(CAST(l_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS ticker,
    CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' ELSE 'exchange' END AS trade_type,
    CAST(l_shipdate AS DATE) AS trade_date,
    CAST(l_orderkey % 120 AS INT) AS disclosure_lag_days,
    CAST(l_shipdate AS DATE) + CAST(l_orderkey % 120 AS INT) AS disclosure_date,
    CAST(floor(l_extendedprice) AS BIGINT) AS amount_midpoint,
    CAST(floor(l_extendedprice) AS BIGINT) - 500 AS amount_lower,
    CAST(floor(l_extendedprice) AS BIGINT) + 500 AS amount_upper,
    CASE WHEN l_linenumber = 7 THEN '["tech", "defense"]' WHEN l_linenumber = 6 THEN '[''healthcare'', ''finance'']'
      WHEN l_partkey % 8 = 0 THEN 'defense' WHEN l_partkey % 8 = 1 THEN 'finance' WHEN l_partkey % 8 = 2 THEN 'healthcare'
      WHEN l_partkey % 8 = 3 THEN 'energy' WHEN l_partkey % 8 = 4 THEN 'tech' WHEN l_partkey % 8 = 5 THEN 'telecom'
      WHEN l_partkey % 8 = 6 THEN 'agriculture' END AS industry_sector,
    CASE WHEN l_linenumber = 7 THEN ['tech', 'defense'] WHEN l_linenumber = 6 THEN ['healthcare', 'finance']
      WHEN l_partkey % 8 = 0 THEN ['defense'] WHEN l_partkey % 8 = 1 THEN ['finance'] WHEN l_partkey % 8 = 2 THEN ['healthcare']
      WHEN l_partkey % 8 = 3 THEN ['energy'] WHEN l_partkey % 8 = 4 THEN ['tech'] WHEN l_partkey % 8 = 5 THEN ['telecom']
      WHEN l_partkey % 8 = 6 THEN ['agriculture'] ELSE [] END AS sectors,
    CAST(floor(l_extendedprice / 1050) AS INT) AS cohort_index,
    CAST(floor(l_quantity * 2) AS INT) AS baseline_index,
    round((l_discount - l_tax) * 5, 2) AS feat_cohort_alpha,
    round(l_tax - 0.04, 2) AS feat_pre_trade_alpha,
    CAST(l_partkey % 91 AS INT) AS feat_proximity_days,
    CAST(l_suppkey % 181 AS INT) AS feat_bill_proximity,
    l_linenumber % 2 AS feat_has_proximity_data,
    CASE l_linenumber WHEN 2 THEN 0.4::DOUBLE WHEN 3 THEN 0.52::DOUBLE WHEN 4 THEN 0.7::DOUBLE WHEN 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS feat_committee_relevance,
    round((l_quantity - 25.5) / 14.5, 4) AS feat_amount_zscore,
    CAST(l_partkey % 6 AS INT) AS feat_cluster_score,
    CAST(l_orderkey % 120 AS DOUBLE) AS feat_disclosure_lag,
    l_linenumber AS line_number
  FROM lineitem),
scored AS (
  SELECT *, CASE WHEN cohort_index >= 60 AND baseline_index >= 60 THEN 'SEVERE' WHEN baseline_index >= 60 THEN 'SYSTEMIC'
      WHEN cohort_index >= 60 THEN 'OUTLIER' ELSE 'UNREMARKABLE' END AS severity_quadrant,
    cohort_index >= 70 OR baseline_index >= 70 AS audit_triggered
  FROM trades),
flagged AS (SELECT * FROM scored WHERE severity_quadrant IN ('SEVERE', 'SYSTEMIC')),
politicians AS (
  SELECT s_suppkey AS id, s_name AS bioguide_id,
    'Last' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || ', First' ||
      translate(CAST(s_suppkey % 97 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS full_name,
    CASE s_suppkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' ELSE 'I' END AS party, n_name AS state, r_name AS chamber
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
prices AS (
  SELECT translate(CAST(l_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS ticker, CAST(l_shipdate AS DATE) AS price_date,
    max(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2
  UNION ALL
  SELECT 'SPY', CAST(l_shipdate AS DATE), sum(floor(l_extendedprice)) / sum(l_quantity) FROM lineitem GROUP BY 2),
bills AS (
  SELECT 'hr' || o_orderkey || '-119' AS bill_id, 'HR' || o_orderkey AS bill_number, 'Act ' || o_orderpriority AS title,
    CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Defense'
      WHEN c_mktsegment = 'BUILDING' THEN 'Taxation' WHEN c_mktsegment = 'FURNITURE' THEN 'Energy'
      WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Health' ELSE 'Commerce' END AS policy_area,
    CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN c_mktsegment = 'AUTOMOBILE' THEN 'defense'
      WHEN c_mktsegment = 'BUILDING' THEN 'finance' WHEN c_mktsegment = 'FURNITURE' THEN 'energy'
      WHEN c_mktsegment = 'HOUSEHOLD' THEN 'healthcare' ELSE 'tech' END AS sector,
    CAST(o_orderdate AS DATE) AS latest_action_date,
    CASE WHEN o_orderstatus <> 'P' THEN 'https://b/' || o_orderkey END AS url
  FROM orders JOIN customer ON o_custkey = c_custkey),
reports AS (
  SELECT 'r' || trade_id AS id, CASE WHEN line_number <= 2 THEN t.trade_id END AS trade_id, severity_quadrant,
    CASE WHEN disclosure_lag_days <> 7 THEN 'Trade in ' || ticker || repeat(' flagged', disclosure_lag_days % 20) END AS headline,
    CASE WHEN disclosure_lag_days % 10 <> 3 THEN 'Narrative ' || trade_id END AS narrative,
    CASE WHEN disclosure_lag_days % 11 = 0 THEN NULL WHEN disclosure_lag_days % 11 = 1 THEN '{}'
      WHEN disclosure_lag_days % 11 = 2 THEN '{"key_factors": ["a"]}'
      ELSE '{"key_factors": ["a", "b"], "score_driver": "' || CASE WHEN disclosure_lag_days % 2 = 0 THEN 'both' ELSE 'baseline' END || '"}' END AS evidence_json,
    CASE WHEN disclosure_lag_days % 13 <> 5 THEN 'Not a finding.' END AS disclaimer,
    CASE WHEN disclosure_lag_days % 5 <> 1 AND severity_quadrant = 'SEVERE' THEN 'Newsroom' END AS video_prompt,
    CASE WHEN disclosure_lag_days % 7 <> 2 AND severity_quadrant = 'SEVERE' THEN 'Script for ' || ticker END AS narration_script,
    CASE disclosure_lag_days % 3 WHEN 0 THEN '["x", "y"]' WHEN 1 THEN '[]' END AS citation_image_prompts,
    CASE WHEN disclosure_lag_days % 2 = 0 THEN 'fallback' ELSE 'm1' END AS model,
    disclosure_lag_days + 100 AS prompt_tokens, disclosure_lag_days + 10 AS output_tokens
  FROM flagged t),
media AS (
  SELECT event_id AS id, user_id AS trade_id,
    CASE WHEN event_type IN ('view', 'click') THEN 'citation_image' WHEN event_type = 'purchase' THEN 'video' ELSE 'audio' END AS asset_type,
    CASE WHEN value < 20 THEN 'ready' ELSE 'pending' END AS generation_status, 's3://m/' || event_id AS storage_url, ts AS generated_at
  FROM events),
committees AS (
  SELECT n_nationkey AS id, ['Committee on Armed Services', 'Select Committee on Intelligence', 'Committee on Appropriations',
    'Committee on Finance', 'Committee on Energy and Natural Resources', 'Committee on Veterans Affairs', 'Committee on Rules'][n_nationkey % 7 + 1]
    || ' ' || n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'tech' WHEN 1 THEN 'energy' END AS sector_tag FROM nation),
memberships AS (
  SELECT s_suppkey AS politician_id, unnest([s_nationkey, (s_nationkey + 7) % 25]) AS committee_id,
    ['member', 'chair', 'ranking_member', 'vice_chair', 'member'][s_suppkey % 5 + 1] AS role FROM supplier),
access_kw(keyword, sector, base, factor) AS (VALUES
  ('armed services', 'defense', 0.7, 1.0), ('finance', 'finance', 0.7, 1.0), ('finance', 'healthcare', 0.7, 1.0),
  ('energy', 'energy', 0.7, 1.0), ('natural resources', 'energy', 0.7, 1.0), ('natural resources', 'agriculture', 0.7, 1.0),
  ('veterans', 'healthcare', 0.7, 1.0),
  ('intelligence', 'defense', 0.5, 0.65), ('intelligence', 'tech', 0.5, 0.65),
  ('appropriations', 'defense', 0.4, 0.52), ('appropriations', 'finance', 0.4, 0.52), ('appropriations', 'healthcare', 0.4, 0.52),
  ('appropriations', 'energy', 0.4, 0.52), ('appropriations', 'tech', 0.4, 0.52), ('appropriations', 'agriculture', 0.4, 0.52),
  ('appropriations', 'telecom', 0.4, 0.52)),
seat_weights AS (
  SELECT politician_id, sector, CASE WHEN role LIKE '%chair%' OR role LIKE '%ranking%' THEN factor ELSE base END AS weight
  FROM memberships m JOIN committees c ON c.id = m.committee_id JOIN access_kw k ON contains(lower(c.name), k.keyword)
  UNION ALL
  SELECT politician_id, sector_tag, CASE WHEN role LIKE '%chair%' OR role LIKE '%ranking%' THEN 1.0 ELSE 0.7 END
  FROM memberships m JOIN committees c ON c.id = m.committee_id
  WHERE sector_tag IS NOT NULL AND NOT contains(lower(c.name), 'intelligence') AND NOT contains(lower(c.name), 'appropriations')),
access AS (SELECT politician_id, sector, CAST(max(weight) AS DOUBLE) AS weight FROM seat_weights GROUP BY 1, 2)
"""
