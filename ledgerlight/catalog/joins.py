"""Join operators (C)."""

from pyspark.sql import functions as F

from ledgerlight.catalog.base import Tables, letters, query
from ledgerlight.functions import sectors as S
from ledgerlight.functions import text as X
from ledgerlight.operators import entity as E
from ledgerlight.operators import merge as M
from ledgerlight.operators import metrics as W
from ledgerlight.operators import patterns as P
from ledgerlight.operators import quality as Q
from ledgerlight.operators import temporal as T
from ledgerlight.session import scratch_path
from ledgerlight.sources import bucketed as B
from ledgerlight.sources import sinks as K
from ledgerlight.streaming import incremental as I


@query("c01_seats_and_votes", """
SELECT politician_id, committee_name, role, sector_tag, n_votes FROM (
  SELECT m.politician_id, c.name AS committee_name, m.role, c.sector_tag FROM memberships m JOIN committees c ON c.id = m.committee_id) s
JOIN (SELECT o_custkey AS politician_id, count(*) AS n_votes FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1) v USING (politician_id)
""")
def c01(t: Tables):
    votes = t.orders.where(F.col("o_orderdate").isNotNull()).groupBy(F.col("o_custkey").alias("politician_id"))
    return E.seats(t.memberships, t.committees).join(votes.agg(F.count("*").alias("n_votes")), "politician_id")


@query("c02_left_chain", """
SELECT t.trade_id, p.full_name, a.cohort_index, a.severity_quadrant, r.headline
FROM trades t LEFT JOIN politicians p ON p.id = t.politician_id LEFT JOIN scored a ON a.trade_id = t.trade_id
LEFT JOIN reports r ON r.trade_id = t.trade_id
""")
def c02(t: Tables):
    from ledgerlight.plans.reports import trade_context

    return trade_context(t.trades, t.scores, t.politicians, t.reports).select(
        "trade_id", "full_name", "cohort_index", "severity_quadrant", "headline"
    )


@query("c03_unscored_trades", """
SELECT trade_id, ticker FROM trades WHERE trade_id NOT IN (SELECT trade_id FROM scored WHERE severity_quadrant <> 'UNREMARKABLE')
""")
def c03(t: Tables):
    done = t.scores.where("severity_quadrant <> 'UNREMARKABLE'")
    return I.unscored(t.trades, done).select("trade_id", "ticker")


@query("c04_tickers_without_prices", """
SELECT DISTINCT ticker FROM trades WHERE ticker NOT IN (
  SELECT translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') FROM part WHERE p_size > 25)
""")
def c04(t: Tables):
    priced = t.part.select(F.when(F.col("p_size") > 25, letters(F.col("p_partkey"))).alias("ticker"))
    return M.missing_keys(t.trades, priced, "ticker")


@query("c05_flagged_without_report", """
SELECT trade_id, severity_quadrant FROM flagged WHERE trade_id NOT IN (SELECT trade_id FROM reports WHERE trade_id IS NOT NULL)
""")
def c05(t: Tables):
    return I.unreported(t.scored, t.reports).select("trade_id", "severity_quadrant")


@query("c06_foreign_key_orphans", """
SELECT 'lineitem.orders' AS relation, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'memberships.committees', count(*) FROM memberships WHERE committee_id NOT IN (SELECT id FROM committees WHERE sector_tag IS NOT NULL)
UNION ALL SELECT 'labels.documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
""")
def c06(t: Tables):
    return Q.orphan_report([
        ("lineitem.orders", t.lineitem, "l_orderkey", t.orders.where("o_orderstatus <> 'P'"), "o_orderkey"),
        ("orders.customer", t.orders, "o_custkey", t.customer, "c_custkey"),
        ("memberships.committees", t.memberships, "committee_id", t.committees.where("sector_tag is not null"), "id"),
        ("labels.documents", t.labels, "doc_id", t.documents.where("lang = 'en'"), "doc_id"),
    ])


@query("c07_trades_without_votes_or_seats", """
SELECT count(*) FILTER (politician_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)) AS no_votes,
  count(*) FILTER (politician_id NOT IN (SELECT politician_id FROM memberships WHERE role = 'member')) AS no_seats FROM trades
""")
def c07(t: Tables):
    voters = t.customer.select(F.when(F.col("c_acctbal") > 5000, F.col("c_custkey")).alias("politician_id"))
    members = t.memberships.withColumn("politician_id", F.when(F.col("role") == "member", F.col("politician_id")))
    return Q.uncovered_counts(t.trades, "politician_id", {"no_votes": voters, "no_seats": members})


@query("c08_semi_joins", """
SELECT 'severe_reports' AS what, count(*) AS n FROM reports WHERE trade_id IN (SELECT trade_id FROM scored WHERE severity_quadrant = 'SEVERE')
UNION ALL SELECT 'traded_price_tickers', count(DISTINCT ticker) FROM prices WHERE ticker IN (SELECT ticker FROM trades)
""")
def c08(t: Tables):
    severe = t.reports.join(t.scores.where("severity_quadrant = 'SEVERE'"), "trade_id", "left_semi")
    traded = M.known_keys(t.prices, t.trades, "ticker")
    return severe.agg(F.lit("severe_reports").alias("what"), F.count("*").alias("n")).union(
        traded.agg(F.lit("traded_price_tickers"), F.count("*"))
    )


HOLDINGS_SQL = """
, holdings AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS cik, 'C' || l_partkey AS cusip, year(l_shipdate) * 4 + quarter(l_shipdate) AS period,
    CAST(l_quantity * 100 AS DOUBLE) AS shares FROM lineitem)
"""


@query("c09_quarter_full_join", HOLDINGS_SQL + """
, q AS (SELECT cik, cusip, period, sum(shares) AS shares FROM holdings GROUP BY ALL),
last_p AS (SELECT max(period) AS p FROM q)
SELECT coalesce(a.cik, b.cik) AS cik, coalesce(a.cusip, b.cusip) AS cusip,
  CAST(coalesce(a.period, b.period - 1) AS INT) AS period, coalesce(a.shares, 0) AS shares_prior, coalesce(b.shares, 0) AS shares_current
FROM (SELECT * FROM q WHERE period < (SELECT p FROM last_p)) a
FULL JOIN (SELECT * FROM q WHERE period > (SELECT min(period) FROM q)) b ON a.cik = b.cik AND a.cusip = b.cusip AND a.period + 1 = b.period
""")
def c09(t: Tables):
    from ledgerlight.catalog.models import holdings
    from ledgerlight.plans.holdings import quarter_changes

    return quarter_changes(holdings(t), ["cik", "cusip"]).select(
        "cik", "cusip", "period", "shares_prior", "shares_current"
    )


ASOF = """
SELECT t.trade_id, t.ticker, t.trade_date, p.close AS close FROM {left} t ASOF LEFT JOIN prices p
ON t.ticker = p.ticker AND {condition}
"""


@query("c10_asof_forward", """
, probes AS (SELECT trade_id, ticker, trade_date + 30 AS trade_date FROM trades)
""" + ASOF.format(left="probes", condition="t.trade_date <= p.price_date"))
def c10(t: Tables):
    left = t.trades.select("trade_id", "ticker", F.date_add("trade_date", 30).alias("trade_date"))
    right = t.prices.withColumnRenamed("price_date", "trade_date")
    return T.asof_join(left, right, "ticker", "trade_date", "close", "forward")


def _stored_prices(t: Tables) -> tuple:
    """Prices as a table in buckets of the ticker, and the number of these."""
    # There are no more prices than lineitems, whose number is in the files' footers.
    name = B.store(t.prices, B.scratch_name("prices"), ["ticker"], ["price_date"], B.buckets_for(t.lineitem.count()))
    return t.spark.table(name), B.buckets_of(t.spark, name)


@query("c10_asof_bucketed", """
, probes AS (SELECT trade_id, ticker, trade_date + 30 AS trade_date FROM trades)
""" + ASOF.format(left="probes", condition="t.trade_date <= p.price_date"))
def c10_bucketed(t: Tables):
    left = t.trades.select("trade_id", "ticker", F.date_add("trade_date", 30).alias("trade_date"))
    prices, buckets = _stored_prices(t)
    right = prices.withColumnRenamed("price_date", "trade_date")
    return T.asof_join(left, right, "ticker", "trade_date", "close", "forward", buckets=buckets)


@query("c11_asof_backward", """
, probes AS (SELECT trade_id, ticker, trade_date - 7 AS trade_date FROM trades)
""" + ASOF.format(left="probes", condition="t.trade_date >= p.price_date"))
def c11(t: Tables):
    left = t.trades.select("trade_id", "ticker", F.date_sub("trade_date", 7).alias("trade_date"))
    right = t.prices.withColumnRenamed("price_date", "trade_date")
    return T.asof_join(left, right, "ticker", "trade_date", "close", "backward")


@query("c12_benchmark_asof", """
, days AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), spy AS (SELECT * FROM prices WHERE ticker = 'SPY'),
f AS (SELECT o_orderkey, s.close AS next_close FROM days ASOF LEFT JOIN spy s ON days.d <= s.price_date)
SELECT o_orderkey, next_close, s.close AS last_close FROM days JOIN f USING (o_orderkey) ASOF LEFT JOIN spy s ON days.d >= s.price_date
""")
def c12(t: Tables):
    bench = t.prices.where("ticker = 'SPY'").withColumnRenamed("price_date", "day")
    days = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.lit("SPY").alias("ticker"))
    ahead = T.asof_join(days, bench.withColumnRenamed("close", "next_close"), "ticker", "day", "next_close", "forward")
    both = T.asof_join(ahead, bench.withColumnRenamed("close", "last_close"), "ticker", "day", "last_close", "backward")
    return both.select("o_orderkey", "next_close", "last_close")


@query("c13_nearest_event", """
, p AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'),
c AS (SELECT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'click')
SELECT event_id, CAST((SELECT min(abs(c.d - p.d)) FROM c WHERE c.user_id = p.user_id AND abs(c.d - p.d) <= 90) AS INT) AS gap_days FROM p
""")
def c13(t: Tables):
    rows = t.events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    left = rows.where("event_type = 'purchase'").select("event_id", "user_id", "day")
    votes = rows.where("event_type = 'click'")
    return T.nearest_event(left, votes, "user_id", "day").select("event_id", "gap_days")


@query("c14_nearest_sector_event", """
, b AS (SELECT DISTINCT sector, latest_action_date AS d FROM bills WHERE sector IS NOT NULL),
td AS (SELECT DISTINCT unnest(sectors) AS sector, trade_date FROM trades),
near AS (SELECT td.sector, td.trade_date, min(abs(b.d - td.trade_date)) AS gap FROM td JOIN b ON b.sector = td.sector AND abs(b.d - td.trade_date) <= 180 GROUP BY ALL),
ex AS (SELECT trade_id, trade_date, unnest(sectors) AS sector FROM trades)
SELECT t.trade_id, CAST(g.gap AS INT) AS bill_gap FROM trades t LEFT JOIN
  (SELECT trade_id, min(gap) AS gap FROM ex JOIN near USING (sector, trade_date) GROUP BY 1) g USING (trade_id)
""")
def c14(t: Tables):
    left = t.trades.select("trade_id", "trade_date", S.parse_sector("industry_sector").alias("sectors"))
    events = t.bills.select(S.policy_sector("policy_area").alias("sector"), F.col("latest_action_date").alias("trade_date"))
    return T.nearest_category_event(left, events, "sectors", "sector", "trade_date", 180, "bill_gap").select("trade_id", "bill_gap")


TWO_TIER = """
, v AS (SELECT DISTINCT o_custkey AS eid, CAST(o_orderdate AS DATE) AS d,
    CASE o_orderstatus WHEN 'F' THEN 'defense' WHEN 'O' THEN 'finance' ELSE 'tech' END AS sector FROM orders)
"""


@query("c15_nearest_two_tier", TWO_TIER + """
, tr AS (SELECT trade_id, politician_id, trade_date, sectors FROM trades)
SELECT tr.trade_id, CAST(coalesce(
   (SELECT min(abs(v.d - tr.trade_date)) FROM v WHERE v.eid = tr.politician_id AND list_contains(tr.sectors, v.sector) AND abs(v.d - tr.trade_date) <= 90),
   (SELECT min(abs(v.d - tr.trade_date)) FROM v WHERE v.eid = tr.politician_id AND abs(v.d - tr.trade_date) <= 90)) AS INT) AS gap_days FROM tr
""")
def c15(t: Tables):
    left = t.trades.select("trade_id", "politician_id", "trade_date", S.parse_sector("industry_sector").alias("sectors"))
    sector = F.when(F.col("o_orderstatus") == "F", "defense").when(F.col("o_orderstatus") == "O", "finance").otherwise("tech")
    votes = t.orders.select(
        F.col("o_custkey").alias("politician_id"), F.to_date("o_orderdate").alias("trade_date"), sector.alias("sector")
    )
    return T.nearest_two_tier(left, votes, "politician_id", "sectors", "sector", "trade_date").select("trade_id", "gap_days")


@query("c16_peer_cluster", """
SELECT a.trade_id, count(DISTINCT b.politician_id) AS cluster_score FROM trades a LEFT JOIN trades b
ON a.ticker = b.ticker AND a.politician_id <> b.politician_id AND abs(a.trade_date - b.trade_date) <= 7 GROUP BY 1
""")
def c16(t: Tables):
    left = t.trades.select("trade_id", "ticker", "politician_id", "trade_date")
    return T.peer_cluster(left, "ticker", "politician_id", "trade_date", tasks=T.tasks_for(left)).select(
        "trade_id", F.col("cluster_score").cast("long").alias("cluster_score")
    )


@query("c17_busy_days", """
, w AS (SELECT *, ticker[1:2] AS grp FROM trades)
SELECT a.grp, a.trade_date, count(DISTINCT a.politician_id) AS n_entities FROM w a
WHERE EXISTS (SELECT 1 FROM w b WHERE a.grp = b.grp AND a.politician_id <> b.politician_id AND b.trade_date BETWEEN a.trade_date - 7 AND a.trade_date + 7)
GROUP BY 1, 2 HAVING count(DISTINCT a.politician_id) >= 3 ORDER BY 3 DESC, 1, 2 LIMIT 10
""")
def c17(t: Tables):
    left = t.trades.select(F.left("ticker", F.lit(2)).alias("grp"), "politician_id", "trade_date")
    return T.busy_days(left, "grp", "politician_id", "trade_date")


@query("c18_nearest_bills", """
, keys AS (SELECT DISTINCT sectors, trade_date FROM trades),
ranked AS (SELECT k.sectors, k.trade_date, b.bill_id, abs(b.latest_action_date - k.trade_date) AS gap,
    row_number() OVER (PARTITION BY k.sectors, k.trade_date ORDER BY abs(b.latest_action_date - k.trade_date), b.bill_id) AS rn
  FROM keys k JOIN bills b ON list_contains(k.sectors, b.sector) AND b.latest_action_date BETWEEN k.trade_date - 90 AND k.trade_date + 90),
best AS (SELECT sectors, trade_date, string_agg(bill_id || ':' || gap, ',' ORDER BY gap, bill_id) AS nearby FROM ranked WHERE rn <= 3 GROUP BY 1, 2)
SELECT t.trade_id, coalesce(best.nearby, '') AS nearby FROM trades t LEFT JOIN best ON t.sectors = best.sectors AND t.trade_date = best.trade_date
""")
def c18(t: Tables):
    left = t.trades.select("trade_id", "trade_date", S.parse_sector("industry_sector").alias("sectors"))
    bills = t.bills.select(
        "bill_id", S.policy_sector("policy_area").alias("sector"), F.col("latest_action_date").alias("trade_date")
    )
    near = T.nearest_k(left, bills, "sectors", "sector", "trade_date", "bill_id")
    text = F.array_join(F.transform("nearby", lambda b: F.concat_ws(":", b["bill_id"], b["gap_days"])), ",")
    return near.select("trade_id", F.coalesce(text, F.lit("")).alias("nearby"))


C19 = """
, keys AS (SELECT DISTINCT ticker, trade_date + 400 AS d FROM trades),
near AS (SELECT k.ticker, k.d, count(*) AS n, min(p.price_date) AS first_day, max(p.close) AS top FROM keys k
  JOIN prices p ON p.ticker = k.ticker AND p.price_date BETWEEN k.d - 30 AND k.d + 30 GROUP BY 1, 2),
firsts AS (SELECT ticker, count(*) AS n, min(price_date) AS first_day, max(close) AS top FROM
  (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY price_date) AS rn FROM prices) WHERE rn <= 200 GROUP BY 1)
SELECT t.trade_id, CAST(coalesce(near.n, firsts.n) AS INT) AS n_closes, coalesce(near.first_day, firsts.first_day) AS first_day,
  coalesce(near.top, firsts.top) AS top_close
FROM trades t LEFT JOIN near ON near.ticker = t.ticker AND near.d = t.trade_date + 400 LEFT JOIN firsts ON firsts.ticker = t.ticker
"""


def _closes(out):
    return out.select(
        "trade_id", F.size("closes").alias("n_closes"), F.col("closes")[0]["price_date"].alias("first_day"),
        F.array_max(F.transform("closes", lambda c: c["close"])).alias("top_close"),
    )


@query("c19_price_window", C19)
def c19(t: Tables):
    left = t.trades.select("trade_id", "ticker", F.date_add("trade_date", 400).alias("trade_date"))
    return _closes(T.price_window(left, t.prices))


@query("c19_price_window_bucketed", C19)
def c19_bucketed(t: Tables):
    left = t.trades.select("trade_id", "ticker", F.date_add("trade_date", 400).alias("trade_date"))
    prices, buckets = _stored_prices(t)
    return _closes(T.price_window(left, prices, buckets=buckets))


@query("c20_dictionary_map", """
SELECT t.trade_id, p.p_brand AS sector FROM trades t LEFT JOIN part p
ON t.ticker = translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AND p_size <= 40
""")
def c20(t: Tables):
    mapping = t.part.select(F.when(F.col("p_size") <= 40, letters(F.col("p_partkey"))).alias("ticker"), "p_brand")
    return E.map_column(t.trades.select("trade_id", "ticker"), mapping, "ticker", "p_brand", "sector").drop("ticker")


def _named(t: Tables):
    """Trades with a free-text name in one of several spellings."""
    key, line = F.col("politician_id"), F.split("trade_id", "-").getItem(1).cast("int")
    last, first = F.concat(F.lit("Last"), letters(key)), F.concat(F.lit("First"), letters(key % 97))
    name = (
        F.when(line == 1, F.concat(last, F.lit(", "), first)).when(line == 2, F.concat_ws(" ", first, last))
        .when(line == 3, F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0")))
        .when(line == 4, F.concat(F.upper(first), F.lit(" "), last, F.lit(" Jr.")))
        .when(line == 5, F.concat(F.lit("Unknown "), last)).when(line == 6, F.lit("Nobody Here"))
        .when(line == 7, F.concat(first, F.lit(" Q. "), last))
    )
    return t.trades.select("trade_id", name.alias("politician_id"), F.when(line <= 5, last).alias("last_name"))


@query("c21_resolve_load", """
SELECT trade_id, CASE WHEN line_number <= 5 THEN p.id END AS resolved_id
FROM trades t LEFT JOIN politicians p ON p.id = t.politician_id
""")
def c21(t: Tables):
    return E.resolve_entity(_named(t), t.politicians).select("trade_id", "resolved_id")


@query("c22_resolve_strict", """
SELECT trade_id, CASE WHEN line_number IN (1, 2, 4, 5, 7) THEN p.id END AS resolved_id
FROM trades t LEFT JOIN politicians p ON p.id = t.politician_id
""")
def c22(t: Tables):
    return E.resolve_entity(_named(t), t.politicians, mode="strict").select("trade_id", "resolved_id")


@query("c23_committee_code_join", """
SELECT s_suppkey, n_name FROM supplier JOIN nation ON CASE WHEN s_suppkey % 2 = 0 THEN 'n00' ELSE 'n' || s_nationkey END =
  CASE WHEN n_nationkey = 0 THEN 'n00' ELSE 'n' || n_nationkey END
""")
def c23(t: Tables):
    code = F.when(F.col("s_suppkey") % 2 == 0, " N ").otherwise(F.concat(F.lit("N"), F.col("s_nationkey")))
    seats = t.supplier.select("s_suppkey", X.committee_code(code).alias("code"))
    codes = t.nation.select(
        F.when(F.col("n_nationkey") == 0, "n00").otherwise(F.concat(F.lit("n"), F.col("n_nationkey"))).alias("code"), "n_name"
    )
    return seats.join(codes, "code").select("s_suppkey", "n_name")


@query("c24_committee_sectors", """
SELECT c.name, coalesce(CASE WHEN c.name ILIKE '%intelligence%' THEN 'defense,tech'
  WHEN c.name ILIKE '%appropriations%' THEN 'defense,finance,healthcare,energy,tech,agriculture,telecom'
  WHEN c.name ILIKE '%armed services%' THEN 'defense' WHEN c.name ILIKE '%energy%' THEN 'energy'
  WHEN c.name ILIKE '%finance%' THEN 'finance,healthcare' WHEN c.name ILIKE '%veterans%' THEN 'healthcare' END, '') AS sectors FROM committees c
""")
def c24(t: Tables):
    return t.committees.select("name", F.array_join(S.committee_sectors("name"), ",").alias("sectors"))


@query("c25_vote_sectors", """
SELECT v.id, b.sector AS related_sector FROM (SELECT l_orderkey * 10 + l_linenumber AS id, 'HR' || (l_orderkey + 3000) || '-119' AS bill FROM lineitem) v
LEFT JOIN bills b ON lower(v.bill) = lower(b.bill_id)
""")
def c25(t: Tables):
    votes = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("HR"), F.col("l_orderkey") + 3000, F.lit("-119")).alias("bill_id"),
        F.lit(None).cast("string").alias("related_sector"),
    )
    bills = t.bills.select("bill_id", S.policy_sector("policy_area").alias("related_sector"))
    return M.propagate(votes, bills, "bill_id", "related_sector").select("id", "related_sector")


@query("c26_latest_publication", """
, pubs AS (SELECT 'hr' || l_orderkey || '-119' AS bill_id, 'BILLS-119hr' || l_orderkey || 'v' || l_linenumber AS package_id,
    l_shipdate AS modified FROM lineitem)
SELECT b.bill_id, p.package_id FROM bills b LEFT JOIN
 (SELECT bill_id, max(package_id) AS package_id FROM (SELECT *, rank() OVER (PARTITION BY bill_id ORDER BY modified DESC) AS r FROM pubs) WHERE r = 1 GROUP BY 1) p USING (bill_id)
""")
def c26(t: Tables):
    pubs = t.lineitem.select(
        F.concat(F.lit("hr"), F.col("l_orderkey"), F.lit("-119")).alias("bill_id"),
        F.concat(F.lit("BILLS-119hr"), F.col("l_orderkey"), F.lit("v"), F.col("l_linenumber")).alias("package_id"),
        F.col("l_shipdate").alias("modified"),
    ).withColumn("version", F.struct("modified", "package_id"))
    return M.latest_metadata(t.bills, pubs, "bill_id", "version", ["package_id"]).select("bill_id", "package_id")


@query("c27_backfill_nulls", """
SELECT bill_id, coalesce(policy_area, CASE WHEN o_totalprice > 100000 THEN 'Animals' END) AS policy_area,
  coalesce(b.url, CASE WHEN o_totalprice > 200000 THEN 'u' || o_orderkey END) AS url,
  (policy_area IS NULL AND o_totalprice > 100000) OR (b.url IS NULL AND o_totalprice > 200000) AS was_filled
FROM bills b JOIN orders ON bill_id = 'hr' || o_orderkey || '-119'
""")
def c27(t: Tables):
    detail = t.orders.select(
        F.concat(F.lit("hr"), F.col("o_orderkey"), F.lit("-119")).alias("bill_id"),
        F.when(F.col("o_totalprice") > 100000, "Animals").alias("policy_area"),
        F.when(F.col("o_totalprice") > 200000, F.concat(F.lit("u"), F.col("o_orderkey"))).alias("url"),
    )
    return M.backfill(t.bills.select("bill_id", "policy_area", "url"), detail, "bill_id", ["policy_area", "url"])


@query("c27_backfill_on_write", """
, f AS (SELECT (policy_area IS NULL AND o_totalprice > 100000) OR (b.url IS NULL AND o_totalprice > 200000) AS was_filled, coalesce(policy_area, CASE WHEN o_totalprice > 100000 THEN 'Animals' END) AS policy_area
  FROM bills b JOIN orders ON bill_id = 'hr' || o_orderkey || '-119')
SELECT count(*) AS total, count(*) FILTER (was_filled) AS enriched, count(policy_area) AS with_area FROM f
""")
def c27w(t: Tables):
    """Enriched rows counted by the job that writes them."""
    table = K.VersionedTable(t.spark, scratch_path(t.spark, "backfilled"))
    counts = W.write_backfilled(c27(t), table.replace)
    return table.read().agg(*[F.lit(n).alias(c) for c, n in counts.items()], F.count("policy_area").alias("with_area"))


WATCH = """
, watch AS (SELECT '#' || lpad(s_suppkey::VARCHAR, 9, '0') AS pattern, s_suppkey AS place, 's' || s_nationkey AS label FROM supplier
  UNION ALL SELECT n_name, 1000000000 + n_nationkey, 'n' || n_regionkey FROM nation),
named AS (SELECT c_custkey, c_name || ' of ' || n_name AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
found AS (SELECT c_custkey, place, label FROM named, watch WHERE contains(lower(name), lower(pattern)))
"""


def _watched(t: Tables):
    """Customers with their country as names; suppliers' numbers and all countries as watched patterns."""
    numbers = t.supplier.select(
        F.concat(F.lit("#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("pattern"), F.col("s_suppkey").cast("long").alias("place"),
        F.concat(F.lit("s"), "s_nationkey").alias("label"))
    countries = t.nation.select(
        F.col("n_name").alias("pattern"), (F.lit(1_000_000_000) + F.col("n_nationkey")).cast("long").alias("place"), F.concat(F.lit("n"), "n_regionkey").alias("label"))
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.concat("c_name", F.lit(" of "), "n_name").alias("name"))
    return named, numbers.unionByName(countries)


@query("c24_pattern_table", WATCH + """
SELECT c_custkey, coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM found f WHERE f.c_custkey = n.c_custkey), '') AS labels FROM named n
""")
def c24p(t: Tables):
    named, watch = _watched(t)
    return P.all_matches(named, "name", watch, "pattern", "label", "labels").select("c_custkey", F.array_join("labels", ",").alias("labels"))


@query("h15_pattern_table", WATCH + "SELECT c_custkey, (SELECT arg_min(label, place) FROM found f WHERE f.c_custkey = n.c_custkey) AS label FROM named n")
def h15p(t: Tables):
    named, watch = _watched(t)
    return P.first_match(named, "name", watch, "pattern", "place", "label", "label").select("c_custkey", "label")


@query("c28_compare_runs", """
SELECT a.trade_id, a.cohort_index AS cohort_index_v1, b.baseline_index AS cohort_index_v2 FROM scored a JOIN scored b USING (trade_id)
""")
def c28(t: Tables):
    first = t.scores.select("trade_id", "cohort_index")
    return M.compare_runs(first, t.scores.select("trade_id", F.col("baseline_index").alias("cohort_index")), "trade_id")


@query("c29_merge_votes", """
, first_src AS (SELECT o_orderkey AS id, 'house' AS chamber, o_orderstatus AS question, 'b' || o_custkey AS bill_id FROM orders WHERE o_orderstatus <> 'F'),
second_src AS (SELECT o_orderkey AS id, 'senate' AS chamber, o_orderpriority AS question, '' AS bill_id FROM orders WHERE o_orderstatus <> 'P'),
merged AS (SELECT * FROM second_src UNION ALL SELECT * FROM first_src WHERE id NOT IN (SELECT id FROM second_src))
SELECT id, chamber, question, CASE WHEN chamber = 'senate' THEN CASE WHEN id % 3 = 0 THEN 's' || id || '-119' END ELSE bill_id END AS bill_id FROM merged
""")
def c29(t: Tables):
    house = t.orders.where("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("id"), F.lit("house").alias("chamber"), F.col("o_orderstatus").alias("question"),
        F.concat(F.lit("b"), F.col("o_custkey")).alias("bill_id"))
    senate = t.orders.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("id"), F.lit("senate").alias("chamber"), F.col("o_orderpriority").alias("question"),
        F.lit("").alias("bill_id"))
    title = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Vote on S. "), F.col("o_orderkey"))).otherwise("No bill")
    extracted = t.orders.select(F.col("o_orderkey").alias("id"), X.bill_id_from_title(title).alias("bill_id"))
    return M.rewrite_where(M.merge_votes(house, senate), extracted, "id", "bill_id", F.col("chamber") == "senate")


@query("c30_report_review", """
SELECT r.trade_id, r.headline, t.ticker, t.trade_type, t.amount_midpoint, p.full_name, t.cohort_index, t.baseline_index
FROM reports r JOIN scored t USING (trade_id) LEFT JOIN politicians p ON p.id = t.politician_id
""")
def c30(t: Tables):
    from ledgerlight.plans.reports import report_review

    return report_review(t.trades, t.scores, t.politicians, t.reports).select(
        "trade_id", "headline", "ticker", "trade_type", "amount_midpoint", "full_name", "cohort_index", "baseline_index"
    )


@query("c20_vote_positions", """
SELECT user_id AS politician_id, event_id % 1000 AS vote_id, min(CASE event_type WHEN 'view' THEN 'Yes' WHEN 'click' THEN 'No' WHEN 'purchase' THEN 'Present' ELSE 'Not Voting' END) AS position
FROM events JOIN customer ON c_custkey = user_id JOIN (SELECT DISTINCT o_orderkey FROM orders) ON o_orderkey = event_id % 1000 GROUP BY 1, 2
""")
def c20p(t: Tables):
    """Positions of two sources; people and votes are found by their natural keys, unknown ones dropped."""
    kind = F.col("event_type")
    word = F.when(kind == "view", "yes").when(kind == "click", "no").when(kind == "purchase", "abstain").otherwise("?")
    raw = t.events.select(
        F.concat(F.lit("B"), "user_id").alias("politician_id"), F.concat(F.lit("V"), F.col("event_id") % 1000).alias("vote_id"), word.alias("position"), kind.alias("kind"))
    people = t.customer.select(F.concat(F.lit("B"), "c_custkey").alias("bioguide_id"), F.col("c_custkey").alias("id"))
    votes = t.orders.select(F.concat(F.lit("V"), "o_orderkey").alias("roll_call_id"), F.col("o_orderkey").alias("id")).distinct()
    return E.resolve_positions([raw.where("kind = 'view'"), raw.where("kind <> 'view'")], people, votes)


@query("c23_memberships", """
SELECT politician_id, committee_id, min(role) AS role FROM memberships GROUP BY 1, 2
""")
def c23m(t: Tables):
    """Seats by natural keys: committee codes differ in letter case and lack their number."""
    code = letters(F.col("committee_id"))
    people = t.supplier.select(F.col("s_name").alias("bioguide_id"), F.col("s_suppkey").alias("id"))
    raw = t.memberships.join(people.withColumnRenamed("id", "politician_id"), "politician_id").select(
        F.col("bioguide_id").alias("politician_id"), code.alias("committee_id"), "role")
    committees = t.committees.select(F.concat(F.lower(letters(F.col("id"))), F.lit("00")).alias("committee_id"), "id")
    return E.resolve_memberships(raw, people, committees)
