"""Scalar functions (H)."""

from pyspark.sql import functions as F

from ledgerlight.catalog.base import Tables, query, trade_key
from ledgerlight.functions import scores as N
from ledgerlight.functions import sectors as S
from ledgerlight.functions import text as X
from ledgerlight.functions import vocab as V
from ledgerlight.plans.features import add_sectors


def pick(index, values):
    """One of a few spellings per row."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def sql_pick(index: str, values) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"[{quoted}][{index} % {len(values)} + 1]"


def key():
    return F.col("o_orderkey")


STATES = ["California", "new york", "TX", "tx", " Ohio ", "Ruritania", "District of Columbia", "puerto rico"]


@query("h01_state_abbrev", f"SELECT o_orderkey, {sql_pick('o_orderkey', ['CA', 'NY', 'TX', 'TX', 'OH', 'RU', 'DC', 'PR'])} AS state FROM orders")
def h01(t: Tables):
    return t.orders.select("o_orderkey", X.state_abbrev(pick(key(), STATES)).alias("state"))


@query("h02_normalisers", f"""
SELECT o_orderkey, {sql_pick('o_orderkey', ['House', 'Senate', 'Joint', 'other'])} AS chamber, {sql_pick('o_orderkey', ['R', 'D', 'I'])} AS party,
 {sql_pick('o_orderkey', ['Yes', 'No', 'Not Voting', 'Present', 'Not Voting'])} AS position, {sql_pick('o_orderkey', ['chair', 'ranking_member', 'vice_chair', 'ex_officio', 'member', 'chair'])} AS role,
 {sql_pick('o_orderkey', ['House', 'Senate', None])} AS office FROM orders
""")
def h02(t: Tables):
    cast = X.vote_cast(pick(key(), ["Yea", "NAY", "Not Voting", "Present", "?"]))
    return t.orders.select(
        "o_orderkey", X.chamber_name(pick(key(), ["house", " SENATE", "joint", "other"])).alias("chamber"),
        X.party_code(pick(key(), ["Republican Party", "Democratic", "Libertarian"])).alias("party"),
        X.vote_position(cast).alias("position"),
        X.seat_role(pick(key(), ["Chairman", "Ranking Member", "Vice Chair", "Ex Officio", "Member", "Chair"])).alias("role"),
        X.office_name(pick(key(), ["H", "S", "P"])).alias("office"))


AMOUNTS = ["$1,001 - $15,000", "$15,001–$50,000", "$1,000,001 - $5,000,000", "Over $5,000,000", "$25,000,001 - $50,000,000", "n/a"]


@query("h03_amount_range", f"""
SELECT o_orderkey, CAST({sql_pick('o_orderkey', [1001, 15001, 1000001, 5000001, 25000001, 1001])} AS BIGINT) AS lower, CAST({sql_pick('o_orderkey', [15000, 50000, 5000000, 50000000, 50000000, 15000])} AS BIGINT) AS upper,
 CAST({sql_pick('o_orderkey', [8000, 32500, 3000000, 27500000, 37500000, 8000])} AS BIGINT) AS midpoint FROM orders
""")
def h03(t: Tables):
    return t.orders.select("o_orderkey", X.amount_range(F.concat(F.lit("x "), pick(key(), AMOUNTS))).alias("a")).select("o_orderkey", "a.*")


ASSETS = ["Acme Corp (AAPL) [ST]", "Thing [msft]", "ticker: goog", "Stock - TSLA shares", "the Big Oil company", "Apple Incorporated", "-- 12345", "(fund) of things"]


@query("h04_ticker_from_text", f"""
SELECT o_orderkey, {sql_pick('o_orderkey', ['AAPL', 'MSFT', 'GOOG', 'TSLA', 'BIG', 'APPLE', None, 'FUND'])} AS house, {sql_pick('o_orderkey', ['AAPL', 'MSFT', 'GOOG', None, None, None, None, 'FUND'])} AS senate FROM orders
""")
def h04(t: Tables):
    text = pick(key(), ASSETS)
    return t.orders.select("o_orderkey", X.ticker_from_text(text).alias("house"), X.labelled_ticker(text, V.SENATE_TICKER).alias("senate"))


@query("h05_company_ticker", f"SELECT o_orderkey, {sql_pick('o_orderkey', ['AAPL', 'META', 'JPM', 'PEP', 'MMM', None])} AS ticker FROM orders")
def h05(t: Tables):
    return t.orders.select("o_orderkey", X.company_ticker(pick(key(), ["Apple Inc", "FACEBOOK class A", "JPMorgan Chase", "PepsiCo", "3M Company", "Acme"])).alias("ticker"))


@query("h06_trade_type", f"""
SELECT o_orderkey, {sql_pick('o_orderkey', ['buy', 'sell', 'sell', 'buy', 'exchange', None])} AS house, {sql_pick('o_orderkey', ['buy', None, 'sell', None, 'exchange', None])} AS senate FROM orders
""")
def h06(t: Tables):
    text = pick(key(), ["Purchase", "S", "Sale (Partial)", "P", "Exchange", "XYZ"])
    return t.orders.select("o_orderkey", X.trade_type(text).alias("house"), X.trade_type_contained(text).alias("senate"))


@query("h07_parse_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 5 THEN CAST(o_orderdate AS DATE) END AS day FROM orders
""")
def h07(t: Tables):
    day = F.to_date("o_orderdate")
    forms = [
        day.cast("string"), F.date_format(day, "M/d/yyyy"), F.date_format(day, "MM-dd-yyyy"), F.concat(F.date_format(day, "MMMM d, yyyy"), F.lit(",  02:54 PM")),
        F.concat(day.cast("string"), F.lit("T23:30:00Z")), F.lit("soon"), F.concat(F.date_format(day, "yyyy-M-d"), F.lit("")),
    ]
    text = forms[-1]
    for i, form in enumerate(forms[:-1]):
        text = F.when(key() % 7 == i, form).otherwise(text)
    return t.orders.select("o_orderkey", X.parse_date(text).alias("day"))


@query("h08_bill_number_parts", "SELECT bill_id, 'HR' AS bill_type, CAST(bill_number[3:] AS INT) AS number FROM bills")
def h08(t: Tables):
    part = X.bill_number_parts("bill_number")
    return t.bills.select("bill_id", part["bill_type"].alias("bill_type"), part["bill_number"].alias("number"))


@query("h09_bill_from_title", f"""
SELECT o_orderkey, {sql_pick('o_orderkey', ['s', 'hr', 'sjres', 'hconres', None])} || o_orderkey || '-119' AS bill_id FROM orders
""")
def h09(t: Tables):
    title = F.concat(pick(key(), ["Motion: S. ", "On H.R. ", "S.J.Res. ", "To agree to h.con.res. ", "Nomination PN"]), key())
    return t.orders.select("o_orderkey", X.bill_id_from_title(title).alias("bill_id"))


@query("h10_bill_from_package", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE {sql_pick('o_orderkey', ['hr', 's', 'hjres', 'x'])} || o_orderkey || '-119' END AS bill_id FROM orders
""")
def h10(t: Tables):
    package = F.concat(pick(key(), ["BILLS-119hr", "BILLS-119S", "bills-119hjres", "INVALID"]), key(), pick(key(), ["eas", "is", "ih", ""]))
    return t.orders.select("o_orderkey", X.bill_id_from_package(package).alias("bill_id"))


@query("h11_congress_of_roll_call", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(100 + o_orderkey % 20 AS INT) END AS congress FROM orders")
def h11(t: Tables):
    roll = F.when(key() % 3 == 0, F.concat(F.lit("house-"), 100 + key() % 20, F.lit("-42"))).when(key() % 3 == 1, "house").otherwise("senate-x-1")
    return t.orders.select("o_orderkey", X.congress_of_roll_call(roll).alias("congress"))


@query("h12_policy_sector", """
SELECT bill_id, sector, CASE sector WHEN 'tech' THEN 'Commerce,Science, Technology, Communications' WHEN 'energy' THEN 'Energy,Environmental Protection,Public Lands and Natural Resources,Water Resources Development'
 WHEN 'defense' THEN 'Armed Forces and National Security,Defense,Emergency Management,International Affairs,Transportation and Public Works'
 WHEN 'healthcare' THEN 'Civil Rights and Liberties, Minority Issues,Education,Families,Health,Social Welfare'
 WHEN 'finance' THEN 'Economics and Public Finance,Finance and Financial Sector,Foreign Trade and International Finance,Housing and Community Development,Labor and Employment,Taxation' ELSE '' END AS areas FROM bills
""")
def h12(t: Tables):
    sector = X.as_col(S.policy_sector("policy_area"))
    areas = S.policy_areas_of(F.array_compact(F.array(sector)))
    return t.bills.select("bill_id", sector.alias("sector"), F.array_join(F.array_sort(areas), ",").alias("areas"))


@query("h13_parse_sector", "SELECT trade_id, array_to_string(sectors, '|') AS sectors FROM trades")
def h13(t: Tables):
    return t.trades.select("trade_id", F.array_join(S.parse_sector("industry_sector"), "|").alias("sectors"))


@query("h14_committee_tag", """
SELECT name, CASE WHEN name ILIKE '%armed services%' OR name ILIKE '%intelligence%' THEN 'defense' WHEN name ILIKE '%finance%' THEN 'finance' WHEN name ILIKE '%energy and natural resources%' THEN 'energy' END AS tag FROM committees
""")
def h14(t: Tables):
    return t.committees.select("name", S.committee_tag("name").alias("tag"))


EMPLOYERS = ["First Bank of X", "Lockheed Martin", "City Hospital", "Power Co", "Data Systems", "AT&T", "Food Mart", "Acme"]


@query("h15_employer_sector", f"SELECT o_orderkey, {sql_pick('o_orderkey', ['finance', 'defense', 'healthcare', 'energy', 'tech', 'telecom', 'agriculture', None])} AS sector FROM orders")
def h15(t: Tables):
    return t.orders.select("o_orderkey", S.employer_sector(pick(key(), EMPLOYERS)).alias("sector"))


H16_MAP = "translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"


@query("h16_resolve_sectors", f"""
, m AS (SELECT {H16_MAP} AS ticker, p_type AS sector FROM part WHERE p_size > 25)
SELECT t.trade_id, array_to_string(CASE WHEN t.line_number = 1 THEN ['bridged'] WHEN len(t.sectors) > 0 THEN t.sectors WHEN m.sector IS NOT NULL THEN [m.sector] ELSE [] END, ',') AS score_mode,
  array_to_string(CASE WHEN m.sector IS NOT NULL THEN [m.sector] ELSE t.sectors END, ',') AS load_mode FROM trades t LEFT JOIN m USING (ticker)
""")
def h16(t: Tables):
    from ledgerlight.catalog.base import letters

    mapping = t.part.select(F.when(F.col("p_size") > 25, letters(F.col("p_partkey"))).alias("ticker"), F.col("p_type").alias("sector"))
    bridge = t.lineitem.where("l_linenumber = 1").select(
        trade_key().alias("trade_id"), F.lit("bridged").alias("sector"))
    rows = t.trades.select("trade_id", "ticker", "industry_sector")
    score = add_sectors(rows, bridge, mapping).select("trade_id", F.array_join("sectors", ",").alias("score_mode"))
    load = add_sectors(rows, None, mapping, mode="load").select("trade_id", F.array_join("sectors", ",").alias("load_mode"))
    return score.join(load, "trade_id")


@query("h17_ticker_map_overrides", f"""
, b AS (SELECT CASE p_partkey WHEN 1 THEN 'MSFT' WHEN 2 THEN 'SPY' WHEN 3 THEN 'GE' ELSE 'P' || {H16_MAP} END AS ticker, p_type AS sector FROM part)
SELECT ticker, CASE ticker WHEN 'MSFT' THEN '["tech", "defense"]' WHEN 'GE' THEN '["defense", "energy", "healthcare"]' ELSE sector END AS sector FROM b
UNION ALL SELECT * FROM (VALUES {", ".join(f"('{fund}', '{sector}')" for fund, sector in V.FUND_TICKERS.items())}) AS added(ticker, sector) WHERE ticker NOT IN (SELECT ticker FROM b)
""")
def h17(t: Tables):
    from ledgerlight.catalog.base import letters

    key = F.col("p_partkey")
    base = t.part.select(
        F.when(key == 1, "MSFT").when(key == 2, "SPY").when(key == 3, "GE").otherwise(F.concat(F.lit("P"), letters(key))).alias("ticker"), F.col("p_type").alias("sector"))
    return S.ticker_map(t.spark, base)


@query("h18_excess_return", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax <> 0 AND l_quantity <> 10 THEN (l_discount - l_tax) / l_tax - (l_extendedprice - l_quantity) / l_quantity END AS alpha FROM lineitem
""")
def h18(t: Tables):
    alpha = N.excess_return("l_tax", "l_discount", F.when(F.col("l_quantity") != 10, F.col("l_quantity")), "l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", alpha.alias("alpha"))


@query("h19_disclosure_lag_feature", """
SELECT trade_id, greatest(0, least(365, CASE WHEN line_number = 1 THEN 0 ELSE disclosure_lag_days * 9 - 200 END)) AS clipped,
 round(ln(1 + greatest(0, least(365, CASE WHEN line_number = 1 THEN 0 ELSE disclosure_lag_days * 9 - 200 END))), 6) AS logged FROM trades
""")
def h19(t: Tables):
    days = F.when(F.split("trade_id", "-").getItem(1) != "1", F.col("disclosure_lag_days") * 9 - 200)
    return t.trades.select("trade_id", N.clipped_lag(days).alias("clipped"), F.round(N.log_lag(days), 6).alias("logged"))


@query("h20_amount_zscore", """
, s AS (SELECT politician_id, avg(ln(amount_midpoint + 1)) AS m, stddev_pop(ln(amount_midpoint + 1)) AS sd FROM trades GROUP BY 1 HAVING count(*) >= 5)
SELECT trade_id, round(CASE WHEN sd > 0 THEN (ln(CASE WHEN line_number = 2 THEN 8000 ELSE amount_midpoint END + 1) - m) / sd ELSE 0 END, 6) AS z FROM trades LEFT JOIN s USING (politician_id)
""")
def h20(t: Tables):
    from ledgerlight.operators.analytics import amount_stats
    from ledgerlight.operators.lookup import enrich

    rows = enrich(t.trades.select("trade_id", "politician_id", "amount_midpoint"), amount_stats(t.trades).drop("n_trades"), ["politician_id"])
    amount = F.when(F.split("trade_id", "-").getItem(1) != "2", F.col("amount_midpoint"))
    return rows.select("trade_id", F.round(N.amount_zscore(amount, "log_amt_mean", "log_amt_std"), 6).alias("z"))


@query("h21_index_and_quadrant", """
, r AS (SELECT trade_id, (line_number - 4) / 8.0::DOUBLE AS raw FROM trades),
i AS (SELECT trade_id, CAST(floor((-greatest(-0.5, least(0.5, raw)) + 0.5) * 100) AS INT) AS idx FROM r)
SELECT s.trade_id, i.idx, CASE WHEN i.idx >= 60 AND baseline_index >= 60 THEN 'SEVERE' WHEN baseline_index >= 60 THEN 'SYSTEMIC' WHEN i.idx >= 60 THEN 'OUTLIER' ELSE 'UNREMARKABLE' END AS quadrant,
 i.idx >= 70 OR baseline_index >= 70 AS audit, CASE WHEN i.idx >= 60 AND baseline_index >= 60 THEN 'very_high' WHEN baseline_index >= 60 THEN 'high' WHEN i.idx >= 60 THEN 'medium' ELSE 'low' END AS risk
FROM scored s JOIN i USING (trade_id)
""")
def h21(t: Tables):
    raw = (F.split("trade_id", "-").getItem(1).cast("double") - 4) / 8
    rows = t.scores.withColumn("idx", N.index_from_raw(raw))
    place = N.quadrant("idx", "baseline_index")
    return rows.select("trade_id", "idx", place.alias("quadrant"), N.audit_flag("idx", "baseline_index").alias("audit"), N.risk_level(F.lower(place)).alias("risk"))


@query("h22_urls", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'https://disclosures-clerk.house.gov/public_disc/ptr-pdfs/' || o_orderkey || '.pdf' END AS filing,
 'https://www.congress.gov/bill/119th-congress/' || {sql_pick('o_orderkey', ['house-bill', 'senate-bill', 'house-joint-resolution', 'senate-joint-resolution', None])} || '/' || o_orderkey AS bill FROM orders
""")
def h22(t: Tables):
    doc = F.when(key() % 5 != 0, key().cast("string"))
    return t.orders.select("o_orderkey", X.filing_url(doc).alias("filing"), X.bill_url(pick(key(), ["hr", "S", "hjres", "sjres", "x"]), key()).alias("bill"))


@query("h23_bill_links", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'H.R. ' || o_orderkey || '=https://www.congress.gov/bill/119th-congress/house-bill/' || o_orderkey || ';S. 5=https://www.congress.gov/bill/119th-congress/senate-bill/5'
 WHEN 1 THEN 'S.Res. ' || o_orderkey || '=https://www.congress.gov/bill/119th-congress/senate-bill/' || o_orderkey ELSE '' END AS links FROM orders
""")
def h23(t: Tables):
    text = F.when(key() % 3 == 0, F.concat(F.lit("See H.R. "), key(), F.lit(" and S. 5, again H.R. "), key())).when(
        key() % 3 == 1, F.concat(F.lit("Also S.Res. "), key(), F.lit("."))).otherwise("Nothing here")
    links = F.transform(X.bill_links(text), lambda x: F.concat_ws("=", x["label"], x["url"]))
    return t.orders.select("o_orderkey", F.array_join(links, ";").alias("links"))


@query("h24_truncate_and_json", """
SELECT event_id, left(props, 6) AS head, CAST(props ->> '$.k' AS INT) AS k, CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 0 ELSE 0 END AS items FROM events
""")
def h24(t: Tables):
    key = F.col("event_id") % 3
    listed = F.when(key == 0, F.lit("[1, 2]")).when(key == 1, F.lit("[]"))
    return t.events.select(
        "event_id", X.truncate_text("props", 6).alias("head"), F.get_json_object("props", "$.k").cast("int").alias("k"), X.json_items(listed).alias("items"))


@query("h25_unfence_json", "SELECT event_id, CAST(props ->> '$.k' AS INT) AS k FROM events")
def h25(t: Tables):
    key = F.col("event_id") % 3
    raw = F.when(key == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(key == 1, F.concat(F.lit(" ```"), F.col("props"), F.lit("``` "))).otherwise(F.col("props"))
    return t.events.select("event_id", F.from_json(X.unfence_json(raw), "k int")["k"].alias("k"))


@query("h26_identifier_cleanup", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS cik, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'C' || lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0') END AS cusip FROM orders WHERE o_custkey > 0
""")
def h26(t: Tables):
    accession = F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-23-000012"))
    cusip = F.when(key() % 4 == 0, " C12 ").otherwise(F.concat(F.lit(" C"), F.lpad((key() % 100000000).cast("string"), 8, "0"), F.lit("XYZ ")))
    return t.orders.where("o_custkey > 0").select("o_orderkey", X.cik_of_accession(accession).alias("cik"), X.clean_cusip(cusip).alias("cusip"))


@query("h27_position_change", """
, x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber < 3 THEN 0 ELSE l_quantity END AS a, CASE WHEN l_linenumber IN (2, 3) THEN 0 WHEN l_linenumber = 4 THEN l_quantity ELSE l_suppkey END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a = 0 AND b > 0 THEN 'new_position' WHEN b = 0 AND a > 0 THEN 'exit_position' WHEN b > a THEN 'increase' WHEN b < a THEN 'decrease' ELSE 'unchanged' END AS direction FROM x
""")
def h27(t: Tables):
    line = F.col("l_linenumber")
    prior = F.when(line < 3, 0).otherwise(F.col("l_quantity"))
    current = F.when(line.isin(2, 3), 0).when(line == 4, F.col("l_quantity")).otherwise(F.col("l_suppkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.position_change(prior, current).alias("direction"))


def filings(t: Tables):
    """One filing per order."""
    return t.orders.select(
        key().cast("string").alias("doc_id"), F.concat(F.lit("First"), F.col("o_custkey"), F.lit(" Last")).alias("full_name"),
        F.concat(F.lit("First"), F.col("o_custkey")).alias("first_name"), F.lit("Last").alias("last_name"), F.lit("XX01").alias("state_district"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("filing_date"))


H28_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 0 AS position, 'AAPL' AS ticker, 'buy' AS trade_type, CAST(o_orderdate AS DATE) AS trade_date, CAST(o_orderdate AS DATE) + 30 AS disclosure_date, 32500 AS amount_midpoint, 'First' || o_custkey || ' Last' AS politician_name FROM orders WHERE o_orderkey % 4 < 3
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, 'MSFT', 'sell', NULL, CAST(o_orderdate AS DATE), 8000, 'First' || o_custkey || ' Last' FROM orders WHERE o_orderkey % 4 = 2
"""


@query("h28_trades_from_text", H28_SQL)
def h28(t: Tables):
    from ledgerlight.sources.disclosures import trades_from_text

    day, later = F.date_format("o_orderdate", "MM/dd/yyyy"), F.date_format(F.date_add(F.to_date("o_orderdate"), 30), "MM/dd/yyyy")
    first = F.concat(F.lit("Filing\n\n"), day, F.lit("\nAcme Corp $15,001 - $50,000\nnoted "), later, F.lit("\nApple (AAPL)\n  Purchase\n"))
    second = F.when(key() % 4 == 2, "Microsoft [MSFT] sale (full)\nend").otherwise("no more")
    text = F.when(key() % 4 < 3, F.concat(first, second)).otherwise("nothing to see\nat all")
    docs = t.orders.select(key().alias("doc_id"), text.alias("text"))
    return trades_from_text(docs, filings(t)).select(
        "doc_id", "position", "ticker", "trade_type", "trade_date", "disclosure_date", "amount_midpoint", "politician_name")


@query("h29_trades_from_house_tables", """
SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 0 AS position, 'AAPL' AS ticker, 'buy' AS trade_type, CAST(o_orderdate AS DATE) AS trade_date, CAST(o_orderdate AS DATE) + 9 AS disclosure_date, 8000 AS amount_midpoint FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 2, 'GE', 'sell', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE), 175000 FROM orders
""")
def h29(t: Tables):
    from ledgerlight.sources.disclosures import trades_from_tables

    day, later = F.date_format("o_orderdate", "MM/dd/yyyy"), F.date_format(F.date_add(F.to_date("o_orderdate"), 9), "MM/dd/yyyy")

    def row(*cells):
        return F.array(*[F.lit(c) if c is None or isinstance(c, str) else c for c in cells])

    cells = F.array(
        row("Report", "page 1", "", "", ""), row("Owner", "Asset", "Transaction Type", "Date", "Notification Date", "Amount"),
        row("SP", "Apple Inc. (AAPL)", "P", day, later, "$1,001 - $15,000"), row("", "", "", "", "", ""),
        row("JT", "General Electric [GE]", "S (partial)", day, "", "$100,001 - $250,000"), row("JT", "12345", "P", day, "", ""))
    return trades_from_tables(t.orders.select(key().alias("doc_id"), cells.alias("cells")), filings(t)).select(
        "doc_id", "position", "ticker", "trade_type", "trade_date", "disclosure_date", "amount_midpoint")


@query("h29_trades_from_senate_tables", """
SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 0 AS position, 'AAPL' AS ticker, 'buy' AS trade_type, CAST(o_orderdate AS DATE) AS trade_date, CAST(o_orderdate AS DATE) AS disclosure_date, 27500000 AS amount_midpoint FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, 'XOM', 'sell', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE), 8000 FROM orders
""")
def h29s(t: Tables):
    from ledgerlight.sources.disclosures import trades_from_tables

    day = F.date_format("o_orderdate", "MM/dd/yyyy")

    def row(*cells):
        return F.array(*[F.lit(c) if c is None or isinstance(c, str) else c for c in cells])

    cells = F.array(
        row("#", "Transaction Date", "Owner", "Ticker", "Asset Name", "Asset Type", "Type", "Amount", "Comment"),
        row("1", day, "Self", "aapl", "Apple", "Stock", "Purchase", "Over $5,000,000", "--"),
        row("2", day, "Self", "--", "Exxon Mobil", "Stock", "Sale (Full)", "n/a", ""),
        row("3", day, "Self", "--", "Some City", "Municipal Bond", "Purchase", "", ""),
        row("4", day, "Self", "MSFT", "Microsoft", "Stock", "Gift", "", ""))
    return trades_from_tables(t.orders.select(key().alias("doc_id"), cells.alias("cells")), filings(t), "senate").select(
        "doc_id", "position", "ticker", "trade_type", "trade_date", "disclosure_date", "amount_midpoint")
