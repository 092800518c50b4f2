"""Sources and sinks (A): a driver table is written in the source's format and read back."""

from pyspark.sql import functions as F

from ledgerlight.catalog.base import Tables, letters, query
from ledgerlight.sources import documents as D
from ledgerlight.sources import quarters as S
from ledgerlight.sources import sinks as K
from ledgerlight.sources import tabular as R
from ledgerlight.session import scratch_path
from ledgerlight.streaming import landing as L


def _json(t: Tables, df, name: str) -> str:
    path = scratch_path(t.spark, name)
    df.write.json(path)
    return path


@query("a01_csv_scan", "SELECT o_orderkey::VARCHAR AS id, 119 AS congress, o_orderstatus AS title, CAST(o_orderdate AS DATE) AS latest_action_date, NULL::VARCHAR AS url FROM orders")
def a01(t: Tables):
    path = scratch_path(t.spark, "bills_csv")
    t.orders.select(
        F.col("o_orderstatus").alias("title"), F.col("o_orderkey").alias("bill_key"), F.lit(119).alias("congress"),
        F.to_date("o_orderdate").alias("latest_action_date")).write.option("header", True).csv(path)
    schema = "id string, congress int, title string, latest_action_date date, url string"
    return R.read_raw(t.spark, path, schema, {"bill_key": "id"})


@query("a02_price_folder", "SELECT 'X' || o_custkey % 40 AS ticker, CAST(o_orderdate AS DATE) AS price_date, CAST(round(o_totalprice, 4) AS DOUBLE) AS close, o_orderkey AS volume FROM orders")
def a02(t: Tables):
    folder = scratch_path(t.spark, "prices")
    group = F.col("o_custkey") % 40
    for odd, (date, close, volume) in enumerate([("Date", "Close", "Volume"), ("date", "CLOSE", "volume")]):
        # Two spellings and orders of the header in one folder.
        columns = [F.col("o_orderkey").alias(volume), F.to_date("o_orderdate").cast("string").alias(date), F.format_string("%.4f", "o_totalprice").alias(close)]
        rows = t.orders.where(group % 2 == odd).select(*(columns if odd else columns[::-1]), F.concat(F.lit("x"), group).alias("ticker"))
        rows.write.mode("append").partitionBy("ticker").option("header", True).csv(folder)
    prices = R.read_prices(t.spark, f"{folder}/*")
    return prices.select("ticker", "price_date", F.col("close").cast("double").alias("close"), "volume")


@query("a03_header_normalisation", "SELECT o_orderkey::VARCHAR AS cusip, o_orderstatus AS issuer_name, o_custkey AS shares FROM orders")
def a03(t: Tables):
    odd = t.orders.select(F.col("o_orderkey").cast("string").alias("CUSIP"), F.col("o_orderstatus").alias("NameOfIssuer"), F.col("o_custkey").alias(" SSHPRNAMT "))
    return R.normalize_columns(odd, R.HOLDING_COLUMNS)


@query("a04_lenient_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END AS amount FROM orders")
def a04(t: Tables):
    from ledgerlight.functions.text import lenient_number

    text = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, "n/a")).otherwise(F.col("o_totalprice").cast("string"))
    return t.orders.select("o_orderkey", lenient_number(text).alias("amount"))


HOLD = "SELECT l_suppkey::VARCHAR AS cik, 'C' || l_partkey AS cusip, l_quantity AS shares, year(l_shipdate)::INT AS year, quarter(l_shipdate)::INT AS quarter"


@query("a05_holdings_folder", HOLD + ", CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INT) AS period FROM lineitem")
def a05(t: Tables):
    folder = scratch_path(t.spark, "holdings")
    day = F.col("l_shipdate")
    rows = t.lineitem.select(
        F.concat(F.lpad(F.col("l_suppkey").cast("string"), 10, "0"), F.lit("-23-0001")).alias("ACCESSION_NUMBER"),
        F.concat(F.lit("C"), F.col("l_partkey")).alias("cusip"), F.lit("Issuer, Inc").alias("issuer_name"), F.lit("SH").alias("share_type"),
        F.col("l_quantity").alias("shares"), F.concat(F.year(day), F.lit("q"), F.quarter(day), F.lit("_holdings")).alias("q"))
    rows.write.partitionBy("q").option("header", True).csv(folder)
    return R.read_holdings(t.spark, f"{folder}/*").select(
        F.when(F.col("cik") == "", "0").otherwise(F.col("cik")).alias("cik"), "cusip", F.col("shares").cast("double").alias("shares"), "year", "quarter", "period")


@query("a06_bulk_extract", "SELECT l_suppkey::VARCHAR AS cik, 'C' || l_partkey AS cusip FROM lineitem WHERE l_suppkey IN (7, 11, 42)")
def a06(t: Tables):
    bulk = t.lineitem.select(
        F.concat(F.lpad(F.col("l_suppkey").cast("string"), 10, "0"), F.lit("-23-000012")).alias("ACCESSION_NUMBER"), F.concat(F.lit("C"), F.col("l_partkey")).alias("CUSIP"))
    return R.extract_holdings(bulk, {"7": "a", "11": "b", "42": "c"}).select("cik", "cusip")


@query("a07_sector_dictionary", """
SELECT translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS ticker, CASE WHEN p_size > 25 THEN p_type || '|' || p_brand ELSE p_type END AS sectors FROM part
""")
def a07(t: Tables):
    path = scratch_path(t.spark, "sector_map")
    value = F.when(F.col("p_size") > 25, F.to_json(F.array("p_type", "p_brand"))).otherwise(F.concat(F.lit('"'), F.col("p_type"), F.lit('"')))
    entry = F.concat(F.lit('{"'), letters(F.col("p_partkey")), F.lit('": '), value, F.lit("}"))
    t.part.select(entry.alias("value")).write.text(path)
    return R.read_sector_map(t.spark, path, one_per_line=True).select("ticker", F.array_join("sectors", "|").alias("sectors"))


def _roll_calls(t: Tables) -> str:
    path = scratch_path(t.spark, "roll_calls")
    def member(key):
        return F.struct(
            F.concat(F.lit("S"), key).alias("lis_member_id"), F.lit("Last").alias("last_name"), F.lit("First").alias("first_name"), F.lit("D").alias("party"),
            F.lit("TX").alias("state"), F.when(key % 3 == 0, "Yea").when(key % 3 == 1, "Not Voting").otherwise("Nay").alias("vote_cast"))

    votes = t.orders.select(
        F.lit("119").alias("congress"), F.lit("1").alias("session"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("vote_number"),
        F.lit("January 9, 2025,  02:54 PM").alias("vote_date"), F.lit("On Passage").alias("question"), F.lit("Passed").alias("vote_result"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("S. "), F.col("o_orderkey"))).alias("vote_title"),
        F.struct(F.array(member(F.col("o_custkey")), member(F.col("o_custkey") + 1)).alias("member")).alias("members"))
    votes.write.format("xml").option("rowTag", "roll_call_vote").option("rootTag", "votes").save(path)
    return path


@query("a08_roll_call_xml", """
SELECT 'senate-119-1-' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'S. ' || o_orderkey ELSE 'Passed' END AS description, CAST(2 AS BIGINT) AS members FROM orders
""")
def a08(t: Tables):
    votes = D.read_roll_calls(t.spark, _roll_calls(t))
    return votes.select("id", "description", F.size("members").cast("long").alias("members"))


@query("a08_roll_call_positions", """
, m AS (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]) AS k FROM orders)
SELECT 'senate-119-1-' || o_orderkey AS vote_id, 'S' || k AS lis_member_id, CASE WHEN k IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) THEN 'B' || k ELSE '' END AS politician_id,
  CASE k % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'not_voting' ELSE 'no' END AS position FROM m
""")
def a08p(t: Tables):
    key = F.col("c_custkey")
    lis = t.customer.select(F.when(key % 2 == 0, F.concat(F.lit("S"), key)).alias("lis_member_id"), F.concat(F.lit("B"), key).alias("bioguide_id"))
    votes = D.read_roll_calls(t.spark, _roll_calls(t))
    return D.roll_call_positions(votes, lis).select("vote_id", "lis_member_id", "politician_id", "position")


@query("a09_filing_index_xml", "SELECT c_custkey::VARCHAR AS doc_id, 'First' || c_custkey || ' ' || c_mktsegment AS full_name FROM customer WHERE c_nationkey % 3 < 2")
def a09(t: Tables):
    path = scratch_path(t.spark, "filings")
    kind = F.when(F.col("c_nationkey") % 3 == 0, "P").when(F.col("c_nationkey") % 3 == 1, "ptr").otherwise("C")
    t.customer.select(
        F.lit("Hon.").alias("Prefix"), F.col("c_mktsegment").alias("Last"), F.concat(F.lit("First"), F.col("c_custkey")).alias("First"), kind.alias("FilingType"),
        F.lit("TX01").alias("StateDst"), F.lit("2024").alias("Year"), F.lit("1/2/2024").alias("FilingDate"), F.col("c_custkey").cast("string").alias("DocID"),
    ).write.format("xml").option("rowTag", "Member").option("rootTag", "FinancialDisclosure").save(path)
    return D.read_filing_index(t.spark, path).select("doc_id", "full_name")


@query("a10_flatten_members", """
SELECT c_custkey::VARCHAR AS id, c_name AS full_name, CASE c_nationkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'D' ELSE 'I' END AS party, CASE WHEN c_custkey % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber, (c_nationkey + 1)::VARCHAR AS district FROM customer
""")
def a10(t: Tables):
    party = F.when(F.col("c_nationkey") % 3 == 0, "Republican").when(F.col("c_nationkey") % 3 == 1, "Democratic").otherwise("Independent")
    latest = F.when(F.col("c_custkey") % 2 == 0, "House of Representatives").otherwise("Senate")

    def term(chamber, district):
        return F.struct(chamber.alias("chamber"), district.cast("string").alias("district"))

    members = t.customer.select(
        F.col("c_custkey").cast("string").alias("bioguideId"), F.col("c_name").alias("name"), party.alias("partyName"),
        F.struct(F.array(term(F.lit("Senate"), F.lit(0)), term(latest, F.col("c_nationkey") + 1)).alias("item")).alias("terms"))
    raw = D.read_json(t.spark, _json(t, members, "members"), D.MEMBERS)
    return D.flatten_members(raw).select("id", "full_name", "party", "chamber", "district")


@query("a10_flatten_bills", """
SELECT 'hr' || o_orderkey || '-119' AS id, 'HR' || o_orderkey AS bill_number, CASE WHEN o_orderstatus = 'F' THEN 'Health' END AS policy_area, CASE WHEN o_orderstatus = 'F' THEN 'healthcare' END AS related_sector,
  CASE WHEN o_orderstatus = 'F' THEN 'detail' ELSE 'listed' END AS latest_action, CASE WHEN o_orderstatus = 'F' THEN 'B' || o_custkey END AS sponsor_bioguide FROM orders
""")
def a10b(t: Tables):
    def action(text):
        return F.struct(F.lit(text).alias("text"), F.lit("2025-01-01").alias("actionDate")).alias("latestAction")

    base = [F.lit("HR").alias("type"), F.col("o_orderkey").cast("string").alias("number"), F.lit(119).alias("congress")]
    listed = t.orders.select(*base, F.lit("t").alias("title"), action("listed"))
    detail = t.orders.where("o_orderstatus = 'F'").select(
        *base, F.struct(F.lit("Health").alias("name")).alias("policyArea"), action("detail"), F.array(F.struct(F.concat(F.lit("B"), F.col("o_custkey")).alias("bioguideId"))).alias("sponsors"))
    out = D.flatten_bills(D.read_json(t.spark, _json(t, listed, "bills"), D.BILLS), D.read_json(t.spark, _json(t, detail, "details"), D.BILL_DETAILS))
    return out.select("id", "bill_number", "policy_area", "related_sector", "latest_action", "sponsor_bioguide")


@query("a10_flatten_bill_records", """
SELECT 'hr' || o_orderkey || '-119' AS id, 'HR' || o_orderkey AS bill_number, CASE WHEN o_orderstatus = 'F' THEN 'Health' END AS policy_area, CASE WHEN o_orderstatus = 'F' THEN 'healthcare' END AS related_sector,
  CASE WHEN o_orderstatus = 'F' THEN 'detail' ELSE 'listed' END AS latest_action, CASE WHEN o_orderstatus = 'F' THEN 'B' || o_custkey END AS sponsor_bioguide,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS priority, CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS cosponsors FROM orders
""")
def a10_records(t: Tables):
    """`count` is a number in some records and a word in others; `priority` is known to no schema."""
    def action(text):
        return F.struct(F.lit(text).alias("text"), F.lit("2025-01-01").alias("actionDate")).alias("latestAction")

    base = [F.lit("HR").alias("type"), F.col("o_orderkey").cast("string").alias("number"), F.lit(119).alias("congress")]
    count = F.when(F.col("o_orderstatus") == "O", "many").otherwise(F.col("o_custkey").cast("string"))
    listed = t.orders.select(*base, F.lit("t").alias("title"), action("listed"), count.alias("count"))
    detail = t.orders.where("o_orderstatus = 'F'").select(
        *base, F.struct(F.lit("Health").alias("name")).alias("policyArea"), action("detail"), F.col("o_orderpriority").alias("priority"),
        F.array(F.struct(F.concat(F.lit("B"), F.col("o_custkey")).alias("bioguideId"))).alias("sponsors"))
    out = D.flatten_bill_records(
        D.read_variant(t.spark, _json(t, listed, "bills")), D.read_variant(t.spark, _json(t, detail, "details")),
        {"priority": ("$.priority", "string"), "cosponsors": ("$.count", "long")},
    )
    return out.select("id", "bill_number", "policy_area", "related_sector", "latest_action", "sponsor_bioguide", "priority", "cosponsors")


@query("a11_flatten_finance", """
SELECT c_custkey::VARCHAR AS candidate_id, CASE WHEN c_custkey % 2 = 0 THEN 'House' ELSE 'Senate' END AS office, CASE WHEN c_custkey % 3 > 0 THEN 'C' || c_nationkey END AS principal_committee_id, c_acctbal AS amount, c_mktsegment AS committee_name FROM customer
""")
def a11(t: Tables):
    key = F.col("c_custkey")
    candidates = t.customer.select(
        key.cast("string").alias("candidate_id"), F.when(key % 2 == 0, "H").otherwise("S").alias("office"),
        F.when(key % 3 > 0, F.array(F.struct(F.concat(F.lit("C"), F.col("c_nationkey")).alias("committee_id")))).otherwise(F.array().cast("array<struct<committee_id:string>>")).alias("principal_committees"))
    paid = t.customer.select(
        key.cast("string").alias("candidate_id"), F.col("c_acctbal").alias("contribution_receipt_amount"), F.struct(F.col("c_mktsegment").alias("name")).alias("committee"))
    left = D.flatten_candidates(D.read_json(t.spark, _json(t, candidates, "candidates"), D.CANDIDATES)).select("candidate_id", "office", "principal_committee_id")
    right = D.flatten_contributions(D.read_json(t.spark, _json(t, paid, "paid"), D.CONTRIBUTIONS)).select("candidate_id", "amount", "committee_name")
    return left.join(right, "candidate_id")


@query("a12_pruned_scan", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 45")
def a12(t: Tables):
    return R.read_table(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_partkey"], "l_quantity > 45")


@query("a13_reload_table", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def a13(t: Tables):
    table = K.VersionedTable(t.spark, scratch_path(t.spark, "reload"))
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    table.replace(rows)
    table.replace(rows.where("o_orderstatus = 'F'"))
    return table.read()


@query("a14_append_scores", "SELECT trade_id, cohort_index FROM scored")
def a14(t: Tables):
    from ledgerlight.streaming.incremental import unscored

    table = K.VersionedTable(t.spark, scratch_path(t.spark, "scores"))
    K.write_scores(table, t.scores.where("feat_cluster_score < 3").select("trade_id", "cohort_index"))
    K.write_scores(table, unscored(t.scores, table.read()).select("trade_id", "cohort_index"))
    return table.read()


@query("a15_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS v FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority = '1-URGENT'")
def a15(t: Tables):
    table = K.VersionedTable(t.spark, scratch_path(t.spark, "upsert"))
    key = F.col("o_orderkey").alias("id")
    table.replace(t.orders.where("o_orderstatus = 'O' or o_orderpriority = '1-URGENT'").select(key, F.lit("old").alias("v")))
    table.upsert(t.orders.where("o_orderstatus = 'F'").select(key, F.lit("new").alias("v")), ["id"])
    return table.read()


@query("a16_insert_ignore", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS v FROM orders WHERE o_orderstatus <> 'P'")
def a16(t: Tables):
    table = K.VersionedTable(t.spark, scratch_path(t.spark, "ignore"))
    key = F.col("o_orderkey").alias("id")
    table.replace(t.orders.where("o_orderstatus = 'O'").select(key, F.lit("old").alias("v")))
    table.insert_ignore(t.orders.where("o_orderstatus <> 'P'").select(key, F.lit("new").alias("v")), ["id"])
    return table.read()


@query("a17_matrix_sink", "SELECT trade_id, feat_amount_zscore FROM scored")
def a17(t: Tables):
    path = scratch_path(t.spark, "matrix")
    K.write_matrix(t.scores.select("trade_id", "feat_amount_zscore"), path)
    return R.read_table(t.spark, path)


@query("a18_price_manifest", "SELECT ticker, count(*) AS n_rows FROM prices GROUP BY 1")
def a18(t: Tables):
    return R.price_manifest(t.prices)


@query("a19_holdings_table", """
SELECT CASE l_suppkey WHEN 7 THEN 'seven' END AS fund_name, l_suppkey::VARCHAR AS fund_cik, 'C' || l_partkey AS cusip, CASE WHEN p_size > 20 THEN translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') END AS ticker,
  CAST(l_quantity * 100 AS BIGINT) AS shares FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def a19(t: Tables):
    from ledgerlight.catalog.models import holdings

    mapping = t.part.select(F.when(F.col("p_size") > 20, F.concat(F.lit("C"), F.col("p_partkey"))).alias("cusip"), letters(F.col("p_partkey")).alias("ticker"))
    rows = holdings(t).withColumns({"value_x1000": F.lit("x"), "year": F.lit(2024), "quarter": F.lit(1)})
    return R.holdings_table(rows, mapping, {"7": "seven"}).select("fund_name", "fund_cik", "cusip", "ticker", "shares")


def _quarters(t: Tables) -> str:
    """All holdings by quarter, then the second quarter of 1997 again with doubled shares."""
    path, day = scratch_path(t.spark, "quarters"), F.col("l_shipdate")
    rows = t.lineitem.select(
        F.col("l_suppkey").cast("string").alias("fund_cik"), F.concat(F.lit("C"), F.col("l_partkey")).alias("cusip"),
        (F.col("l_quantity") * 100).cast("long").alias("shares"), F.year(day).alias("year"), F.quarter(day).alias("quarter"))
    S.write_quarters(rows, path)
    S.write_quarters(rows.where("year = 1997 and quarter = 2").withColumn("shares", F.col("shares") * 2), path)
    return path


QUARTERS = """
SELECT l_suppkey::VARCHAR AS fund_cik, 'C' || l_partkey AS cusip, year(l_shipdate)::INT AS year, quarter(l_shipdate)::INT AS quarter,
  CAST(l_quantity * 100 AS BIGINT) * CASE WHEN year(l_shipdate) = 1997 AND quarter(l_shipdate) = 2 THEN 2 ELSE 1 END AS shares FROM lineitem
"""


@query("a19_quarter_reload", QUARTERS)
def a19q(t: Tables):
    return S.read_quarters(t.spark, _quarters(t)).select("fund_cik", "cusip", "year", "quarter", "shares")


@query("a05_stored_quarters", QUARTERS + "WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def a05q(t: Tables):
    """Eight quarters out of all stored ones; only their folders are read."""
    return S.read_quarters(t.spark, _quarters(t), (1997, 1), (1998, 4)).select("fund_cik", "cusip", "year", "quarter", "shares")


PRICE_FILE = "ticker string, price_date date, close double, volume long"


def _price_runs(t: Tables) -> tuple[str, list[int]]:
    """Every order as a price, then files with new prices of the filled orders, each followed by a run, and a run without new files."""
    folder, table, checkpoint = (scratch_path(t.spark, n) for n in ("arriving", "landed", "landing"))
    prices = t.orders.select(
        F.concat(F.lit("X"), F.col("o_custkey") % 40).alias("ticker"), F.to_date("o_orderdate").alias("price_date"), F.col("o_totalprice").alias("close"),
        F.col("o_orderkey").alias("volume"), "o_orderstatus")
    taken = []
    for wave in (prices, prices.where("o_orderstatus = 'F'").withColumn("close", F.col("close") * 2), None):
        if wave is not None:
            wave.drop("o_orderstatus").write.mode("append").option("header", True).csv(folder)
        taken.append(L.land(L.arriving_csv(t.spark, folder, PRICE_FILE), table, checkpoint))
    return table, taken


@query("a02_landed_prices", "SELECT 'X' || o_custkey % 40 AS ticker, CAST(o_orderdate AS DATE) AS price_date, o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS close, o_orderkey AS volume FROM orders")
def a02l(t: Tables):
    table, _ = _price_runs(t)
    return L.newest(L.landed(t.spark, table, PRICE_FILE), ["volume"])


@query("a02_landing_runs", "SELECT count(*) AS first_run, count(*) FILTER (o_orderstatus = 'F') AS second_run, CAST(0 AS BIGINT) AS third_run, count(*) + count(*) FILTER (o_orderstatus = 'F') AS stored FROM orders")
def a02r(t: Tables):
    table, taken = _price_runs(t)
    names = ("first_run", "second_run", "third_run")
    return L.landed(t.spark, table, PRICE_FILE).agg(*[F.lit(n).cast("long").alias(c) for c, n in zip(names, taken)], F.count(F.lit(1)).alias("stored"))


def _pages(t: Tables):
    package = F.struct(
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("BILLS-119hr"), F.col("o_orderkey"), F.lit("ih"))).otherwise(F.concat(F.lit("CRPT-119hrpt"), F.col("o_orderkey"))).alias("packageId"),
        F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("string").alias("lastModified"))
    return D.read_json(t.spark, _json(t, t.orders.select(F.array(package).alias("packages")), "packages"), D.PACKAGES)


@query("a20_flatten_packages", "SELECT 'BILLS-119hr' || o_orderkey || 'ih' AS package_id, 'hr' || o_orderkey || '-119' AS bill_id, o_orderpriority AS title FROM orders WHERE o_orderstatus = 'F'")
def a20(t: Tables):
    return D.flatten_packages(_pages(t), "BILLS", 119).select("package_id", "bill_id", "title")


@query("a20_committee_reports", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'BILLS-119hr' || o_orderkey || 'ih' ELSE 'CRPT-119hrpt' || o_orderkey END AS package_id FROM orders")
def a20r(t: Tables):
    return D.flatten_committee_reports(_pages(t), 119).select("package_id")


@query("a21_finance_loads", """
SELECT c_custkey AS candidate_id, CASE c_custkey % 3 WHEN 0 THEN 'House' WHEN 1 THEN 'Senate' END AS office, CASE c_custkey % 2 WHEN 0 THEN 'finance' ELSE 'energy' END AS sector_tag FROM customer
""")
def a21(t: Tables):
    key = F.col("c_custkey")
    office = F.when(key % 3 == 0, "H").when(key % 3 == 1, "S").otherwise("P")
    raw = t.customer.select(key.alias("candidate_id"), office.alias("office"))
    candidates = R.load_candidates(raw.unionByName(raw))
    paid = t.customer.select(
        F.col("c_name").alias("contributor_name"), F.when(key % 2 == 0, "Big Bank").otherwise("Oil & Gas").alias("contributor_employer"), F.lit("c").alias("committee_name"),
        key.alias("candidate_id"), F.col("c_acctbal").alias("amount"), F.lit(None).cast("date").alias("receipt_date"), F.lit("TX").alias("state"))
    return candidates.join(R.load_contributions(paid).select("candidate_id", "sector_tag"), "candidate_id")


@query("a21_candidate_totals", """
SELECT 'H' || c_custkey AS candidate_id, c_acctbal AS total_receipts, c_acctbal * 2 AS total_disbursements, 1.0::DOUBLE AS cash_on_hand, 2.0::DOUBLE AS total_individual_contributions, 3.0::DOUBLE AS total_pac_contributions, 2024 AS election_year FROM customer
""")
def a21t(t: Tables):
    """API totals flattened, then brought to the table's columns."""
    answer = t.customer.select(
        F.concat(F.lit("H"), "c_custkey").alias("candidate_id"), F.col("c_name").alias("name"), F.lit("DEM").alias("party_full"), F.col("c_acctbal").alias("receipts"),
        (F.col("c_acctbal") * 2).alias("disbursements"), F.lit(1.0).alias("cash_on_hand_end_period"), F.lit(2.0).alias("individual_contributions"),
        F.lit(3.0).alias("other_political_committee_contributions"))
    return R.load_candidate_totals(D.flatten_totals(answer))


@query("a21_cusip_map", "SELECT 'C' || p_size AS cusip, min(p_brand) AS ticker FROM part GROUP BY 1")
def a21c(t: Tables):
    return R.load_cusip_map(t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("C"), "p_size").alias("cusip"), F.col("p_brand").alias("ticker")))


@query("a10_flatten_committees", """
SELECT 'hs' || n_nationkey || '00' AS id, 'Committee on Finance ' || n_nationkey AS name, CASE n_nationkey % 3 WHEN 0 THEN 'house' WHEN 1 THEN 'senate' ELSE 'joint' END AS chamber FROM nation
""")
def a10c(t: Tables):
    key_ = F.col("n_nationkey")
    answer = t.nation.select(
        F.concat(F.lit("hs"), key_, F.lit("00")).alias("systemCode"), F.concat(F.lit("Committee on Finance "), key_).alias("name"),
        F.when(key_ % 3 == 0, "House of Representatives").when(key_ % 3 == 1, "Senate").otherwise("Other").alias("chamber"))
    return D.flatten_committees(D.read_json(t.spark, _json(t, answer, "committees"), D.COMMITTEES)).select("id", "name", "chamber")


def _house_votes(t: Tables):
    """Orders as House roll calls, their buyer and clerk as voters; some without a bill."""
    votes = t.orders.select(
        F.col("o_orderkey").alias("rollCallNumber"), F.to_date("o_orderdate").cast("string").alias("startDate"), F.lit("On Passage").alias("voteQuestion"),
        F.col("o_orderstatus").alias("result"), F.when(F.col("o_orderstatus") != "P", "HR").alias("legislationType"), F.col("o_custkey").cast("string").alias("legislationNumber"),
        F.array(
            F.struct(F.concat(F.lit("B"), F.col("o_custkey")).alias("bioguideID"), F.lit("Yea").alias("voteCast")),
            F.struct(F.when(F.col("o_orderstatus") == "F", F.lit("C1")).alias("bioguideID"), F.lit("Nay").alias("voteCast")),
        ).alias("results"))
    return D.read_json(t.spark, _json(t, votes, "house_votes"), D.HOUSE_VOTES)


@query("a10_flatten_house_votes", """
SELECT 'house-119-' || o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN 'HR' || o_custkey || '-119' ELSE '' END AS bill_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS vote_date, 'house' AS chamber, o_orderstatus AS description FROM orders
""")
def a10v(t: Tables):
    return D.flatten_house_votes(_house_votes(t)).select("id", "bill_id", "vote_date", "chamber", "description")


@query("a10_flatten_house_positions", """
SELECT 'B' || o_custkey AS politician_id, 'house-119-' || o_orderkey AS vote_id, 'yes' AS position FROM orders
UNION ALL SELECT 'C1', 'house-119-' || o_orderkey, 'no' FROM orders WHERE o_orderstatus = 'F'
""")
def a10p(t: Tables):
    return D.flatten_house_positions(_house_votes(t))
