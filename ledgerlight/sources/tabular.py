"""Tables, CSV files, price and holdings folders, ticker dictionaries."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlight.functions import sectors as S
from ledgerlight.functions import text as X
from ledgerlight.functions import vocab as V
from ledgerlight.operators.clean import only_funds
from ledgerlight.operators.merge import keep_first
from ledgerlight.plans.holdings import period_of

# Header spellings (lower case) of price and holdings files.
PRICE_COLUMNS = {
    "price_date": ["date"], "open_price": ["open"], "high": ["high"], "low": ["low"], "close": ["close"],
    "volume": ["volume"],
}
HOLDING_COLUMNS = {
    "accession_number": ["accession_number"], "cik": ["cik"], "cusip": ["cusip"],
    "issuer_name": ["issuer_name", "nameofissuer"], "title_of_class": ["title_of_class", "titleofclass"],
    "value_x1000": ["value_x1000", "value"], "shares": ["shares", "sshprnamt"],
    "share_type": ["share_type", "sshprnamttype"], "put_call": ["put_call", "putcall"], "figi": ["figi"],
}


def conform(df: DataFrame, schema: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Columns of the schema that are present, leniently cast; absent ones become NULL."""
    df = df.withColumnsRenamed(rename or {})
    present = set(df.columns)
    fields = StructType.fromDDL(schema).fields
    return df.select(*[
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in fields
    ])


def read_raw(spark: SparkSession, path: str, schema: str, rename: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header; columns are matched by name, never inferred."""
    return conform(spark.read.option("header", True).option("escape", '"').csv(path), schema, rename)


def normalize_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rename columns to canonical names, letter case and blanks around them ignored."""
    wanted = {spelling: name for name, spellings in aliases.items() for spelling in spellings}
    return df.withColumnsRenamed({
        c: wanted[c.lower().strip()] for c in df.columns if c.lower().strip() in wanted
    })


def read_by_header(
    spark: SparkSession, path: str, columns: dict[str, list[str]], header_words: list[str],
    contains: list[str] | None = None, multi_line: bool = False,
) -> DataFrame:
    """CSV files whose headers differ from file to file (order, letter case, spelling), all as text.

    A file's first line is its header; files whose header lacks one of `header_words` are left out. The
    driver sees one line per file, and files with equal headers are read together, all their columns by
    position. Columns listed in `contains` match any header cell that contains the spelling. With
    `multi_line`, quoted cells may hold line breaks (a file is then one split). Adds `file_path`.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    ).where((F.col("start") == 0) & (F.trim("value") != ""))
    files: dict[str, list[str]] = {}
    for row in lines.groupBy("file_path").agg(F.min_by("value", "at").alias("header")).collect():
        files.setdefault(row["header"].lstrip("\ufeff"), []).append(unquote(row["file_path"]))

    def place(cells: list[str], name: str, spellings: list[str]) -> Column:
        loose = name in (contains or [])
        at = [i for i, c in enumerate(cells) if c in spellings or loose and any(s in c for s in spellings)]
        return (F.col(f"c{at[0]}") if at else F.lit(None).cast("string")).alias(name)

    tables = []
    for header, paths in sorted(files.items()):
        if not all(w in header.lower() for w in header_words):
            continue
        cells = [c.strip().lower() for c in next(csv.reader([header]))]
        schema = ", ".join(f"c{i} string" for i in range(len(cells)))
        body = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line).csv(sorted(paths))
        tables.append(body.select(*[place(cells, n, s) for n, s in columns.items()], F.col("_metadata.file_path").alias("file_path")))
    if not tables:
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in [*columns, "file_path"]))
    return reduce(DataFrame.unionByName, tables)


def read_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Price CSVs per ticker (`_*` files skipped) -> stock_prices layout.

    The ticker is the file name, or the folder name `ticker=...` where Spark wrote several files.
    """
    raw = read_by_header(spark, folder, PRICE_COLUMNS, ["date", "close"], contains=["price_date"])
    money = {c: F.col(c).try_cast("decimal(12,4)") for c in ("open_price", "high", "low", "close")}
    folder_name = X.blank_to_null(F.regexp_extract("file_path", r"ticker=([^/]+)/[^/]*$", 1))
    file_name = F.regexp_extract("file_path", r"([^/]+)\.csv$", 1)
    return raw.select(
        F.upper(F.url_decode(F.coalesce(folder_name, file_name))).alias("ticker"),
        X.parse_date("price_date").alias("price_date"), *[c.alias(n) for n, c in money.items()],
        F.col("volume").try_cast("double").cast("long").alias("volume"),
    )


def read_holdings(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly holdings files `YYYYqN_holdings.csv` as text, with year, quarter and period.

    The fund key comes from the accession number where a file has no key column.
    """
    raw = read_by_header(spark, folder, HOLDING_COLUMNS, ["cusip", "sh"], multi_line=True)
    name = r"(\d{4})q(\d)_holdings"
    year, quarter = (F.regexp_extract("file_path", name, i).cast("int") for i in (1, 2))
    cik = F.coalesce(X.clean_cik("cik"), X.cik_of_accession("accession_number"))
    return raw.withColumns({"cik": cik, "year": year, "quarter": quarter}).withColumn(
        "period", period_of(F.col("year"), F.col("quarter"))
    ).drop("file_path")


def extract_holdings(bulk: DataFrame, funds: dict[str, str] = V.TRACKED_FUNDS) -> DataFrame:
    """Bulk filing rows: fund key from the accession number, tracked funds only, canonical columns."""
    named = normalize_columns(bulk, HOLDING_COLUMNS)
    return only_funds(named.withColumn("cik", X.cik_of_accession("accession_number")), funds)


def holdings_table(holdings: DataFrame, ticker_map: DataFrame, funds: dict[str, str] = V.TRACKED_FUNDS) -> DataFrame:
    """Holdings in table layout; the ticker comes from the security map (cusip, ticker)."""
    from ledgerlight.operators.entity import map_column

    mapped = map_column(holdings, ticker_map.select("cusip", "ticker"), "cusip", "ticker", "ticker")
    return mapped.select(
        X.lookup(funds, F.col("cik")).alias("fund_name"), F.col("cik").alias("fund_cik"), "cusip", "ticker",
        "issuer_name", X.lenient_number("shares").cast("long").alias("shares"),
        X.lenient_number("value_x1000").cast("long").alias("value_x1000"), "year", "quarter",
    )


def read_sector_map(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """JSON dictionary ticker -> sector or list -> (ticker, sector text, sectors array).

    A file is one JSON object, or with `one_per_line` every line is one.
    """
    parsed = F.from_json("value", "map<string,string>")
    pairs = spark.read.text(path, wholetext=not one_per_line).select(F.explode(parsed).alias("ticker", "sector"))
    return pairs.withColumn("sectors", S.parse_sector("sector"))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Columnar table with projection and predicate left to the scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def price_manifest(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ticker").agg(F.count("*").alias("n_rows"))


# --- finance tables ---------------------------------------------------------------------------

def load_candidates(raw: DataFrame) -> DataFrame:
    coded = raw.withColumn("office", X.office_name("office"))
    return keep_first(coded, ["candidate_id"], [c for c in coded.columns if c != "candidate_id"])


def load_candidate_totals(raw: DataFrame) -> DataFrame:
    return raw.drop("name", "party")


def load_contributions(raw: DataFrame) -> DataFrame:
    return raw.select(
        "contributor_name", "contributor_employer", "committee_name", "candidate_id", "amount", "receipt_date", "state",
        S.employer_sector("contributor_employer").alias("sector_tag"),
    )


def load_cusip_map(raw: DataFrame) -> DataFrame:
    slim = raw.drop("id")
    return keep_first(slim, ["cusip"], [c for c in slim.columns if c != "cusip"])


# --- legislative tables -----------------------------------------------------------------------

def load_politicians(raw: DataFrame) -> DataFrame:
    """Raw people -> table layout without id, one row per natural key."""
    last = F.trim(F.substring_index("full_name", ",", 1))
    first = F.when(F.col("full_name").contains(","), F.trim(F.regexp_replace("full_name", r"^[^,]*,", "")))
    rows = raw.select(
        F.col("id").alias("bioguide_id"), first.alias("first_name"), last.alias("last_name"), "full_name", "party",
        X.state_abbrev("state").alias("state"), "district", X.chamber_name("chamber").alias("chamber"),
    )
    return keep_first(rows, ["bioguide_id"], ["full_name", "party", "state", "district", "chamber"])


def load_committees(raw: DataFrame) -> DataFrame:
    rows = raw.select(
        F.lower(F.trim("id")).alias("committee_id"), "name", X.chamber_name("chamber").alias("chamber"),
        F.col("industry_sector").alias("sector_tag"),
    )
    return keep_first(rows, ["committee_id"], ["name", "chamber", "sector_tag"])


def load_votes(raw: DataFrame) -> DataFrame:
    rows = raw.select(
        F.col("id").alias("roll_call_id"), X.chamber_name("chamber").alias("chamber"),
        X.congress_of_roll_call("id").alias("congress"), F.col("vote_question").alias("question"),
        X.truncate_text("description").alias("result"), X.parse_date("vote_date").alias("vote_date"),
    )
    return keep_first(rows, ["roll_call_id"], ["vote_date", "question", "result", "chamber"])


def load_bills(raw: DataFrame) -> DataFrame:
    part = X.bill_number_parts("bill_number")
    rows = raw.select(
        F.col("id").alias("bill_id"), "congress", part["bill_type"].alias("bill_type"),
        part["bill_number"].alias("bill_number"), "title", "policy_area", "latest_action", "latest_action_date",
        "origin_chamber", "sponsor_bioguide", "url",
    )
    return keep_first(rows, ["bill_id"], [c for c in rows.columns if c != "bill_id"])


def with_surrogate_id(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Deterministic LONG id from the natural key (a hash, so no global sort is needed)."""
    return df.select(F.shiftrightunsigned(F.xxhash64(key), 1).alias(name), *df.columns)
