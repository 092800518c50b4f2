"""Cleaning pipelines, filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import text as X
from ledgerlight.functions import vocab as V
from ledgerlight.operators.merge import computed_once, keep_first, union_aligned

TRADE_KEY = ["politician_id", "ticker", "trade_date", "trade_type"]

# The unified trade layout.
UNIFIED_COLUMNS = {
    "politician_id": "string", "ticker": "string", "company_name": "string", "trade_type": "string",
    "trade_date": "date", "disclosure_date": "date", "disclosure_lag_days": "int", "amount_lower": "long",
    "amount_upper": "long", "amount_midpoint": "long", "asset_type": "string", "industry_sector": "string",
    "source_url": "string", "chamber": "string", "first_name": "string", "last_name": "string",
    "source": "string",
}


def _rest(df: DataFrame, keys: list[str]) -> list[str]:
    """Every other column, so that which copy survives does not depend on file order."""
    return [c for c in df.columns if c not in keys] or keys


def clean_trades(df: DataFrame) -> DataFrame:
    """Valid tickers, both dates, lag 0..365, known types, one row per (person, ticker, date, type)."""
    kept = df.where(
        F.col("ticker").rlike("^[A-Z]{1,5}$")
        & F.col("trade_date").isNotNull() & F.col("disclosure_date").isNotNull()
        & F.col("disclosure_lag_days").between(0, 365)
        & F.col("trade_type").isin(V.TRADE_TYPES)
    )
    return keep_first(kept, TRADE_KEY, _rest(df, TRADE_KEY))


def clean_inferred_trades(df: DataFrame) -> DataFrame:
    """Valid tickers, at least 100 shares moved, one row per (fund, ticker, date, type)."""
    keys = ["cik", "ticker", "inferred_date", "trade_type"]
    kept = df.where(F.col("ticker").rlike("^[A-Z]{1,5}$") & (F.col("shares_delta") >= V.MIN_SHARES_DELTA))
    return keep_first(kept, keys, _rest(df, keys))


def drop_artifact_tickers(df: DataFrame) -> DataFrame:
    """Without extraction artefacts; rows without a ticker stay."""
    return df.where(~F.coalesce(F.upper("ticker").isin(V.ARTIFACT_TICKERS), F.lit(False)))


def normalize_feed(df: DataFrame, since: str = "2022-01-01") -> DataFrame:
    """Third-party feed (Representative, Ticker, Transaction, Amount, dates, ...) -> unified trades."""
    amount = X.amount_range("Amount", V.FEED_AMOUNTS)
    trades = df.select(
        F.trim("Representative").alias("politician_id"),
        X.valid_ticker_cell("Ticker").alias("ticker"),
        F.col("Company").alias("company_name"),
        X.trade_type_contained("Transaction", V.FEED_TRANSACTIONS).alias("trade_type"),
        X.parse_date("TransactionDate").alias("trade_date"),
        X.parse_date("DisclosureDate").alias("disclosure_date"),
        amount["lower"].alias("amount_lower"), amount["upper"].alias("amount_upper"),
        amount["midpoint"].alias("amount_midpoint"),
        F.coalesce("AssetType", F.lit("stock")).alias("asset_type"),
        X.lookup(V.FEED_TICKERS, X.valid_ticker_cell("Ticker")).alias("industry_sector"),
        F.col("Source").alias("source_url"),
    )
    trades = computed_once(trades).withColumn("disclosure_lag_days", X.lag_days("disclosure_date", "trade_date"))
    kept = trades.where(
        F.col("ticker").isNotNull() & F.col("trade_type").isNotNull()
        & (F.col("trade_date") >= F.lit(since).cast("date"))
        & F.col("disclosure_lag_days").between(0, 365)
    )
    return keep_first(kept, TRADE_KEY, _rest(kept, TRADE_KEY))


def equity_only(df: DataFrame) -> DataFrame:
    """Without the listed non-equity asset types and without rows lacking ticker or type."""
    skipped = F.coalesce(F.lower("asset_type").isin(V.SKIPPED_ASSET_TYPES), F.lit(False))
    return df.where(~skipped & F.col("ticker").isNotNull() & F.col("trade_type").isNotNull())


def add_disclosure_lag(df: DataFrame) -> DataFrame:
    """Dates parsed leniently from text and their difference in days (NULL for a bad date)."""
    dated = df.withColumns({c: X.parse_date(c) for c in ("trade_date", "disclosure_date")})
    return dated.withColumn("disclosure_lag_days", X.lag_days("disclosure_date", "trade_date"))


def to_unified(df: DataFrame) -> DataFrame:
    """Projection to the unified layout; absent columns become NULL."""
    present = set(df.columns)
    return df.select(*[
        (F.col(c) if c in present else F.lit(None)).cast(t).alias(c) for c, t in UNIFIED_COLUMNS.items()
    ])


def merge_chambers(frames: list[DataFrame], sector_map: DataFrame | None = None) -> DataFrame:
    """Union of the chambers' trades -> unified, artefact-free, deduplicated trades."""
    merged = drop_artifact_tickers(union_aligned(frames))
    person = [F.col(c) for c in ("politician_name", "full_name") if c in merged.columns][:1]
    if person:
        merged = merged.withColumn("politician_id", person[0])
    if sector_map is not None:
        from ledgerlight.operators.lookup import enrich

        mapped = sector_map.select("ticker", F.col("sector").alias("industry_sector"))
        merged = enrich(merged.drop("industry_sector"), mapped, ["ticker"])
    if "doc_id" in merged.columns:
        merged = merged.withColumn("source_url", X.filing_url("doc_id"))
    unified = to_unified(merged)
    return keep_first(unified, TRADE_KEY, _rest(unified, TRADE_KEY))


def price_tickers(trades: DataFrame, benchmark: str = V.BENCHMARK_TICKER) -> DataFrame:
    """Distinct upper-case alphabetic tickers of up to five letters, benchmark included."""
    valid = trades.where(F.col("ticker").rlike("^[A-Za-z]{1,5}$")).select(
        F.upper(F.trim("ticker")).alias("ticker")
    )
    spark = trades.sparkSession
    return valid.union(spark.range(1).select(F.lit(benchmark).alias("ticker"))).distinct()


def split_resolved(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every listed key resolved, and a one-row count of kept and dropped rows."""
    resolved = df.dropna(subset=columns)
    unresolved = F.lit(False)
    for c in columns:
        unresolved = unresolved | F.col(c).isNull()
    counts = df.agg(
        F.count_if(~unresolved).alias("kept"), F.count_if(unresolved).alias("dropped")
    )
    return resolved, counts


def only_funds(df: DataFrame, funds: dict[str, str] = V.TRACKED_FUNDS, column: str = "cik") -> DataFrame:
    return df.where(X.clean_cik(column).isin(list(funds)))


def share_positions(df: DataFrame) -> DataFrame:
    return df.where(F.col("share_type") == "SH")


def scoreable(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["cohort_alpha"])


def search_people(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring search on name, key or state."""
    needle = text.lower()
    hit = F.lit(False)
    for c in ("full_name", "bioguide_id", "state"):
        hit = hit | F.coalesce(F.lower(c).contains(needle), F.lit(False))
    return df.where(hit)


def optional_filters(
    df: DataFrame, quadrants: list[str] | None = None, since: str | None = None, until: str | None = None,
    ticker: str | None = None, date: str = "trade_date", extra: Column | None = None,
) -> DataFrame:
    """Apply only the predicates that are given."""
    if quadrants:
        df = df.where(F.col("severity_quadrant").isin([q.upper() for q in quadrants]))
    if ticker:
        df = df.where(F.upper("ticker") == ticker.upper())
    if since:
        df = df.where(F.col(date) >= F.lit(since).cast("date"))
    if until:
        df = df.where(F.col(date) <= F.lit(until).cast("date"))
    return df if extra is None else df.where(extra)


def select_person(df: DataFrame, key: str) -> DataFrame:
    """All digits mean the numeric id, anything else the natural key."""
    return df.where(F.col("id") == int(key)) if key.isdigit() else df.where(F.col("bioguide_id") == key)


def report_eligible(df: DataFrame, force: bool = False) -> DataFrame:
    return df if force else df.where(F.upper("severity_quadrant").isin(V.FLAGGED))
