"""Institutional trades inferred from quarterly holdings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import scores as N
from ledgerlight.functions import text as X
from ledgerlight.functions import vocab as V
from ledgerlight.operators.clean import only_funds, share_positions
from ledgerlight.operators.entity import map_column
from ledgerlight.operators.lookup import only_keys


def period_of(year: Column, quarter: Column) -> Column:
    """Consecutive quarter number: year * 4 + quarter."""
    return (year * 4 + quarter).cast("int")


def period_label(period: Column) -> Column:
    return F.concat(F.floor((period - 1) / 4).cast("int"), F.lit("Q"), ((period - 1) % 4 + 1).cast("int"))


def period_end(period: Column) -> Column:
    first = F.make_date(F.floor((period - 1) / 4).cast("int"), ((period - 1) % 4 * 3 + 1).cast("int"), F.lit(1))
    return F.date_sub(F.add_months(first, 3), 1)


def positions(holdings: DataFrame, keys: list[str]) -> DataFrame:
    """Shares per (keys, period), bad numbers counted as 0; the issuer is the first by name."""
    issuer = [F.min("issuer_name").alias("issuer_name")] if "issuer_name" in holdings.columns else []
    return holdings.groupBy(*keys, "period").agg(F.sum(X.lenient_number("shares")).alias("shares"), *issuer)


def quarter_changes(holdings: DataFrame, keys: list[str], bounds: DataFrame | None = None) -> DataFrame:
    """Both sides of every pair of consecutive quarters; an absent position counts 0 shares.

    Full outer join on (keys, period = period + 1) for all quarters at once. `period` is the
    earlier quarter. A position is compared only with quarters the data has: the first quarter has
    no predecessor and the last no successor. `bounds` (one row: lo, hi) tells these where `holdings` are not all of them.
    """
    held = positions(holdings, keys)
    if bounds is None:
        bounds = held.groupBy().agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    has_issuer = "issuer_name" in held.columns
    prior = held.where(F.col("period") < hi).withColumnsRenamed({"shares": "shares_prior", "issuer_name": "_issuer_prior"})
    current = held.where(F.col("period") > lo).withColumn("period", F.col("period") - 1).withColumnsRenamed(
        {"shares": "shares_current", "issuer_name": "_issuer_current"}
    )
    joined = prior.join(current, [*keys, "period"], "full")
    filled = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("shares_prior", "shares_current")]
    issuer = [F.coalesce("_issuer_current", "_issuer_prior").alias("issuer_name")] if has_issuer else []
    return joined.select(*keys, "period", *filled, *issuer)


def infer_fund_trades(holdings: DataFrame, ticker_map: DataFrame, funds: dict[str, str] | DataFrame = V.TRACKED_FUNDS) -> DataFrame:
    """Buys and sells per (fund, security) and quarter pair, dated the end of the earlier quarter.

    `holdings`: cik, cusip, shares, share_type, period; `ticker_map`: cusip, ticker. `funds` are those to keep:
    a short list, or a table (cik, fund_name) of any length, unique on cik without leading zeros; an empty list keeps all, named by their cik.
    """
    valid = F.col("ticker").rlike("^[A-Z]{1,5}$")
    if isinstance(funds, DataFrame):
        named = funds.select(X.clean_cik("cik").alias("_fund"), "fund_name")
        held = share_positions(holdings).withColumn("_fund", X.clean_cik("cik"))
        # The bounds of the quarters are those of all holdings of the tracked funds, whatever is compared.
        spans = held.groupBy("_fund").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
        spans = map_column(spans, named, "_fund", "fund_name", "fund_name").where("fund_name IS NOT NULL")
        # Securities are compared each by itself: those without a valid ticker are left out before.
        held = map_column(only_keys(held, ticker_map.where(valid).select("cusip")), named, "_fund", "fund_name", "fund_name")
        moved = quarter_changes(
            held.where("fund_name IS NOT NULL"), ["cik", "fund_name", "cusip"], spans.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    else:
        moved = quarter_changes(share_positions(only_funds(holdings, funds)) if funds else share_positions(holdings), ["cik", "cusip"])
        moved = moved.withColumn("fund_name", X.lookup(funds, F.col("cik")) if funds else F.col("cik"))
    moved = moved.withColumn(
        "delta", F.col("shares_current") - F.col("shares_prior")
    ).where(F.abs("delta") >= V.MIN_SHARES_DELTA)
    # A security moves at most twice for each of its holdings, which are counted without comparing quarters again.
    named = map_column(moved, ticker_map, "cusip", "ticker", "ticker", source=holdings).where(valid)
    return named.select(
        "cik", "fund_name", "cusip", "ticker",
        F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("trade_type"),
        F.abs("delta").cast("long").alias("shares_delta"), period_end(F.col("period")).alias("inferred_date"),
    )


def infer_security_trades(holdings: DataFrame) -> DataFrame:
    """Position changes per security and quarter pair with their direction, unchanged ones dropped."""
    moved = quarter_changes(holdings, ["cusip"])
    direction = N.position_change("shares_prior", "shares_current")
    issuer = ["issuer_name"] if "issuer_name" in moved.columns else []
    return moved.withColumn("trade_direction", direction).where("trade_direction <> 'unchanged'").select(
        "cusip", *issuer, "shares_prior", "shares_current",
        (F.col("shares_current") - F.col("shares_prior")).alias("share_change"), "trade_direction",
        period_label(F.col("period")).alias("from_period"), period_label(F.col("period") + 1).alias("to_period"),
    )
