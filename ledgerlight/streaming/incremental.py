"""Incremental work items.

There is no unbounded stream in this domain: runs are batches that pick up what is not done yet.
These functions find the open items (anti joins); `sources.sinks` appends or upserts the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import text as X
from ledgerlight.functions.vocab import FLAGGED
from ledgerlight.operators.merge import known_keys, missing_keys


def unscored(trades: DataFrame, scores: DataFrame) -> DataFrame:
    """Trades that have no score yet."""
    return trades.join(scores.select("trade_id"), "trade_id", "left_anti")


def unreported(scored: DataFrame, reports: DataFrame) -> DataFrame:
    """Flagged trades that have no report yet."""
    flagged = scored.where(F.col("severity_quadrant").isin(FLAGGED))
    return flagged.join(reports.select("trade_id"), "trade_id", "left_anti")


def cusips_of(holdings: DataFrame) -> DataFrame:
    """Distinct nine-character identifiers."""
    return holdings.select(X.clean_cusip("cusip").alias("cusip")).where("cusip is not null").distinct()


def unmapped_cusips(holdings: DataFrame, mapping: DataFrame) -> DataFrame:
    return missing_keys(cusips_of(holdings), mapping, "cusip")


def mapped_cusips(holdings: DataFrame, mapping: DataFrame) -> DataFrame:
    return known_keys(cusips_of(holdings), mapping, "cusip")
