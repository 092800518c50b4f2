"""Holdings stored by quarter: one folder per (year, quarter)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.plans.holdings import period_of


def write_quarters(holdings: DataFrame, path: str) -> None:
    """Store the rows under their year and quarter.

    The quarters that `holdings` has rows of are replaced, all others stay as they are; rows without a
    year or quarter share a folder of their own. Rows are gathered by quarter before they are written, so
    that a folder gets few files, and a quarter too large for one task is split by the engine.
    """
    (
        holdings.hint("rebalance", "year", "quarter").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("year", "quarter").parquet(path)
    )


def read_quarters(spark: SparkSession, path: str, first: tuple[int, int] | None = None, last: tuple[int, int] | None = None) -> DataFrame:
    """Stored rows from quarter `first` to quarter `last`, each (year, quarter); only their folders are read."""
    rows = spark.read.parquet(path)
    period = period_of(F.col("year"), F.col("quarter"))
    if first is not None:
        rows = rows.where(period >= period_of(F.lit(first[0]), F.lit(first[1])))
    if last is not None:
        rows = rows.where(period <= period_of(F.lit(last[0]), F.lit(last[1])))
    return rows
