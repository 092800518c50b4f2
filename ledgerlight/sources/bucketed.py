"""Tables stored in buckets of their key, for windows and joins that needn't shuffle them again."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.session import scratch_path

BUCKETS = 64
#: Rows that a bucket should have at most, on average, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 250_000, 16


def store(df: DataFrame, name: str, keys: list[str], order: list[str], buckets: int = BUCKETS, path: str | None = None) -> str:
    """Write `df` as the catalog table `name` in `buckets` buckets of `keys`, one sorted file each; returns `name`.

    One shuffle by the keys at the time of writing replaces that of every later use. Rows of one key
    share a bucket: for tables like prices, whose rows per key are bounded by the calendar.
    """
    dealt = df.repartition(buckets, *[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    writer = dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *order)
    writer.option("path", path or scratch_path(df.sparkSession, name)).saveAsTable(name)
    return name


def buckets_for(n_rows: int) -> int:
    """Number of buckets for a table of `n_rows` rows: a task that reads one gets no more as the table grows."""
    return max(LEAST_BUCKETS, math.ceil(n_rows / BUCKET_ROWS))


def scratch_name(name: str) -> str:
    """A table name that is free in any session."""
    return f"{name}_{uuid.uuid4().hex}"


def buckets_of(spark: SparkSession, name: str) -> int:
    """Number of buckets of a stored table; ValueError if it has none."""
    for row in spark.sql(f"DESCRIBE EXTENDED `{name}`").collect():
        if row["col_name"] == "Num Buckets":
            return int(row["data_type"])
    raise ValueError(f"{name} is not stored in buckets")
