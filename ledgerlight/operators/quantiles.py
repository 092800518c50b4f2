"""Exact quantiles of large columns without gathering a column in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import scratch_path

SPLITS = 128


def exact_percentiles(df: DataFrame, key: str, value: str, quantiles: list[float]) -> DataFrame:
    """(key, q, value): linearly interpolated quantiles per key, for few keys and any number of rows.

    Values are counted, cut into `SPLITS` ranges at approximate split points, and only the ranges
    holding a wanted rank are sorted. The split points decide the balance of the work, never the result.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    marks = [i / SPLITS for i in range(1, SPLITS)]
    splits = df.groupBy(key).agg(F.percentile_approx(value, marks, 10000).alias("splits"))
    placed = counted.join(F.broadcast(splits), key).select(
        key, value, "n", F.size(F.filter("splits", lambda s: s < F.col(value))).alias("bucket")
    )
    by_key = Window.partitionBy(key).orderBy("bucket")
    buckets = placed.groupBy(key, "bucket").agg(F.sum("n").alias("size")).withColumns({
        "start": F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
        "total": F.sum("size").over(Window.partitionBy(key)),
    })
    wanted = F.explode(F.array(*[
        F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("total") - 1)).alias("pos"))
        for q in quantiles
    ]))
    ranks = buckets.select(key, "bucket", "start", "size", wanted.alias("w")).select(
        key, "bucket", "start", "size", "w.q", "w.pos",
        F.explode(F.array_distinct(F.array(F.floor("w.pos"), F.ceil("w.pos")))).alias("rank"),
    ).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("size")))
    inside = placed.join(F.broadcast(ranks.select(key, "bucket", "start").distinct()), [key, "bucket"]).withColumn(
        "upto", F.col("start") + F.sum("n").over(
            Window.partitionBy(key, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        )
    )
    hits = inside.join(F.broadcast(ranks.select(key, "bucket", "q", "pos", "rank")), [key, "bucket"]).where(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    )
    low, high, share = F.min(value), F.max(value), F.max(F.col("pos") - F.floor("pos"))
    return hits.groupBy(key, "q").agg((low + (high - low) * share).alias(value))


def grouped_percentiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(keys, n, and a column per named quantile): linearly interpolated quantiles, for any number of keys.

    The counted values are dealt to ranges of (keys, value) and stored, so that a key with many different
    values lies in several ranges. A place is the sum of the ranges before and a running count within the
    range: no window is larger than one range, nothing is broadcast, and the order of a key's ranges is
    known from one row per key and range. NULL values count nowhere, rows with a NULL key are a group.
    """
    spark = df.sparkSession
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    path = scratch_path(spark, "ranges")
    counted.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_size"))
    by_key = Window.partitionBy(*keys)
    upto = F.sum("_size").over(by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    starts = sizes.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_of"),
        (upto - F.col("_size")).alias("_before"), F.col("_size"), F.sum("_size").over(by_key).alias("n"),
    )
    low = {q: F.floor(F.lit(float(share)) * (F.col("n") - 1)) for q, share in quantiles.items()}
    high = {q: F.ceil(F.lit(float(share)) * (F.col("n") - 1)) for q, share in quantiles.items()}

    def within(rank, start, size):
        return (rank >= start) & (rank < start + size)

    def any_of(start, size):
        found = F.lit(False)
        for rank in (*low.values(), *high.values()):
            found = found | within(rank, start, size)
        return found

    # Only ranges that hold a wanted rank are numbered.
    holding = starts.where(any_of(F.col("_before"), F.col("_size")))
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    in_range = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("_before") + F.sum("_n").over(in_range) - F.col("_n")
    placed = ranged.join(holding, same).select(*keys, value, "n", "_n", at.alias("_at")).where(any_of(F.col("_at"), F.col("_n")))
    ends = placed.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.max(F.when(within(rank[q], F.col("_at"), F.col("_n")), F.col(value))).alias(f"_{side}_{q}")
        for side, rank in (("low", low), ("high", high)) for q in quantiles
    ])
    return ends.select(*keys, "n", *[
        (F.col(f"_low_{q}") + (F.col(f"_high_{q}") - F.col(f"_low_{q}")) * (F.lit(float(share)) * (F.col("n") - 1) - low[q])).alias(q)
        for q, share in quantiles.items()
    ])
