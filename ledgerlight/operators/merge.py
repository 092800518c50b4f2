"""Merging, backfilling, deduplicating and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.operators.lookup import enrich


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str], per_key: int = 1) -> DataFrame:
    """The first `per_key` rows of every key in the given order.

    Spark cuts each map partition to `per_key` rows per key before the shuffle, so a key with very
    many copies sends only a handful of rows.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= per_key).drop("_rank")


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows; every column is computed once, before any filter on it.

    Without this the optimizer copies costly expressions (parsing) into the filters that use them.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def union_aligned(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_maps(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of maps where an earlier frame wins over a later one."""
    ranked = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    values = [c for c in frames[0].columns if c not in keys]
    return union_aligned(ranked).groupBy(*keys).agg(
        *[F.min_by(c, "_source").alias(c) for c in values]
    )


def upsert_rows(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Target with the rows of `updates` replacing or extending it by key."""
    return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates, allowMissingColumns=True)


def insert_ignore(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `updates` whose key is not in the target yet, one per key."""
    fresh = keep_first(updates, keys, [c for c in updates.columns])
    return fresh.join(target.select(*keys), keys, "left_anti")


def backfill(df: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill only the NULLs of `columns` from a table unique on `key`; adds `was_filled`."""
    source = values.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = enrich(df, source, [key])
    filled = reduce(lambda a, b: a | b, [F.col(c).isNull() & F.col(f"_new_{c}").isNotNull() for c in columns])
    out = [F.coalesce(c, f"_new_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    return joined.select(*out, filled.alias("was_filled"))


def propagate(df: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """Overwrite `column` by the source value of the same key, letter case ignored."""
    values = (
        source.where(F.col(column).isNotNull())
        .groupBy(F.lower(key).alias("_key")).agg(F.max(column).alias("_value"))
    )
    joined = enrich(df.withColumn("_key", F.lower(key)), values, ["_key"])
    return joined.select(*[F.col("_value").alias(column) if c == column else F.col(c) for c in df.columns])


def latest_metadata(df: DataFrame, metadata: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """Left join of the newest metadata row per key."""
    newest = metadata.dropna(subset=[key]).groupBy(key).agg(
        F.max_by(F.struct(*columns), version).alias("_newest")
    )
    joined = enrich(df, newest, [key])
    return joined.select(*df.columns, *[F.col("_newest")[c].alias(c) for c in columns])


def merge_votes(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Union of two vote tables; on a shared key the second table wins."""
    return merge_maps([second, first], [key])


def rewrite_where(df: DataFrame, values: DataFrame, key: str, column: str, condition: Column) -> DataFrame:
    """Replace `column` by the table's value (NULL when absent) only on rows meeting `condition`."""
    joined = enrich(df.withColumn("_apply", condition), values.select(key, F.col(column).alias("_value")), [key])
    out = F.when(F.col("_apply"), F.col("_value")).otherwise(F.col(column)).alias(column)
    return joined.select(*[out if c == column else F.col(c) for c in df.columns])


def compare_runs(first: DataFrame, second: DataFrame, key: str, suffixes: tuple[str, str] = ("_v1", "_v2")) -> DataFrame:
    """Inner join of two runs with suffixed columns."""
    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(key, *[F.col(c).alias(c + suffix) for c in df.columns if c != key])

    return renamed(first, suffixes[0]).join(renamed(second, suffixes[1]), key)


def missing_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).dropna().distinct().join(known.select(key).distinct(), key, "left_anti")


def known_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).dropna().distinct().join(known.select(key).distinct(), key, "left_semi")
