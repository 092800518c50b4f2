"""Containment of patterns that are rows of a table (watch lists, keyword lists, company fragments).

A pattern is looked up by one of its pieces of three characters, that which the fewest texts hold; texts
that hold the piece are then compared with the whole pattern. Patterns and texts meet in an equi-join, so
their numbers may both grow, and a piece that many texts share is used only by patterns that have no
rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.lookup import enrich

WIDTH = 3


def _pieces(text: Column, width: Column) -> Column:
    """Distinct substrings of `width` characters; none if the text is shorter."""
    last = F.length(text) - width + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda at: F.substring(text, at, width)))


def contained(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Distinct (text, pattern) such that the text contains the pattern, letter case ignored.

    Both columns are in lower case. NULL and empty patterns match nothing; patterns shorter than a
    piece are looked up as they are.
    """
    whole = texts.select(F.lower(text).alias("_text")).where("_text is not null").distinct()
    wanted = patterns.select(F.lower(pattern).alias("_pattern")).where("_pattern <> ''").distinct()
    width = F.least(F.lit(WIDTH), F.length("_pattern"))
    parts = wanted.select("_pattern", F.explode(_pieces(F.col("_pattern"), width)).alias("_piece"))
    # At most WIDTH numbers: the piece lengths that the patterns need.
    widths = [r["w"] for r in wanted.select(width.alias("w")).distinct().collect()]
    if not widths:
        return whole.join(wanted, F.col("_text") == F.col("_pattern")).select(F.col("_text").alias(text), F.col("_pattern").alias(pattern))
    held = F.array_distinct(F.flatten(F.array(*[_pieces(F.col("_text"), F.lit(w)) for w in sorted(widths)])))
    pieces = whole.select("_text", F.explode(held).alias("_piece"))
    asked = pieces.join(parts.select("_piece").distinct(), "_piece", "left_semi")
    counts = asked.groupBy("_piece").agg(F.count(F.lit(1)).alias("_texts"))
    # Pieces that no text holds have no count: their patterns are in no text.
    rarest = parts.join(counts, "_piece", "left").groupBy("_pattern").agg(
        F.min_by("_piece", F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), F.col("_piece"))).alias("_piece"),
        F.min(F.coalesce("_texts", F.lit(0))).alias("_texts"),
    ).where("_texts > 0").drop("_texts")
    met = pieces.join(rarest, "_piece").where(F.contains("_text", "_pattern"))
    return met.select(F.col("_text").alias(text), F.col("_pattern").alias(pattern))


def first_match(df: DataFrame, text: str, patterns: DataFrame, pattern: str, place: str, value: str, into: str) -> DataFrame:
    """Adds as `into` the value of the first pattern, by `place` and then by pattern, that a row's text contains; else NULL."""
    spelled = patterns.select(F.lower(pattern).alias("_pattern"), F.struct(place, pattern, value).alias("_entry"))
    firsts = spelled.groupBy("_pattern").agg(F.min("_entry").alias("_entry"))
    found = contained(df, text, patterns, pattern).select(F.col(text).alias("_text"), F.col(pattern).alias("_pattern"))
    best = found.join(firsts, "_pattern").groupBy("_text").agg(F.min("_entry").alias("_entry"))
    keyed = df.withColumn("_text", F.lower(text))
    return enrich(keyed, best, ["_text"]).select(*[F.col(f"`{c}`") for c in df.columns], F.col("_entry")[value].alias(into))


def all_matches(df: DataFrame, text: str, patterns: DataFrame, pattern: str, value: str, into: str) -> DataFrame:
    """Adds as `into` the sorted distinct values of all patterns that a row's text contains; without any, an empty array."""
    values = patterns.select(F.lower(pattern).alias("_pattern"), value).distinct()
    found = contained(df, text, patterns, pattern).select(F.col(text).alias("_text"), F.col(pattern).alias("_pattern"))
    lists = found.join(values, "_pattern").groupBy("_text").agg(F.array_sort(F.collect_set(value)).alias("_values"))
    keyed = df.withColumn("_text", F.lower(text))
    none = F.array().cast(f"array<{patterns.schema[value].dataType.simpleString()}>")
    return enrich(keyed, lists, ["_text"]).select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_values", none).alias(into))
