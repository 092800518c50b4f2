"""Sector functions: parsing, tagging and precedence of sector values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions import vocab as V
from ledgerlight.functions.text import ColumnLike, as_col, first_containing, is_leader, lookup, strip


def _empty() -> Column:
    return F.array().cast("array<string>")


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def parse_sector(value: ColumnLike) -> Column:
    """Plain text, JSON list or quoted-list text -> array<string>; NULL or blank -> empty."""
    text = strip(as_col(value))
    listed = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    return (
        F.when(F.coalesce(text, F.lit("")) == "", _empty())
        .when(text.startswith("["), F.coalesce(listed, F.array(text)))
        .otherwise(F.array(text))
    )


def policy_sector(area: ColumnLike) -> Column:
    return lookup(V.POLICY_AREA_SECTORS, as_col(area))


def policy_areas_of(sectors: ColumnLike) -> Column:
    """Policy areas whose sector is one of `sectors`."""
    pairs = F.array(*[
        F.struct(F.lit(a).alias("area"), F.lit(s).alias("sector")) for a, s in V.POLICY_AREA_SECTORS.items()
    ])
    kept = F.filter(pairs, lambda p: F.array_contains(as_col(sectors), p["sector"]))
    return F.transform(kept, lambda p: p["area"])


def committee_tag(name: ColumnLike) -> Column:
    rules = [(k.lower(), sector) for sector, keywords in V.COMMITTEE_TAG_KEYWORDS for k in keywords]
    return first_containing(F.lower(as_col(name)), rules)


def employer_sector(employer: ColumnLike) -> Column:
    rules = [(k, sector) for sector, keywords in V.EMPLOYER_KEYWORDS for k in keywords]
    return first_containing(F.lower(as_col(employer)), rules)


def committee_sectors(name: ColumnLike) -> Column:
    """Sectors of the first keyword in a committee name; cross-cutting keywords go first."""
    low = F.lower(as_col(name))
    rules = [(k, s) for k, (_, s) in V.CROSS_CUTTING_KEYWORDS.items()] + list(V.COMMITTEE_KEYWORD_SECTORS.items())
    found = [F.when(low.contains(keyword), _literals(sectors)) for keyword, sectors in rules]
    return F.coalesce(*found, _empty())


def _weighted(sectors: Column, weight: Column) -> Column:
    return F.transform(sectors, lambda s: F.struct(s.alias("sector"), weight.alias("weight")))


def _cross_weight(base: float, leader: Column) -> Column:
    raised = min(base * V.CROSS_LEADER_FACTOR, 1.0)
    return F.when(leader, F.lit(raised)).otherwise(F.lit(base))


def seat_weights(name: ColumnLike, role: ColumnLike, tag: ColumnLike) -> Column:
    """array<struct<sector, weight>> one committee seat gives (keyword rules)."""
    low, leader = F.lower(as_col(name)), is_leader(role)
    cross = F.coalesce(*[
        F.when(low.contains(keyword), _weighted(_literals(sectors), _cross_weight(base, leader)))
        for keyword, (base, sectors) in V.CROSS_CUTTING_KEYWORDS.items()
    ])
    by_keyword = [
        F.when(low.contains(keyword), _literals(sectors)).otherwise(_empty())
        for keyword, sectors in V.COMMITTEE_KEYWORD_SECTORS.items()
    ]
    tagged = F.when(F.coalesce(as_col(tag), F.lit("")) != "", F.array(as_col(tag))).otherwise(_empty())
    weight = F.when(leader, F.lit(V.LEADER_WEIGHT)).otherwise(F.lit(V.MEMBER_WEIGHT))
    return F.coalesce(cross, _weighted(F.array_distinct(F.concat(*by_keyword, tagged)), weight))


def seat_weights_exact(name: ColumnLike, rank: ColumnLike) -> Column:
    """array<struct<sector, weight>> by exact committee name (version 1 rules)."""
    raw, leader = as_col(name), is_leader(rank)
    cross = [
        F.when(raw == known, _weighted(_literals(sectors), _cross_weight(base, leader)))
        for known, (base, sectors) in V.CROSS_CUTTING_NAMES.items()
    ]
    weight = F.when(leader, F.lit(V.LEADER_WEIGHT)).otherwise(F.lit(V.MEMBER_WEIGHT))
    plain = [F.when(raw == known, _weighted(_literals(s), weight)) for known, s in V.COMMITTEE_NAME_SECTORS.items()]
    return F.coalesce(*cross, *plain)


def resolve_sectors(bridge: ColumnLike, column: ColumnLike, mapped: ColumnLike, mode: str = "score") -> Column:
    """Sectors of a trade from the bridge array, its own column text and the ticker-map text.

    mode "score": bridge, then column, then ticker map.  mode "load": ticker map, then column.
    """
    def filled(values: Column) -> Column:
        return F.when(F.size(values) > 0, values)

    own, from_map = filled(parse_sector(column)), filled(parse_sector(mapped))
    if mode == "load":
        return F.coalesce(from_map, own, _empty())
    if mode != "score":
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(filled(as_col(bridge)), own, from_map, _empty())


def ticker_map(spark: SparkSession, base: DataFrame) -> DataFrame:
    """Base ticker -> sector-text map with multi-sector overrides and fund additions.

    Overrides replace tickers the base already has; fund tickers are added only where missing.
    """
    from ledgerlight.operators.merge import merge_maps

    overrides = spark.createDataFrame(
        [(t, "[" + ", ".join(f'"{s}"' for s in sectors) + "]") for t, sectors in V.MULTI_SECTOR_TICKERS.items()],
        "ticker string, sector string",
    ).join(base.select("ticker"), "ticker", "left_semi")
    additions = spark.createDataFrame(list(V.FUND_TICKERS.items()), "ticker string, sector string")
    return merge_maps([overrides, base.select("ticker", "sector"), additions], ["ticker"])
