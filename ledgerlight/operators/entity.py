"""Resolving names, codes and identifiers to keys; committee access."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import sectors as S
from ledgerlight.functions import text as X
from ledgerlight.functions import vocab as V
from ledgerlight.operators.lookup import enrich, spread_join
from ledgerlight.operators.merge import merge_maps


def map_column(df: DataFrame, mapping: DataFrame, key: str, value: str, into: str, source: DataFrame | None = None) -> DataFrame:
    """Left join to a dictionary (unique on its first column) by `key`. `source`: see `enrich`."""
    pairs = mapping.select(F.col(mapping.columns[0]).alias(key), F.col(value).alias("_mapped"))
    joined = enrich(df, pairs, [key], source)
    kept = [c for c in df.columns if c != into]
    return joined.select(*kept, F.col("_mapped").alias(into))


def _split_name(full_name: Column) -> tuple[Column, Column]:
    """'Last, First' -> (last, first); NULL parts without a comma."""
    has_comma = full_name.contains(",")
    last = F.when(has_comma, F.trim(F.substring_index(full_name, ",", 1)))
    first = F.when(has_comma, F.trim(F.regexp_replace(full_name, r"^[^,]*,", "")))
    return last, first


def _key_rows(people: DataFrame, keys: list[Column], id_column: str, order: str) -> DataFrame:
    """(name_key, id) with the last person in `order` winning a shared key."""
    exploded = people.select(
        F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("name_key"), id_column, order
    )
    return exploded.where("name_key <> ''").groupBy("name_key").agg(F.max_by(id_column, order).alias("found"))


def _match(names: DataFrame, rows: DataFrame, column: str, into: str) -> DataFrame:
    return names.join(
        rows.select(F.col("name_key").alias(column), F.col("found").alias(into)), column, "left"
    )


def resolve_entity(
    df: DataFrame, people: DataFrame, mode: str = "load", name: str = "politician_id",
    last_name: str | None = "last_name", id_column: str = "id", key_column: str = "bioguide_id",
    order: str = "id", into: str = "resolved_id",
) -> DataFrame:
    """Person id of a free-text name, resolved once per distinct name.

    "load": exact "Last, First" or "First Last", then the natural key, then the last-name column
    (on a shared last name the last person in `order` wins).
    "strict": letter case ignored; full forms, then the name without titles and suffixes, then first
    and last word, then a last name that only one person has. Known aliases go before everything.
    """
    if mode not in ("load", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    has_last = last_name is not None and last_name in df.columns
    tagged = df.withColumns({
        "_name": F.coalesce(F.trim(name), F.lit("")),
        "_last": F.coalesce(F.lower(F.trim(last_name)), F.lit("")) if has_last else F.lit(""),
    })
    names = tagged.groupBy("_name", "_last").agg(F.count(F.lit(1)).alias("n_rows"))
    full = F.trim("full_name")
    last, first = _split_name(full)
    whole = F.concat_ws(" ", first, last)
    known = people.where(full != "")
    if mode == "load":
        exact = _key_rows(known, [full, F.when(last.isNotNull(), whole)], id_column, order)
        natural = _key_rows(known, [F.col(key_column)], id_column, order)
        by_last = _key_rows(known, [F.lower(last)], id_column, order)
        steps = _match(_match(names, exact, "_name", "_r1"), natural, "_name", "_r2")
        # Many names share a last name or have none, so this step is a spread join.
        last_rows = by_last.select(F.col("name_key").alias("_last_key"), F.col("found").alias("_r3"))
        steps = enrich(steps.withColumn("_last_key", X.blank_to_null(F.col("_last"))), last_rows, ["_last_key"])
        results = ["_r1", "_r2", "_r3"]
    else:
        first_word = F.split(first, r"\s+").getItem(0)
        short = F.when(last.isNotNull(), F.concat_ws(" ", first_word, last))
        forms = _key_rows(known, [F.lower(full), F.lower(F.when(last.isNotNull(), whole)), F.lower(short)], id_column, order)
        aliases = people.sparkSession.createDataFrame(list(V.NAME_ALIASES.items()), "name_key string, alias_key string")
        alias_rows = aliases.join(
            people.select(F.col(key_column).alias("alias_key"), F.col(id_column).alias("found")), "alias_key"
        ).select("name_key", "found")
        rows = merge_maps([alias_rows, forms], ["name_key"])
        unique_last = (
            known.where(last.isNotNull()).groupBy(F.lower(last).alias("name_key"))
            .agg(F.count(F.lit(1)).alias("n"), F.max(id_column).alias("found")).where("n = 1")
        )
        low = F.lower("_name")
        clean = reduce(lambda c, cut: F.replace(c, F.lit(cut), F.lit("")), [".", " jr", " sr"], low)
        clean = reduce(lambda c, t: F.replace(c, F.lit(t), F.lit(" ")), [" mrs ", " mr ", " dr "], clean)
        words = F.filter(F.split(F.replace(low, F.lit("."), F.lit("")), r"\s+"), lambda w: w != "")
        tail = F.try_element_at(words, F.lit(-1))
        steps = names.withColumns({
            "_k1": low,
            "_k2": F.trim(F.regexp_replace(clean, r"\s+", " ")),
            "_k3": F.when(F.size(words) >= 2, F.concat_ws(" ", F.try_element_at(words, F.lit(1)), tail)),
            "_k4": F.rtrim(tail, F.lit(",")),
        })
        for key, into_step in (("_k1", "_r1"), ("_k2", "_r2"), ("_k3", "_r3")):
            steps = _match(steps, rows, key, into_step)
        steps = _match(steps, unique_last, "_k4", "_r4")
        results = ["_r1", "_r2", "_r3", "_r4"]
    found = F.when(F.col("_name") != "", F.coalesce(*results))
    lookup = steps.select("_name", "_last", found.alias(into), "n_rows")
    return spread_join(tagged, lookup, ["_name", "_last"]).select(*df.columns, into)


def resolve_memberships(raw: DataFrame, people: DataFrame, committees: DataFrame) -> DataFrame:
    """Raw seats -> (politician_id, committee_id, role), unresolved rows dropped, one row per pair."""
    from ledgerlight.operators.merge import keep_first

    coded = raw.select(
        F.col("politician_id").alias("bioguide_id"), X.committee_code("committee_id").alias("committee_code"), "role"
    )
    person = people.select("bioguide_id", F.col("id").alias("politician_id"))
    committee = committees.select(F.col("committee_id").alias("committee_code"), F.col("id").alias("committee_id"))
    joined = coded.join(person, "bioguide_id").join(committee, "committee_code")
    return keep_first(joined.select("politician_id", "committee_id", "role"), ["politician_id", "committee_id"], ["role"])


def resolve_positions(frames: list[DataFrame], people: DataFrame, votes: DataFrame) -> DataFrame:
    """Raw vote positions of all sources -> (politician_id, vote_id, position), one row per pair."""
    from ledgerlight.operators.merge import keep_first, union_aligned

    raw = union_aligned([f.select("politician_id", "vote_id", "position") for f in frames])
    person = people.select(F.col("bioguide_id").alias("politician_id"), F.col("id").alias("_pid"))
    vote = votes.select(F.col("roll_call_id").alias("vote_id"), F.col("id").alias("_vid"))
    joined = enrich(enrich(raw, person, ["politician_id"]), vote, ["vote_id"]).dropna(subset=["_pid", "_vid"])
    rows = joined.select(
        F.col("_pid").alias("politician_id"), F.col("_vid").alias("vote_id"), X.vote_position("position").alias("position")
    )
    return keep_first(rows, ["politician_id", "vote_id"], ["position"])


def seats(memberships: DataFrame, committees: DataFrame) -> DataFrame:
    """Seats with committee name and tag (committee_id -> id)."""
    named = committees.select(F.col("id").alias("committee_id"), F.col("name").alias("committee_name"), "sector_tag")
    return memberships.join(named, "committee_id").select("politician_id", "committee_name", "role", "sector_tag")


def access_matrix(seat_rows: DataFrame, exact: bool = False, rank_column: str = "rank_in_committee") -> DataFrame:
    """Highest access weight per (politician, sector).

    `exact` uses exact committee names and reads leadership from `rank_column` (version 1); where that
    column is absent nobody counts as a leader.
    """
    if exact:
        rank = F.col(rank_column) if rank_column in seat_rows.columns else F.lit("")
        weights = S.seat_weights_exact("committee_name", rank)
    else:
        weights = S.seat_weights("committee_name", "role", "sector_tag")
    return (
        seat_rows.select("politician_id", F.explode(weights).alias("w"))
        .groupBy("politician_id", F.col("w.sector").alias("sector"))
        .agg(F.max("w.weight").alias("weight"))
    )


def access_maps(access: DataFrame) -> DataFrame:
    """One map<sector, weight> per politician (the sector vocabulary bounds its size)."""
    return access.groupBy("politician_id").agg(
        F.map_from_entries(F.collect_list(F.struct("sector", "weight"))).alias("access")
    )


def relevance(access: Column, sector_array: Column) -> Column:
    """Best access over the trade's sectors, 0 when there is none."""
    best = F.array_max(F.transform(sector_array, lambda s: F.try_element_at(access, s)))
    return F.round(F.coalesce(best, F.lit(0.0)), 2)


def add_relevance(trades: DataFrame, access: DataFrame, name: str = "committee_relevance") -> DataFrame:
    """Trades (politician_id, sectors) with their committee relevance."""
    joined = enrich(trades, access_maps(access), ["politician_id"])
    return joined.withColumn(name, relevance(F.col("access"), F.col("sectors"))).select(*trades.columns, name)
