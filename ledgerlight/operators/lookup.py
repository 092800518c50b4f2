"""Joins of a large table to a table with one row per key, safe under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one key that a task should get at most, slots that keys are hashed to, and parts of rows without a key.
HOT_ROWS = 1_000_000
SLOTS = 1 << 16
SPREAD = 4096
#: Keys that are broadcast at most to leave out the rows of a larger table that match none of them.
FEW_KEYS = 200_000


def _row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    hashable = [
        F.col(f"`{f.name}`") for f in df.schema.fields
        if not isinstance(f.dataType, (T.MapType, T.VariantType)) and (columns is None or f.name in columns)
    ]
    return F.xxhash64(*hashable, F.spark_partition_id())


def known(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NULL in the given columns."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def _slot(df: DataFrame, keys: list[str]) -> Column:
    """Slot of a row's keys. Equal keys have to get equal hashes on both sides, whatever their integer widths."""
    return F.pmod(F.xxhash64(*[F.col(k).cast(df.schema[k].dataType) for k in keys]), F.lit(SLOTS)).cast("int")


def _hot_slots(counted: DataFrame, slot: Column, heaviest: Column, most: int) -> DataFrame:
    """(_slot, _parts) of the slots whose heaviest key has more than `most` rows."""
    return counted.groupBy(slot.alias("_slot")).agg(heaviest.alias("_most")).where(F.col("_most") > most).select(
        "_slot", F.ceil(F.col("_most") / F.lit(max(1, most))).alias("_parts")
    )


def spread_join(
    left: DataFrame, lookup: DataFrame, keys: list[str], weight: str = "n_rows", hot_rows: int | None = None,
    source: DataFrame | None = None, dealt_by: list[str] | None = None,
) -> DataFrame:
    """Left join to `lookup` (unique on `keys`), where `weight` counts the left rows of each key.

    Keys are hashed to SLOTS slots. A slot whose heaviest key has more than `hot_rows` rows is cut
    into as many parts as that takes: the left rows of all its keys are dealt to the parts by a hash of
    the row, and the lookup rows go to every part. However many keys are hot, what is broadcast is one
    pair of numbers per slot. Rows with a NULL key match nothing and are dealt out likewise. One pass
    over `left`; no row is dropped or repeated.

    With `source`, a cheap table with at least the keys of `left`, its rows are counted by slot and the lookup,
    which may be dear, is worked out once instead of twice; `weight` isn't needed then.

    `dealt_by` names columns that tell the rows of a key apart: only they are hashed, so that columns nobody asks
    for aren't read and sent for the hash alone.
    """
    values = [c for c in lookup.columns if c not in keys and c != weight]
    most = HOT_ROWS if hot_rows is None else hot_rows
    lookup = known(lookup, keys)
    slot = _slot(left, keys)
    counted = lookup if source is None else known(source, keys)
    parts = _hot_slots(counted, slot, F.max(weight) if source is None else F.count(F.lit(1)), most)
    cut = lookup.withColumn("_slot", slot).join(F.broadcast(parts), "_slot", "left").select(
        *keys, F.struct(*values).alias("_found"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part")
    )
    joined = _dealt(left, keys, slot, parts, dealt_by).join(cut, [*keys, "_part"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col("_found")[v].alias(v) for v in values])


def _dealt(left: DataFrame, keys: list[str], slot: Column, parts: DataFrame, dealt_by: list[str] | None) -> DataFrame:
    """`left` with the part of its slot that each row is dealt to; rows without a key are dealt out likewise."""
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    part = F.pmod(_row_hash(left, dealt_by), F.when(no_key, F.lit(SPREAD)).otherwise(F.coalesce("_parts", F.lit(1))))
    return left.withColumn("_slot", slot).join(F.broadcast(parts), "_slot", "left").withColumn("_part", part)


def gathered(
    left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int | None = None, source: DataFrame | None = None,
    dealt_by: list[str] | None = None, tasks: int | None = None,
) -> DataFrame:
    """The rows of both tables, those of equal `keys` in one place, so that windows over (keys, `_part`) need no other shuffle.

    Adds `_part` and `_met`, a struct of the columns that only `right` has; it is NULL in the rows of `left`. Other
    columns of `left` are NULL in the rows of `right`. Hot slots are cut into parts as in `spread_join`: each row of
    `left` is in one part, the rows of `right` are in every part of their slot. `source` (by default `left`) is a
    table with at least the keys of `left`, on which these are counted. `tasks` is the number of tasks they are dealt
    to, so that a task's share doesn't grow with the table.
    """
    most = HOT_ROWS if hot_rows is None else hot_rows
    parts = _hot_slots(known(left if source is None else source, keys), _slot(left, keys), F.count(F.lit(1)), most)
    shared = [c for c in right.columns if c in left.columns]
    facts = F.struct(*[F.col(c) for c in right.columns if c not in left.columns])
    met = known(right, keys).withColumn("_slot", _slot(left, keys)).join(F.broadcast(parts), "_slot", "left").select(
        *[F.col(c).cast(left.schema[c].dataType).alias(c) for c in shared], facts.alias("_met"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"),
    )
    own = _dealt(left, keys, _slot(left, keys), parts, dealt_by).drop("_slot", "_parts")
    return own.unionByName(met, allowMissingColumns=True).repartition(*([tasks] if tasks else []), *keys, "_part")


def in_hot_slots(left: DataFrame, keys: list[str], hot_rows: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """The rows of `left` that `gathered` deals to several parts."""
    most = HOT_ROWS if hot_rows is None else hot_rows
    parts = _hot_slots(known(left if source is None else source, keys), _slot(left, keys), F.count(F.lit(1)), most)
    return known(left, keys).withColumn("_slot", _slot(left, keys)).join(F.broadcast(parts), "_slot", "left_semi").drop("_slot")


def only_keys(left: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `left` whose key is in `keys`, a cheap table of that column alone, if these are few; otherwise all rows.

    For rows that a later step drops anyway: those of a few keys needn't be shuffled with all others before it.
    """
    keys = keys.distinct()
    return left.join(F.broadcast(keys), keys.columns, "left_semi") if keys.count() <= FEW_KEYS else left


def enrich(
    left: DataFrame, values: DataFrame, keys: list[str], source: DataFrame | None = None, dealt_by: list[str] | None = None
) -> DataFrame:
    """`spread_join` to any table that is unique on `keys`.

    The rows are counted on `source`, which may be a cheaper table with at least the keys of
    `left` (e.g. before joins); by default on `left` itself.
    """
    return spread_join(left, values, keys, weight="", source=left if source is None else source, dealt_by=dealt_by)
