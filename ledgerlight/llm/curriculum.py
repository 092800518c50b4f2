"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a source over training time, as (time, weight) knots joined by lines. Sources in code point
#: order take the schedules in turn; a schedule's integral is the source's weight in the whole mix: 3, 1, 2.
SCHEDULES = (
    ((0.0, 4.5), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)),
)
SHARE = 1.5
REPEATS = 2.0
#: Hash digits of a document's key that name its block of a source; running sums never span more than a block.
BLOCK_DIGITS = 3


def integral(schedule: tuple) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def time_of(demand: Column, schedule: tuple) -> Column:
    """Training time at which the share `demand` (0 to 1) of a source's words has been used.

    The integral of the schedule is inverted piece by piece: on a line from w0 to w1 the words used
    after dt are w0*dt + (w1-w0)/(t1-t0)*dt^2/2.
    """
    area = demand * integral(schedule)
    done, out = 0.0, F.lit(schedule[-1][0])
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        left, slope = area - done, (w1 - w0) / (t1 - t0)
        root = w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * left))
        done += (t1 - t0) * (w0 + w1) / 2
        pieces.append((area < done, t0 + F.when(root > 0, 2 * left / root).otherwise(0.0)))
    for reached, time in reversed(pieces):
        out = F.when(reached, time).otherwise(out)
    return out


def source_targets(
    sizes: DataFrame, schedules: tuple = SCHEDULES, share: float = SHARE, repeats: float = REPEATS
) -> DataFrame:
    """(source, source_size, schedule, target) per source of `sizes` (source, size).

    The sources share `share` times all words by weight. A target stops at `repeats` times its source's
    words, and the excess goes to the others by weight until none is above. In the order of the ratio
    cap/weight the capped sources come first: one is capped when what the earlier ones leave, dealt out
    by weight, would lift it above its cap.
    """
    weights = F.array(*[F.lit(float(integral(s))) for s in schedules])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "schedule", ((F.row_number().over(order) - 1) % len(schedules)).cast("int")
    ).withColumn("weight", F.get(weights, F.col("schedule"))).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    capped = listed.withColumn("capped", F.col("cap") / F.col("weight") <= left / rest).withColumn("total", total)
    level = (F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)) / F.sum(
        F.when(~F.col("capped"), F.col("weight"))
    ).over(everything)
    return capped.withColumn(
        "target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    ).select("source", "source_size", "schedule", "target")


def plan(
    docs: DataFrame, size: Column, key: Column, schedules: tuple = SCHEDULES, share: float = SHARE, repeats: float = REPEATS
) -> DataFrame:
    """`docs` (source and any other columns) with _size, _key, _source_size, _target and _copies.

    _copies lists the document's copies in the mix as structs (copy, taken, position): how many of its
    words the copy gives and the training time, 0 to 1, at which it starts. A source's documents follow
    one another in the order of the hash `key`, again from the start once all are used; a copy starts
    where the words before it end, and the copy that reaches the target gives its first words only, so
    each source gives its target, rounded to words. Documents without words are in no copy. Repeated
    rows follow one another. NULL is a source of its own, after all others.

    Each source is cut into blocks by its documents' hash. Words are summed per block, the blocks' sums
    run within a source, and documents run within a block: no source, however large, is one task.
    """
    keyed = docs.withColumns({"_size": size, "_key": key}).withColumns({
        "_group": F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string"))),
        "_block": F.substring("_key", 1, BLOCK_DIGITS),
    })
    blocks = keyed.groupBy("_group", "_block").agg(F.first("source").alias("source"), F.sum("_size").alias("words"))
    targets = source_targets(blocks.select("source", F.col("words").alias("size")), schedules, share, repeats)
    targets = targets.withColumn(
        "_group", F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    ).drop("source")
    earlier = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(targets, "_group").select(
        "_group", "_block", "_offset", F.col("source_size").alias("_source_size"), F.col("schedule").alias("_schedule"),
        F.col("target").alias("_target"),
    )
    inside = Window.partitionBy("_group", "_block").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(starts, ["_group", "_block"])
    budget = F.floor(F.col("_target") + 0.5)

    def copy(number: int) -> Column:
        start = F.col("_source_size") * number + F.col("_offset") + F.col("_before")
        demand = F.try_divide(start, F.col("_target"))
        time = F.lit(None).cast("double")
        for i, schedule in enumerate(schedules):
            time = F.when(F.col("_schedule") == i, time_of(demand, schedule)).otherwise(time)
        taken = F.greatest(F.lit(0), F.least(F.col("_size"), budget - start)).cast("long")
        return F.struct(F.lit(number).alias("copy"), taken.alias("taken"), time.alias("position"))

    copies = F.array(*[copy(i) for i in range(math.ceil(repeats))])
    return placed.withColumn("_copies", F.filter(copies, lambda c: c["taken"] > 0)).drop(
        "_group", "_block", "_before", "_offset", "_schedule"
    )


def hash_key(doc_id: Column, seed: str = "curriculum") -> Column:
    """Order of documents within a source: the MD5 of the id, the same in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def in_training_order(planned: DataFrame) -> DataFrame:
    """One row per copy with its _copy struct, range-sorted by training time."""
    return planned.withColumn("_copy", F.explode("_copies")).drop("_copies").orderBy("_copy.position", "_key", "_copy.copy")
