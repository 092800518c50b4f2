"""Temporal operators: as-of, nearest-event, peer-cluster, nearest-k and window lookups.

All of them follow one shape. The answer depends only on the key and the calendar day, so the
large table is first reduced to its distinct (key, day) pairs with a map-side combined count, the
question is answered on that timeline (at most one row per key and day, whatever the number of
trades) with ordered windows, and the answers go back through `spread_join`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.scores import excess_return
from ledgerlight.functions.vocab import (
    ALPHA_BACKWARD_DAYS, ALPHA_FORWARD_DAYS, BENCHMARK_TICKER, BILL_CAP_DAYS, BILL_WINDOW_DAYS, CLUSTER_DAYS,
    VOTE_CAP_DAYS,
)
from ledgerlight.operators.lookup import gathered, in_hot_slots, known, spread_join

#: Rows of the large table behind one task's share of a timeline.
TASK_ROWS = 250_000


def tasks_for(df: DataFrame) -> int:
    """Number of tasks that a timeline of `df`, a table whose rows are cheap to count, is dealt to."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / TASK_ROWS))


def _cols(by: str | list[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _so_far(keys: list[str], order: Column):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _pairs(left: DataFrame, keys: list[str], date: str, buckets: int | None = None) -> DataFrame:
    """Distinct (keys, day) of the large table with the number of rows behind each.

    With `buckets` they are dealt as a table stored in that many buckets of the keys is, so that the stored
    table meets them where it lies.
    """
    pairs = known(left, [*keys, date]).groupBy(*keys, date).agg(F.count(F.lit(1)).alias("n_rows"))
    return pairs.repartition(buckets, *keys) if buckets else pairs


def _timeline(
    points: DataFrame, probes: DataFrame, keys: list[str], date: str, payload: str, buckets: int | None = None
) -> DataFrame:
    """One row per (keys, day): the payload of that day, if any, and the probe count, if any.

    With `buckets` both sides lie in that many buckets of the keys and stay there: a union would forget it, so
    the days of a key (at most the calendar's) are joined as two lists. Keys without a probe are left out.
    """
    if buckets:
        asked = probes.groupBy(*keys).agg(F.collect_list(F.struct(F.col(date), F.lit(None).cast(points.schema[payload].dataType).alias(payload), F.col("n_rows"))).alias("_asked"))
        stored = points.groupBy(*keys).agg(F.collect_list(F.struct(F.col(date), F.col(payload), F.lit(0).cast("long").alias("n_rows"))).alias("_stored"))
        both = asked.join(stored.hint("merge"), keys, "left").select(
            *keys, F.explode(F.concat("_asked", F.coalesce("_stored", F.array()))).alias("_row")
        )
        return both.groupBy(*keys, F.col(f"_row.{date}").alias(date)).agg(
            F.max(f"_row.{payload}").alias(payload), F.sum("_row.n_rows").alias("n_rows")
        )
    merged = points.select(*keys, date, payload, F.lit(0).cast("long").alias("n_rows")).unionByName(
        probes.select(*keys, date, "n_rows"), allowMissingColumns=True
    )
    return merged.groupBy(*keys, date).agg(F.max(payload).alias(payload), F.sum("n_rows").alias("n_rows"))


def asof_lookup(
    left: DataFrame, right: DataFrame, by, date: str, value: str, direction: str = "forward",
    tolerance_days: int | None = None, matched_date: str | None = None, buckets: int | None = None,
) -> DataFrame:
    """Distinct (by, date) of `left` with the as-of value of `right` and the row count `n_rows`.

    `buckets`: `right` is stored in that many buckets of `by` (`sources.bucketed`) and isn't shuffled.
    """
    if direction not in ("forward", "backward"):
        raise ValueError(f"unknown direction {direction!r}")
    keys = _cols(by)
    points = right.where(F.col(value).isNotNull()).groupBy(*keys, date).agg(F.max(value).alias("_value"))
    line = _timeline(points, _pairs(left, keys, date, buckets), keys, date, "_value", buckets)
    order = F.col(date).asc() if direction == "backward" else F.col(date).desc()
    seen = F.when(F.col("_value").isNotNull(), F.struct(F.col("_value"), F.col(date).alias("_date")))
    out = line.withColumn("_hit", F.last(seen, ignorenulls=True).over(_so_far(keys, order))).where("n_rows > 0")
    hit = F.col("_hit")
    if tolerance_days is not None:
        hit = F.when(F.abs(F.datediff(hit["_date"], F.col(date))) <= tolerance_days, hit)
    columns = [hit["_value"].alias(value)]
    if matched_date:
        columns.append(hit["_date"].alias(matched_date))
    return out.select(*keys, date, *columns, "n_rows")


def asof_join(
    left: DataFrame, right: DataFrame, by, date: str, value: str, direction: str = "forward",
    tolerance_days: int | None = None, matched_date: str | None = None, buckets: int | None = None,
) -> DataFrame:
    """First value on/after the day ("forward") or last value on/before it ("backward").

    Without `tolerance_days` the match may be arbitrarily far away.
    """
    lookup = asof_lookup(left, right, by, date, value, direction, tolerance_days, matched_date, buckets)
    return spread_join(left, lookup, [*_cols(by), date], source=left)


def _window_prices(pairs: DataFrame, prices: DataFrame, forward: int, backward: int) -> DataFrame:
    """Per (ticker, day): first close on/after d and d+forward, last close on/before d and d-backward.

    Growing range frames ("everything up to n days before this row" in ascending or descending day
    order) answer the shifted probes without adding rows for them.
    """
    points = prices.where(F.col("close").isNotNull()).groupBy("ticker", "date").agg(F.max("close").alias("close"))
    line = _timeline(points, pairs, ["ticker"], "date", "close")

    def close_until(days: Column, gap: int) -> Column:
        frame = Window.partitionBy("ticker").orderBy(days).rangeBetween(Window.unboundedPreceding, -gap)
        return F.last("close", ignorenulls=True).over(frame)

    rising, falling = F.unix_date("date"), -F.unix_date("date")
    return line.select(
        "ticker", "date", "n_rows",
        close_until(falling, 0).alias("f0"), close_until(falling, forward).alias("f1"),
        close_until(rising, 0).alias("b1"), close_until(rising, backward).alias("b0"),
    ).where("n_rows > 0")


def _day_order(date: str, falling: bool = False) -> Column:
    return -F.unix_date(date) if falling else F.unix_date(date)


def _up_to(keys: list[str], order: Column, gap: int = 0):
    """Rows of a gathered key up to `gap` days before this row's day in the given order of days; negative: after it."""
    return Window.partitionBy(*keys, "_part").orderBy(order).rangeBetween(Window.unboundedPreceding, -gap)


def _last_close(keys: list[str], order: Column, gap: int) -> Column:
    """Close of the last day with one, in the given order, up to `gap` days before; the highest of that day."""
    close = F.col("_met.close")
    return F.max(F.when(close.isNotNull(), F.struct(order.alias("day"), close.alias("close")))).over(_up_to(keys, order, gap))["close"]


def ticker_facts(
    trades: DataFrame, prices: DataFrame, entity: str | None = None, benchmark: str = BENCHMARK_TICKER,
    forward: int = ALPHA_FORWARD_DAYS, backward: int = ALPHA_BACKWARD_DAYS, days: int = CLUSTER_DAYS,
    source: DataFrame | None = None, dealt_by: list[str] | None = None, tasks: int | None = None,
) -> DataFrame:
    """Trades with cohort_alpha and pre_trade_alpha against the benchmark and, given an `entity`, `peers`.

    Trades and closes go to their ticker in one shuffle, and windows over the days answer there: no lookup is
    shuffled before or after. `peers` counts the distinct entities with a trade of the ticker within +-days, those of
    the trade included: an entity's covers begin at the days without another one in the 2 * days before and end at
    those without one after, and both are counted by running sums. The entities of a ticker that is cut into parts
    aren't all in one place: its peers are looked up by `peer_lookup` and gathered like closes.

    `prices` has ticker, price_date, close and holds the benchmark too. The benchmark is one key,
    so it is resolved on the distinct days alone: at most one row per calendar day, broadcast.
    `source`, `dealt_by` and `tasks` as in `gathered`; `source` has the trades' days too.
    """
    source, keys, date = trades if source is None else source, ["ticker"], "trade_date"
    series = prices.select("ticker", F.col("price_date").alias("date"), F.col("close").cast("double").alias("close"))
    asked = known(source, ["ticker", date]).groupBy(F.col(date).alias("date")).agg(F.count(F.lit(1)).alias("n_rows"))
    bench = _window_prices(asked.withColumn("ticker", F.lit(benchmark)), series.where(F.col("ticker") == benchmark), forward, backward).select(
        F.col("date").alias(date), *[F.col(c).alias(f"_s_{c}") for c in ("f0", "f1", "b0", "b1")]
    )
    right = series.withColumnRenamed("date", date)  # a day without a close changes nothing
    if entity is not None:
        crowded = peer_lookup(in_hot_slots(source, keys), "ticker", entity, date, days).select("ticker", date, "peers")
        right = right.unionByName(crowded, allowMissingColumns=True)
    rows = gathered(trades, right, keys, source=source, dealt_by=dealt_by, tasks=tasks)
    rising, falling = _day_order(date), _day_order(date, True)
    asks = F.col("ticker").isNotNull() & F.col(date).isNotNull()
    out = {}
    if entity is not None:
        named = asks & F.col("_met").isNull() & F.col(entity).isNotNull()
        own = Window.partitionBy(*keys, "_part", entity).orderBy(date)
        since, until = F.datediff(date, F.lag(date).over(own)), F.datediff(F.lead(date).over(own), date)
        rows = rows.withColumns({
            "_begins": F.when(named & F.coalesce(since > 2 * days, F.lit(True)), 1).otherwise(0),
            "_ends": F.when(named & F.coalesce(until > 2 * days, F.lit(True)), 1).otherwise(0),
        })
        here = F.max(F.when(F.col("_met.peers").isNotNull(), F.struct(rising.alias("day"), F.col("_met.peers").alias("peers")))).over(_up_to(keys, rising))
        counted = F.sum("_begins").over(_up_to(keys, rising, -days)) - F.coalesce(F.sum("_ends").over(_up_to(keys, rising, days + 1)), F.lit(0))
        out["peers"] = F.when(asks, F.coalesce(F.when(here["day"] == rising, here["peers"]), counted))
    rows = rows.withColumns({
        **out, "_b1": _last_close(keys, rising, 0), "_b0": _last_close(keys, rising, backward),
    }).withColumns({"_f0": _last_close(keys, falling, 0), "_f1": _last_close(keys, falling, forward)})
    return rows.where(F.col("_met").isNull()).join(F.broadcast(bench), date, "left").select(
        *[F.col(f"`{c}`") for c in trades.columns],
        F.when(asks, excess_return("_f0", "_f1", "_s_f0", "_s_f1")).alias("cohort_alpha"),
        F.when(asks, excess_return("_b0", "_b1", "_s_b0", "_s_b1")).alias("pre_trade_alpha"), *out,
    )


def add_alphas(trades: DataFrame, prices: DataFrame, benchmark: str = BENCHMARK_TICKER, dealt_by: list[str] | None = None) -> DataFrame:
    """Trades with cohort_alpha and pre_trade_alpha (both NULL where prices are missing)."""
    return ticker_facts(trades, prices, benchmark=benchmark, dealt_by=dealt_by)


def entity_facts(
    left: DataFrame, events: DataFrame, by: str, date: str, max_days: int, facts: DataFrame | None = None,
    matched: DataFrame | None = None, source: DataFrame | None = None, dealt_by: list[str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """`left` with `gap_days` to the nearest event of the same key, NULL beyond `max_days`, and the columns of other tables.

    `facts` has one row per key, `matched` one per key and day; their columns are NULL in rows without a key or a day
    and where there is no row for them. All tables meet in one shuffle by the key. `source`, `dealt_by` and `tasks` as in `gathered`.
    """
    right = known(events.select(by, date), [by, date]).withColumn("_event", F.lit(True))
    names = {"_facts": facts, "_matched": matched}
    for name, table in names.items():
        if table is not None:
            own = [c for c in table.columns if c not in (by, date)]
            right = right.unionByName(table.select(by, *([date] if date in table.columns else []), F.struct(*own).alias(name)), allowMissingColumns=True)
    rows = gathered(left, right, [by], source=source, dealt_by=dealt_by, tasks=tasks)
    rising, falling = _day_order(date), _day_order(date, True)
    day = F.when(F.col("_met._event"), F.col(date))
    rows = rows.withColumn("_ahead", F.datediff(F.last(day, ignorenulls=True).over(_up_to([by], falling)), date))
    # Rows without a day, as those of `facts` are, come first.
    found = {"_back": F.datediff(date, F.last(day, ignorenulls=True).over(_up_to([by], rising)))}
    for name, table in names.items():
        if table is not None:
            met = F.col(f"_met.{name}")
            found[name] = F.last(F.when(met.isNotNull(), F.struct(F.col(date).alias("on"), met.alias("row"))), ignorenulls=True).over(_up_to([by], rising))
    asks = F.col(by).isNotNull() & F.col(date).isNotNull()
    nearest = F.least("_back", "_ahead")
    columns = [F.when(asks & (nearest <= max_days), nearest).alias("gap_days")]
    for name, table in names.items():
        if table is not None:
            here = asks if date not in table.columns else asks & (F.col(name)["on"] == F.col(date))
            columns += [F.when(here, F.col(name)["row"][c]).alias(c) for c in table.columns if c not in (by, date)]
    return rows.withColumns(found).where(F.col("_met").isNull()).select(*[F.col(f"`{c}`") for c in left.columns], *columns)


def nearest_lookup(left: DataFrame, events: DataFrame, by, date: str, max_days: int) -> DataFrame:
    """Distinct (by, date) of `left` with `gap_days` to the nearest event of the same key."""
    keys = _cols(by)
    points = known(events.select(*keys, date), [*keys, date]).distinct().withColumn("_event", F.lit(True))
    line = _timeline(points, _pairs(left, keys, date), keys, date, "_event")
    day = F.when(F.col("_event"), F.col(date))
    gaps = line.select(
        *keys, date, "n_rows",
        F.datediff(date, F.last(day, ignorenulls=True).over(_so_far(keys, F.asc(date)))).alias("_back"),
        F.datediff(F.last(day, ignorenulls=True).over(_so_far(keys, F.desc(date))), date).alias("_ahead"),
    ).where("n_rows > 0")
    nearest = F.least("_back", "_ahead")
    return gaps.select(*keys, date, F.when(nearest <= max_days, nearest).alias("gap_days"), "n_rows")


def nearest_event(
    left: DataFrame, events: DataFrame, by, date: str, max_days: int = VOTE_CAP_DAYS, name: str = "gap_days"
) -> DataFrame:
    """Days to the nearest event of the same key, NULL beyond `max_days`."""
    lookup = nearest_lookup(left, events, by, date, max_days).withColumnRenamed("gap_days", name)
    return spread_join(left, lookup, [*_cols(by), date], source=left)


def _exploded(left: DataFrame, array: str, item: str, *others: str) -> DataFrame:
    return left.select(*others, F.explode(F.array_distinct(array)).alias(item))


def _per_item(array: Column, table: Column) -> Column:
    return F.transform(array, lambda item: F.try_element_at(table, item))


def category_gaps(
    source: DataFrame, events: DataFrame, array: str, category: str, date: str, max_days: int = BILL_CAP_DAYS
) -> DataFrame:
    """Per day of `source`: map of category to the gap to its nearest event."""
    gaps = nearest_lookup(_exploded(source, array, category, date), events, category, date, max_days)
    return gaps.where("gap_days is not null").groupBy(date).agg(
        F.map_from_entries(F.collect_list(F.struct(category, "gap_days"))).alias("_gaps")
    )


def apply_category_gaps(left: DataFrame, gaps: DataFrame, array: str, date: str, name: str = "gap_days") -> DataFrame:
    """Smallest gap over the row's categories. `gaps` has one small map per calendar day: broadcast."""
    return (
        left.join(F.broadcast(gaps), date, "left")
        .withColumn(name, F.array_min(_per_item(F.col(array), F.col("_gaps"))))
        .select(*left.columns, name)
    )


def nearest_category_event(
    left: DataFrame, events: DataFrame, array: str, category: str, date: str,
    max_days: int = BILL_CAP_DAYS, name: str = "gap_days",
) -> DataFrame:
    """Days to the nearest event in any of the row's categories (an array column).

    The events' categories are a small fixed vocabulary (sectors), so the answers are one map per
    calendar day and are broadcast: the large table is not shuffled at all.
    """
    gaps = category_gaps(left, events, array, category, date, max_days)
    return apply_category_gaps(left, gaps, array, date, name)


def smallest_gap(array: Column, gaps: Column) -> Column:
    """Smallest gap over the categories of an array, by a map of category to gap; NULL without any."""
    return F.array_min(_per_item(array, gaps))


def category_gaps_by_key(source: DataFrame, events: DataFrame, entity: str, array: str, category: str, date: str, max_days: int) -> DataFrame:
    """(entity, date, `_gaps`) of `source`: map of category to the gap to the entity's nearest event in it, where there is one."""
    keys = [entity, date]
    matched = nearest_lookup(_exploded(source, array, category, *keys), events, [entity, category], date, max_days)
    return matched.where("gap_days is not null").groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(category, "gap_days"))).alias("_gaps")
    )


def nearest_two_tier(
    left: DataFrame, events: DataFrame, entity: str, array: str, category: str, date: str,
    max_days: int = VOTE_CAP_DAYS, name: str = "gap_days", source: DataFrame | None = None,
) -> DataFrame:
    """Nearest event of the entity in one of the row's categories, else nearest event of the entity.

    `source` may be a cheaper table with at least the keys of `left` (e.g. before joins).
    """
    keys, source = [entity, date], left if source is None else source
    any_gap = nearest_lookup(source, events, entity, date, max_days)
    by_key = category_gaps_by_key(source, events, entity, array, category, date, max_days)
    lookup = any_gap.join(by_key, keys, "left")
    joined = spread_join(left, lookup, keys, source=source)
    tier1 = smallest_gap(F.col(array), F.col("_gaps"))
    return joined.withColumn(name, F.coalesce(tier1, F.col("gap_days"))).select(*left.columns, name)


def presence(left: DataFrame, by: str, entity: str, date: str) -> DataFrame:
    """Distinct (by, entity, day) with the number of rows behind each."""
    return known(left, [by, date]).groupBy(by, entity, date).agg(F.count(F.lit(1)).alias("n_rows"))


def peer_lookup(
    left: DataFrame, by: str, entity: str, date: str, days: int = CLUSTER_DAYS, tasks: int | None = None
) -> DataFrame:
    """Per distinct (by, date): distinct entities within +-days (`peers`) and on the day (`on_day`).

    A sweep instead of a self join: every entity covers [d-days, d+days] around each of its days,
    overlapping covers of one entity are merged, and the covers are counted by a running sum over
    at most a few rows per calendar day. No pairs of trades are ever formed. `tasks` (`tasks_for`): number of
    tasks that the entities' days are dealt to, so that a task's share doesn't grow with the table.
    """
    previous = F.lag(date).over(Window.partitionBy(by, entity).orderBy(date))
    named = F.col(entity).isNotNull()
    seen = presence(left, by, entity, date)
    seen = seen.repartition(tasks, by, entity) if tasks else seen
    marks = seen.withColumn("_prev", previous).select(
        by,
        F.explode(F.array(
            F.struct(
                F.greatest(F.date_sub(date, days), F.date_add("_prev", days + 1)).alias("day"),
                F.when(named, 1).otherwise(0).alias("step"), F.lit(0).alias("here"),
                F.lit(0).cast("long").alias("n_rows")),
            F.struct(
                F.date_add(date, days + 1).alias("day"), F.when(named, -1).otherwise(0).alias("step"),
                F.lit(0).alias("here"), F.lit(0).cast("long").alias("n_rows")),
            F.struct(
                F.col(date).alias("day"), F.lit(0).alias("step"), F.when(named, 1).otherwise(0).alias("here"),
                F.col("n_rows").alias("n_rows")),
        )).alias("m"),
    )
    per_day = marks.groupBy(by, F.col("m.day").alias(date)).agg(
        F.sum("m.step").alias("_step"), F.sum("m.here").alias("on_day"), F.sum("m.n_rows").alias("n_rows")
    )
    return (
        per_day.withColumn("peers", F.sum("_step").over(_so_far([by], F.asc(date))))
        .where("n_rows > 0")
        .select(by, date, "peers", "on_day", "n_rows")
    )


def peer_cluster(
    left: DataFrame, by: str, entity: str, date: str, days: int = CLUSTER_DAYS, name: str = "cluster_score",
    tasks: int | None = None,
) -> DataFrame:
    """Number of distinct other entities in the same key within +-days; 0 for an unknown entity."""
    lookup = peer_lookup(left, by, entity, date, days, tasks).select(by, date, "peers", "n_rows")
    joined = spread_join(left, lookup, [by, date], source=left)
    others = F.when(F.col(entity).isNotNull(), F.coalesce(F.col("peers") - 1, F.lit(0))).otherwise(0)
    return joined.withColumn(name, others.cast("int")).select(*left.columns, name)


def busy_days(
    left: DataFrame, by: str, entity: str, date: str, days: int = CLUSTER_DAYS, at_least: int = 3, limit: int = 10
) -> DataFrame:
    """(by, date) with at least `at_least` entities that have company within +-days; the top `limit`."""
    return (
        peer_lookup(left, by, entity, date, days)
        .where((F.col("peers") >= 2) & (F.col("on_day") >= at_least))
        .select(by, date, F.col("on_day").alias("n_entities"))
        .orderBy(F.desc("n_entities"), by, date)
        .limit(limit)
    )


def _nearest_lists(
    probes: DataFrame, events: DataFrame, keys: list[str], date: str, event_id: str, k: int, max_days: int
) -> DataFrame:
    """Per probe (keys, day): array `_near` of the k nearest events of the same keys within +-max_days.

    Only the k smallest ids of a day and the k nearest days on either side are ever kept, since no
    probe can use more.
    """
    extra = [c for c in events.columns if c not in (*keys, date, event_id)]
    rank = F.row_number().over(Window.partitionBy(*keys, date).orderBy(event_id))
    item = F.struct(F.col(event_id), F.col(date).alias("event_date"), *extra)
    per_day = (
        known(events, [*keys, date]).withColumn("_rank", rank).where(F.col("_rank") <= k)
        .groupBy(*keys, date).agg(F.collect_list(item).alias("_items"))
    )
    by_day = Window.partitionBy(*keys).orderBy(date)
    reach = per_day.select(
        *keys, date,
        F.struct(
            F.flatten(F.collect_list("_items").over(by_day.rowsBetween(-(k - 1), 0))).alias("behind"),
            F.flatten(F.collect_list("_items").over(by_day.rowsBetween(0, k - 1))).alias("ahead"),
        ).alias("_reach"),
    )
    line = _timeline(reach, probes, keys, date, "_reach")
    sides = line.select(
        *keys, date, "n_rows",
        F.last("_reach", ignorenulls=True).over(_so_far(keys, F.asc(date)))["behind"].alias("behind"),
        F.last("_reach", ignorenulls=True).over(_so_far(keys, F.desc(date)))["ahead"].alias("ahead"),
    ).where("n_rows > 0")
    found = F.array_compact(F.flatten(F.array_compact(F.array("behind", "ahead"))))
    scored = F.transform(found, lambda e: F.struct(
        F.abs(F.datediff(e["event_date"], F.col(date))).alias("gap_days"),
        e[event_id].alias(event_id), e["event_date"].alias("event_date"), *[e[c].alias(c) for c in extra],
    ))
    near = F.slice(F.array_sort(F.array_distinct(F.filter(scored, lambda e: e["gap_days"] <= max_days))), 1, k)
    return sides.select(*keys, date, near.alias("_near"), "n_rows")


def nearest_k_by(
    left: DataFrame, events: DataFrame, by, date: str, event_id: str,
    k: int = 3, max_days: int = BILL_WINDOW_DAYS, name: str = "nearby",
) -> DataFrame:
    """The k events of the same key nearest in time within +-max_days, ordered by gap, then id."""
    keys = _cols(by)
    near = _nearest_lists(_pairs(left, keys, date), events, keys, date, event_id, k, max_days)
    return spread_join(left, near.withColumnRenamed("_near", name), [*keys, date], source=left)


def nearest_k(
    left: DataFrame, events: DataFrame, array: str, category: str, date: str, event_id: str,
    k: int = 3, max_days: int = BILL_WINDOW_DAYS, name: str = "nearby", told: dict[str, Column] | None = None,
    source: DataFrame | None = None, dealt_by: list[str] | None = None,
) -> DataFrame:
    """The k events nearest in time within +-max_days in any of the row's categories.

    Adds array<struct<gap_days, event_id, event_date, ...event columns>> ordered by gap, then id, NULL
    where nothing is near. The answer depends on the categories and the day alone: it is worked out per
    distinct pair of these, from k events per category and day, and joined back by key. `told` names further
    columns made of that list, worked out once per pair as well. `source` may be a cheaper table with at least
    the keys of `left` (e.g. before joins); `dealt_by` as in `spread_join`.
    """
    source = left if source is None else source
    combos = known(source, [array, date]).groupBy(array, date).agg(F.count(F.lit(1)).alias("n_rows"))
    asked = combos.select(array, date, "n_rows", F.explode(F.array_distinct(array)).alias(category))
    lists = _nearest_lists(_pairs(asked, [category], date), events, [category], date, event_id, k, max_days)
    found = asked.join(lists.where(F.size("_near") > 0).select(category, date, "_near"), [category, date])
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_near")))), 1, k)
    answers = found.groupBy(array, date).agg(best.alias(name), F.max("n_rows").alias("n_rows"))
    # The day goes first: days are quicker to sort by than lists.
    return spread_join(left, answers.withColumns(told or {}), [date, array], source=source, dealt_by=dealt_by)


def price_window(
    trades: DataFrame, prices: DataFrame, days: int = 30, fallback: int = 200, name: str = "closes",
    buckets: int | None = None,
) -> DataFrame:
    """Closes within +-days of each trade; without any, the first `fallback` closes of the ticker.

    Adds array<struct<price_date, close>> in date order. `buckets`: `prices` is stored in that many buckets of
    the ticker and isn't shuffled.
    """
    points = prices.groupBy("ticker", F.col("price_date").alias("trade_date")).agg(F.max("close").alias("close"))
    pairs = _pairs(trades, ["ticker"], "trade_date", buckets)
    if not buckets:
        # Days of both kinds are sent to their ticker's place once; the windows below and the first closes find them there.
        points, pairs = points.repartition("ticker"), pairs.repartition("ticker")
    line = _timeline(points, pairs, ["ticker"], "trade_date", "close", buckets)
    entry = F.when(
        F.col("close").isNotNull(), F.struct(F.col("trade_date").alias("price_date"), F.col("close"))
    )
    around = Window.partitionBy("ticker").orderBy(F.unix_date("trade_date")).rangeBetween(-days, days)
    near = line.withColumn("_near", F.collect_list(entry).over(around)).where("n_rows > 0")
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("trade_date"))
    first = (
        points.withColumn("_rank", rank).where(F.col("_rank") <= fallback)
        .groupBy("ticker").agg(F.collect_list(entry).alias("_first"))
    )
    # A day without closes of its own is in no lookup and takes those of its ticker from one list, which isn't
    # repeated for every day.
    own = near.where(F.size("_near") > 0).select("ticker", "trade_date", F.sort_array("_near").alias("_own"))
    joined = spread_join(trades, own, ["ticker", "trade_date"], source=trades)
    joined = spread_join(joined, first.select("ticker", F.sort_array("_first").alias("_first")), ["ticker"], source=trades, dealt_by=trades.columns)
    closes = F.when(F.col("trade_date").isNotNull(), F.coalesce("_own", "_first"))
    return joined.select(*[F.col(f"`{c}`") for c in trades.columns], closes.alias(name))
