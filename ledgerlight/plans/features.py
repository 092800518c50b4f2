"""Feature matrices of the cohort and the institutional (baseline) trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import scores as N
from ledgerlight.functions import sectors as S
from ledgerlight.functions import vocab as V
from ledgerlight.operators.analytics import amount_stats
from ledgerlight.operators.clean import scoreable
from ledgerlight.operators.entity import access_maps, access_matrix, relevance
from ledgerlight.operators.lookup import enrich, only_keys, spread_join
from ledgerlight.operators.temporal import (
    add_alphas, apply_category_gaps, category_gaps, category_gaps_by_key, entity_facts, nearest_lookup, peer_lookup, smallest_gap,
    ticker_facts,
)
from ledgerlight.session import scratch_path


ID_COLUMNS = ["trade_id", "politician_id", "ticker", "trade_date"]


def add_sectors(
    trades: DataFrame, bridge: DataFrame | None = None, ticker_map: DataFrame | None = None, mode: str = "score"
) -> DataFrame:
    """`sectors` array per trade from bridge rows, own column and ticker map (see `resolve_sectors`)."""
    out, extra = trades, []
    if bridge is not None:
        lists = bridge.groupBy("trade_id").agg(F.array_sort(F.collect_set("sector")).alias("_bridge"))
        out, extra = out.join(lists, "trade_id", "left"), ["_bridge"]
    if ticker_map is not None:
        out = enrich(out, ticker_map.select("ticker", F.col("sector").alias("_mapped")), ["ticker"])
        extra.append("_mapped")
    empty = F.lit(None).cast("array<string>")
    sectors = S.resolve_sectors(
        F.col("_bridge") if bridge is not None else empty, "industry_sector",
        F.col("_mapped") if ticker_map is not None else F.lit(None).cast("string"), mode,
    )
    return out.withColumn("sectors", sectors).drop(*extra)


def _once(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back, so that several uses work it out once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bill_events(bills: DataFrame) -> DataFrame:
    """Bill actions as (sector, trade_date) events."""
    return bills.select(
        S.policy_sector("policy_area").alias("sector"), F.col("latest_action_date").alias("trade_date")
    ).where("sector is not null and trade_date is not null")


def vote_events(votes: DataFrame) -> DataFrame:
    """Member votes (politician_id, vote_date[, related_sector]) as events on `trade_date`."""
    return votes.where("vote_date is not null").withColumnRenamed("vote_date", "trade_date")


def weighted_median(days: DataFrame, column: str, weight: str = "n_rows") -> Column:
    """Exact median as a scalar; days are capped, so there are few distinct values."""
    return days.agg(F.percentile(column, 0.5, F.col(weight))).scalar()


def _median_gap(trades: DataFrame, events: DataFrame) -> Column:
    """Exact median of the trades' days to their person's nearest vote, as a scalar; only persons and days move."""
    keyed = trades.select("politician_id", "trade_date")
    gaps = entity_facts(keyed, events, "politician_id", "trade_date", V.VOTE_CAP_DAYS)
    return weighted_median(gaps.groupBy("gap_days").agg(F.count("*").alias("n_rows")), "gap_days")


def cohort_features(
    trades: DataFrame, prices: DataFrame, votes: DataFrame, bills: DataFrame, seats: DataFrame,
    bridge: DataFrame | None = None, ticker_map: DataFrame | None = None,
    median_proximity: Column | int | None = None, median_bill: Column | int | None = None, tasks: int | None = None,
) -> DataFrame:
    """The nine version-2 features of every trade (cohort_alpha stays NULL without prices).

    The trades move twice, to their person and to their ticker, where votes, closes and other trades meet them.
    Medians default to those of this batch. `tasks`: see `gathered`.
    """
    base = add_sectors(trades, bridge, ticker_map)
    events = bill_events(bills)

    combos = base.groupBy("sectors", "trade_date").agg(F.count("*").alias("n_rows"))
    sector_gaps = category_gaps(combos, events, "sectors", "sector", "trade_date")
    if median_proximity is None:
        median_proximity = _median_gap(trades, vote_events(votes))
    if median_bill is None:
        median_bill = weighted_median(apply_category_gaps(combos, sector_gaps, "sectors", "trade_date", "bill_gap"), "bill_gap")
    median_proximity, median_bill = (m if isinstance(m, Column) else F.lit(m) for m in (median_proximity, median_bill))

    # The person's answers come first: sectors and amounts don't move on to the tickers.
    narrow = base.select(*ID_COLUMNS, "sectors", "amount_midpoint", "disclosure_lag_days")
    narrow = apply_category_gaps(narrow, sector_gaps, "sectors", "trade_date", "bill_gap")
    people = amount_stats(trades).drop("n_trades").join(access_maps(access_matrix(seats)), "politician_id", "full")
    personal = entity_facts(
        narrow, vote_events(votes), "politician_id", "trade_date", V.VOTE_CAP_DAYS, facts=people, source=trades, dealt_by=["trade_id"],
        tasks=tasks,
    ).select(
        *ID_COLUMNS, "gap_days", "bill_gap", "disclosure_lag_days",
        relevance(F.col("access"), F.col("sectors")).alias("committee_relevance"),
        N.amount_zscore("amount_midpoint", "log_amt_mean", "log_amt_std").alias("amount_zscore"),
    )
    joined = ticker_facts(personal, prices, "politician_id", source=trades, dealt_by=["trade_id"], tasks=tasks)
    named = F.col("politician_id").isNotNull()
    return joined.select(
        *ID_COLUMNS,
        "cohort_alpha",
        F.coalesce("pre_trade_alpha", F.lit(0.0)).alias("pre_trade_alpha"),
        N.impute_days("gap_days", median_proximity, V.PROXIMITY_FALLBACK).alias("proximity_days"),
        N.impute_days("bill_gap", median_bill, V.BILL_FALLBACK).alias("bill_proximity"),
        F.col("gap_days").isNotNull().cast("int").alias("has_proximity_data"),
        "committee_relevance", "amount_zscore",
        F.when(named, F.coalesce(F.col("peers") - 1, F.lit(0))).otherwise(0).cast("int").alias("cluster_score"),
        N.log_lag("disclosure_lag_days").alias("disclosure_lag"),
    )


def proximity_features(trades: DataFrame, votes: DataFrame, median: Column | int | None = None) -> DataFrame:
    """trade_id, proximity_days, has_proximity_data alone: one pass over distinct (person, day) pairs, one join back."""
    near = nearest_lookup(trades, vote_events(votes), "politician_id", "trade_date", V.VOTE_CAP_DAYS)
    median = weighted_median(near, "gap_days") if median is None else median
    keyed = trades.select("trade_id", "politician_id", "trade_date")
    joined = spread_join(keyed, near, ["politician_id", "trade_date"], source=trades)
    return joined.select(
        "trade_id", N.impute_days("gap_days", median if isinstance(median, Column) else F.lit(median), V.PROXIMITY_FALLBACK).alias("proximity_days"),
        F.col("gap_days").isNotNull().cast("int").alias("has_proximity_data"),
    )


def bill_proximity(trades: DataFrame, bills: DataFrame, median: Column | int | None = None) -> DataFrame:
    """trade_id, bill_proximity alone: the gaps depend on sectors and day, of which there are few."""
    base = add_sectors(trades, None, None).select("trade_id", "sectors", "trade_date")
    combos = base.groupBy("sectors", "trade_date").agg(F.count("*").alias("n_rows"))
    gaps = category_gaps(combos, bill_events(bills), "sectors", "sector", "trade_date")
    median = weighted_median(apply_category_gaps(combos, gaps, "sectors", "trade_date", "bill_gap"), "bill_gap") if median is None else median
    joined = apply_category_gaps(base, gaps, "sectors", "trade_date", "bill_gap")
    return joined.select("trade_id", N.impute_days("bill_gap", median if isinstance(median, Column) else F.lit(median), V.BILL_FALLBACK).alias("bill_proximity"))


def behaviour_features(trades: DataFrame, tasks: int | None = None) -> DataFrame:
    """trade_id, amount_zscore, cluster_score, disclosure_lag alone. `tasks`: see `peer_lookup`."""
    base = trades.select("trade_id", "politician_id", "ticker", "trade_date", "amount_midpoint", "disclosure_lag_days")
    own = enrich(base, amount_stats(trades).select("politician_id", "log_amt_mean", "log_amt_std"), ["politician_id"])
    peers = peer_lookup(trades, "ticker", "politician_id", "trade_date", tasks=tasks).select("ticker", "trade_date", "peers", "n_rows")
    joined = spread_join(own, peers, ["ticker", "trade_date"], source=trades)
    named = F.col("politician_id").isNotNull()
    return joined.select(
        "trade_id", N.amount_zscore("amount_midpoint", "log_amt_mean", "log_amt_std").alias("amount_zscore"),
        F.when(named, F.coalesce(F.col("peers") - 1, F.lit(0))).otherwise(0).cast("int").alias("cluster_score"),
        N.log_lag("disclosure_lag_days").alias("disclosure_lag"),
    )


def cohort_features_v1(
    trades: DataFrame, prices: DataFrame, votes: DataFrame, seats: DataFrame,
    bridge: DataFrame | None = None, ticker_map: DataFrame | None = None,
    exact_committees: bool = True, rank_column: str = "rank_in_committee", tasks: int | None = None,
) -> DataFrame:
    """The five version-1 features; the median is taken after rows without prices are dropped.

    With exact committee names and votes tagged by sector this is the training variant; without,
    the scoring variant of version 1. `tasks`: see `gathered`.
    """
    tagged = add_sectors(trades, bridge, ticker_map)
    events, keys = vote_events(votes), ("politician_id", "trade_date")
    own = tagged.select(*ID_COLUMNS, "sectors", "disclosure_lag_days")
    access = access_maps(access_matrix(seats, exact=exact_committees, rank_column=rank_column))
    matched = None
    if "related_sector" in events.columns:
        matched = category_gaps_by_key(tagged, events.withColumnRenamed("related_sector", "sector"), "politician_id", "sectors", "sector", "trade_date", V.VOTE_CAP_DAYS)
    near = entity_facts(own, events, *keys, V.VOTE_CAP_DAYS, facts=access, matched=matched, source=trades, dealt_by=["trade_id"], tasks=tasks)
    if matched is not None:
        near = near.withColumn("gap_days", F.coalesce(smallest_gap(F.col("sectors"), F.col("_gaps")), F.col("gap_days")))
    near = near.select(*ID_COLUMNS, "gap_days", "disclosure_lag_days", relevance(F.col("access"), F.col("sectors")).alias("committee_relevance"))
    joined = scoreable(ticker_facts(near, prices, source=trades, dealt_by=["trade_id"], tasks=tasks))
    joined = _once(joined.drop("pre_trade_alpha"), "cohort-v1")
    median = joined.groupBy("gap_days").agg(F.count("*").alias("n_rows")).agg(
        F.percentile("gap_days", 0.5, F.col("n_rows"))
    ).scalar()
    return joined.select(
        *ID_COLUMNS, "cohort_alpha",
        N.impute_days("gap_days", median, V.PROXIMITY_FALLBACK).alias("proximity_days"),
        F.col("gap_days").isNotNull().cast("int").alias("has_proximity_data"),
        "committee_relevance",
        N.clipped_lag("disclosure_lag_days").alias("disclosure_lag"),
    )


def baseline_features(
    inferred: DataFrame, prices: DataFrame, version: int = 2,
    median_proximity: int = V.PROXIMITY_FALLBACK, median_bill: int = V.BILL_FALLBACK,
) -> DataFrame:
    """Institutional trades: real alphas, constant political features, rows without prices dropped."""
    dated = _once(inferred, "inferred").withColumnRenamed("inferred_date", "trade_date")
    # Closes of other tickers than these and the benchmark aren't asked for.
    tickers = dated.select("ticker").union(dated.sparkSession.createDataFrame([(V.BENCHMARK_TICKER,)], "ticker string"))
    kept = scoreable(add_alphas(dated, only_keys(prices, tickers))).withColumnRenamed("trade_date", "inferred_date")
    ids = [c for c in ("cik", "fund_name", "ticker", "inferred_date", "trade_type") if c in kept.columns]
    constants = {
        "cohort_alpha": F.col("cohort_alpha"),
        "pre_trade_alpha": F.coalesce("pre_trade_alpha", F.lit(0.0)),
        "proximity_days": F.lit(median_proximity), "bill_proximity": F.lit(median_bill),
        "has_proximity_data": F.lit(0), "committee_relevance": F.lit(0.0), "amount_zscore": F.lit(0.0),
        "cluster_score": F.lit(0), "disclosure_lag": F.lit(0.0),
    }
    features = V.FEATURES_V2 if version == 2 else V.FEATURES_V1
    return kept.select(*ids, *[constants[f].alias(f) for f in features])
