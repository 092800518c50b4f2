"""Aggregates over scored trades.

`scored` is a DataFrame of trades with their scores. People are joined after aggregation, so a
very active person never makes a join task heavy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import scores as N
from ledgerlight.functions import vocab as V
from ledgerlight.operators.lookup import enrich
from ledgerlight.operators.quality import share_pct

# Reporting buckets.
ABS_ALPHA_EDGES = [(0.05, "<5%"), (0.10, "5-10%"), (0.20, "10-20%"), (0.50, "20-50%")]
ALPHA_EDGES = [
    (-0.10, "large_loss (<-10%)"), (-0.03, "moderate_loss (-10% to -3%)"), (0.03, "normal (-3% to +3%)"),
    (0.10, "moderate_gain (+3% to +10%)"),
]
LAG_EDGES = [(7, "0-7d"), (30, "8-30d"), (60, "31-60d"), (90, "61-90d")]
AMOUNT_EDGES = [(15000, "A_lt15K"), (50000, "B_15K-50K"), (250000, "C_50K-250K"), (1000000, "D_250K-1M")]
V1_FEATURE_COLUMNS = [f"feat_{f}" for f in V.FEATURES_V1]

def _quadrant() -> Column:
    return F.col("severity_quadrant")


def is_flagged() -> Column:
    return F.coalesce(_quadrant().isin(V.FLAGGED), F.lit(False))


def is_anomalous() -> Column:
    return F.coalesce(_quadrant() != "UNREMARKABLE", F.lit(False))


def count_quadrant(name: str) -> Column:
    return F.count_if(F.coalesce(_quadrant() == name, F.lit(False)))


def mean(column: str, digits: int) -> Column:
    return F.round(F.avg(column), digits)


def rate(condition: Column, digits: int = 1) -> Column:
    return F.round(F.count_if(condition) * 100.0 / F.count(F.lit(1)), digits)


def listed_order(column: str, values: list[str]) -> Column:
    """Position of a value in a fixed list, for custom sort orders."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))


def _people(politicians: DataFrame, *columns: str) -> DataFrame:
    return politicians.select(F.col("id").alias("politician_id"), *columns)


def systemic_stats(scores: DataFrame) -> DataFrame:
    """One row: totals, count and share of every quadrant and of audits, mean indices."""
    base = scores.agg(
        F.count("*").alias("total_scored"),
        *[count_quadrant(q).alias(f"{q.lower()}_count") for q in V.QUADRANTS],
        F.count_if(F.col("audit_triggered")).alias("audit_triggered_count"),
        F.coalesce(mean("cohort_index", 2), F.lit(0.0)).alias("avg_cohort_index"),
        F.coalesce(mean("baseline_index", 2), F.lit(0.0)).alias("avg_baseline_index"),
    )
    names = [q.lower() for q in V.QUADRANTS] + ["audit_triggered"]
    return base.withColumns({
        f"{n}_pct": F.coalesce(share_pct(F.col(f"{n}_count"), F.col("total_scored"), 2), F.lit(0.0)) for n in names
    })


def profile_aggregates(politicians: DataFrame, scored: DataFrame) -> DataFrame:
    """Profile of every person with trade counts per quadrant and mean indices; zero for no trades."""
    counts = ["total_trades", *[f"{q.lower()}_count" for q in V.QUADRANTS]]
    per_person = scored.groupBy("politician_id").agg(
        F.count("*").alias("total_trades"), *[count_quadrant(q).alias(f"{q.lower()}_count") for q in V.QUADRANTS],
        mean("cohort_index", 2).alias("avg_cohort"), mean("baseline_index", 2).alias("avg_baseline"),
    )
    joined = politicians.join(per_person.withColumnRenamed("politician_id", "id"), "id", "left")
    return joined.fillna(0, counts).fillna(0.0, ["avg_cohort", "avg_baseline"])


def quadrant_health(scores: DataFrame) -> DataFrame:
    """Count, share of the total, means and audits per quadrant, most severe first."""
    grouped = scores.groupBy("severity_quadrant").agg(
        F.count("*").alias("trade_count"), mean("cohort_index", 1).alias("avg_cohort"),
        mean("baseline_index", 1).alias("avg_baseline"), F.count_if(F.col("audit_triggered")).alias("audits_triggered"),
    )
    # The window runs over the four aggregated rows only.
    total = F.sum("trade_count").over(Window.partitionBy())
    return grouped.withColumn("pct", share_pct(F.col("trade_count"), total)).orderBy(
        listed_order("severity_quadrant", V.QUADRANTS)
    )


def amount_stats(trades: DataFrame, at_least: int = V.MIN_AMOUNT_TRADES) -> DataFrame:
    """Mean and population deviation of the log amount per person with enough trades."""
    logs = trades.where("politician_id is not null and amount_midpoint is not null").select(
        "politician_id", N.log_amount("amount_midpoint").alias("x")
    )
    return logs.groupBy("politician_id").agg(
        F.avg("x").alias("log_amt_mean"), F.stddev_pop("x").alias("log_amt_std"), F.count("*").alias("n_trades")
    ).where(F.col("n_trades") >= at_least)


def most_flagged_people(scored: DataFrame, politicians: DataFrame, limit: int = 20) -> DataFrame:
    grouped = scored.where(is_flagged()).groupBy("politician_id").agg(
        F.count("*").alias("flagged"), count_quadrant("SEVERE").alias("severe"),
        count_quadrant("SYSTEMIC").alias("systemic"), mean("cohort_index", 1).alias("avg_cohort"),
        mean("baseline_index", 1).alias("avg_baseline"), F.count_distinct("ticker").alias("unique_tickers"),
    )
    named = grouped.join(_people(politicians, "full_name", "party", "chamber", "state"), "politician_id")
    return named.orderBy(F.desc("flagged"), "politician_id").limit(limit)


def most_flagged_tickers(scored: DataFrame, limit: int = 20) -> DataFrame:
    return scored.where(is_flagged()).groupBy("ticker", "industry_sector").agg(
        F.count("*").alias("flagged"), count_quadrant("SEVERE").alias("severe"),
        count_quadrant("SYSTEMIC").alias("systemic"), F.count_if(F.col("trade_type") == "buy").alias("buys"),
        F.count_if(F.col("trade_type") == "sell").alias("sells"),
        F.count_distinct("politician_id").alias("unique_politicians"), mean("feat_cohort_alpha", 3).alias("avg_alpha"),
    ).orderBy(F.desc("flagged"), "ticker", "industry_sector").limit(limit)


def flagged_by_month(scored: DataFrame, limit: int = 24) -> DataFrame:
    return scored.where(is_flagged()).groupBy(F.date_format("trade_date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("flagged"), count_quadrant("SEVERE").alias("severe"),
        count_quadrant("SYSTEMIC").alias("systemic"),
    ).orderBy(F.desc("month")).limit(limit)


def top_anomalous_people(scored: DataFrame, politicians: DataFrame, limit: int = 50) -> DataFrame:
    grouped = scored.where(is_anomalous()).groupBy("politician_id").agg(
        F.count("*").alias("anomalous"), *[count_quadrant(q).alias(q.lower()) for q in V.QUADRANTS[:3]],
        mean("cohort_index", 1).alias("avg_cohort"), mean("baseline_index", 1).alias("avg_baseline"),
        F.max("cohort_index").alias("max_cohort"),
    )
    named = grouped.join(_people(politicians, "full_name", "party", "chamber", "state"), "politician_id")
    return named.orderBy(F.desc("anomalous"), "politician_id").limit(limit)


def flag_rates(scored: DataFrame, politicians: DataFrame, at_least: int = 10, limit: int = 25) -> DataFrame:
    """Flag rate of people with enough trades; volume alone should not drive it."""
    grouped = scored.groupBy("politician_id").agg(
        F.count_distinct("trade_id").alias("total_trades"), F.count_if(is_flagged()).alias("flagged"),
        mean("baseline_index", 1).alias("avg_baseline"),
    ).where(F.col("total_trades") >= at_least)
    named = grouped.join(_people(politicians, "full_name", "party", "chamber"), "politician_id")
    return named.withColumn("flag_rate_pct", share_pct(F.col("flagged"), F.col("total_trades"))).orderBy(
        F.desc("flag_rate_pct"), "politician_id"
    ).limit(limit)


def flagged_sectors(scored: DataFrame) -> DataFrame:
    return scored.where(is_flagged()).groupBy(F.coalesce("industry_sector", F.lit("UNMAPPED")).alias("sector")).agg(
        F.count("*").alias("flagged"), count_quadrant("SEVERE").alias("severe"),
        count_quadrant("SYSTEMIC").alias("systemic"), mean("feat_cohort_alpha", 3).alias("avg_alpha"),
        F.count_distinct("politician_id").alias("unique_politicians"),
    ).orderBy(F.desc("flagged"), "sector")


def _by_party(scored: DataFrame, politicians: DataFrame) -> DataFrame:
    """Additive per-person sums joined to the party, to be summed once more."""
    sums = scored.groupBy("politician_id").agg(
        F.count("*").alias("n"), F.count_if(is_flagged()).alias("flagged"), F.count_if(is_anomalous()).alias("anomalous"),
        *[count_quadrant(q).alias(q.lower()) for q in V.QUADRANTS[:3]],
        F.sum("cohort_index").alias("c_sum"), F.count("cohort_index").alias("c_n"),
        F.sum("baseline_index").alias("b_sum"), F.count("baseline_index").alias("b_n"),
    )
    return sums.join(_people(politicians, "party"), "politician_id").groupBy("party")


def party_flags(scored: DataFrame, politicians: DataFrame) -> DataFrame:
    return _by_party(scored, politicians).agg(
        F.sum("n").alias("total_trades"), F.sum("flagged").alias("flagged"),
        F.round(F.sum("flagged") * 100.0 / F.sum("n"), 2).alias("flag_rate_pct"),
        F.sum("severe").alias("severe"), F.sum("systemic").alias("systemic"),
        F.round(F.sum("c_sum") / F.sum("c_n"), 1).alias("avg_cohort"),
        F.round(F.sum("b_sum") / F.sum("b_n"), 1).alias("avg_baseline"),
    )


def party_bias(scored: DataFrame, politicians: DataFrame) -> DataFrame:
    return _by_party(scored, politicians).agg(
        F.sum("n").alias("total"), F.sum("anomalous").alias("anomalous"),
        F.round(F.sum("anomalous") * 100.0 / F.sum("n"), 1).alias("rate"),
        F.sum("severe").alias("severe"), F.sum("systemic").alias("systemic"), F.sum("outlier").alias("outlier"),
    )


def iso_week(date: str) -> Column:
    """ISO year and week as one number, e.g. 202501."""
    return (F.extract(F.lit("YEAROFWEEK"), F.col(date)) * 100 + F.weekofyear(date)).cast("int")


def weekly_clusters(scored: DataFrame, politicians: DataFrame, at_least: int = 2, limit: int = 20) -> DataFrame:
    """Flagged trades of one ticker by several people in one ISO week.

    Groups are ranked first; names are listed for the top groups only.
    """
    keys = ["ticker", "trade_week"]
    flagged = scored.where(is_flagged() & F.col("politician_id").isNotNull()).withColumn("trade_week", iso_week("trade_date"))
    top = flagged.groupBy(*keys).agg(
        F.min("trade_date").alias("week_start"), F.max("trade_date").alias("week_end"),
        F.count_distinct("politician_id").alias("unique_politicians"), F.count("*").alias("total_trades"),
        mean("baseline_index", 1).alias("avg_baseline"), mean("feat_cohort_alpha", 3).alias("avg_alpha"),
    ).where(F.col("unique_politicians") >= at_least).orderBy(
        F.desc("unique_politicians"), F.desc("avg_baseline"), *keys
    ).limit(limit)
    members = flagged.join(F.broadcast(top.select(*keys)), keys, "left_semi").select(*keys, "politician_id").distinct()
    names = members.join(_people(politicians, "full_name"), "politician_id").groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("full_name")), ", ").alias("who")
    )
    return top.join(names, keys)


def alpha_by_population(scores: DataFrame) -> DataFrame:
    """n, mean and population deviation of alpha over all scores and per quadrant, in one pass."""
    population = F.explode(F.array(F.lit("ALL"), _quadrant())).alias("population")
    return scores.select(population, "feat_cohort_alpha").where(
        F.col("population").isin("ALL", "SYSTEMIC", "SEVERE", "UNREMARKABLE")
    ).groupBy("population").agg(
        F.count("*").alias("n"), mean("feat_cohort_alpha", 4).alias("mean_alpha"),
        F.round(F.stddev_pop("feat_cohort_alpha"), 4).alias("std_alpha"),
    )


def calibration(scores: DataFrame, alpha: str = "feat_cohort_alpha") -> DataFrame:
    """Scores and flags by size of the absolute excess return."""
    label = N.bucket(F.abs(alpha), ABS_ALPHA_EDGES, ">50%").alias("abs_alpha_bucket")
    order = [edge[1] for edge in ABS_ALPHA_EDGES] + [">50%"]
    return scores.groupBy(label).agg(
        F.count("*").alias("trades"), mean("cohort_index", 1).alias("avg_cohort"),
        mean("baseline_index", 1).alias("avg_baseline"), F.count_if(is_flagged()).alias("flagged"),
    ).orderBy(listed_order("abs_alpha_bucket", order))


def name_matches(politicians: DataFrame, patterns: list[str]) -> DataFrame:
    """(politician_id, full_name, party, pattern) for every pattern contained in a name."""
    hits = F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(F.lower("full_name"), F.lower(p)))
    return politicians.select(
        F.col("id").alias("politician_id"), "full_name", "party", F.explode(hits).alias("pattern")
    )


def watch_list(scored: DataFrame, politicians: DataFrame, patterns: list[str]) -> DataFrame:
    """Totals of the people whose name contains any of the patterns."""
    people = name_matches(politicians, patterns).drop("pattern").distinct()
    grouped = scored.groupBy("politician_id").agg(
        F.count("*").alias("total_trades"), F.count_if(is_flagged()).alias("flagged"),
        mean("baseline_index", 1).alias("avg_baseline"),
        F.round(F.avg(F.abs("feat_cohort_alpha")), 3).alias("avg_abs_alpha"),
    )
    return grouped.join(people, "politician_id").orderBy(F.desc("flagged"), "politician_id")


def volume_bias(scored: DataFrame, at_least: int = 5) -> DataFrame:
    """Correlation of trade volume with anomaly count and with anomaly rate, and the verdict."""
    per_person = scored.where("politician_id is not null").groupBy("politician_id").agg(
        F.count("*").alias("total"), F.count_if(is_anomalous()).alias("anom")
    ).where(F.col("total") >= at_least)
    pair = per_person.agg(
        F.corr("total", "anom").alias("r_count"), F.corr("total", F.col("anom") / F.col("total")).alias("r_rate")
    )
    size = F.abs("r_rate")
    return pair.withColumn("verdict", F.when(size < 0.3, "LOW").when(size < 0.5, "MODERATE").otherwise("HIGH"))


def top_rates(scored: DataFrame, politicians: DataFrame, at_least: int = 10, limit: int = 10) -> DataFrame:
    grouped = scored.groupBy("politician_id").agg(
        F.count("*").alias("total"), F.count_if(is_anomalous()).alias("anom"), rate(is_anomalous()).alias("rate")
    ).where(F.col("total") >= at_least)
    named = grouped.join(_people(politicians, "full_name", "party"), "politician_id")
    return named.orderBy(F.desc("rate"), "politician_id").limit(limit)


def feature_distribution(scores: DataFrame, features: list[str] = V1_FEATURE_COLUMNS) -> DataFrame:
    """Mean, deviation, minimum and maximum of every feature, anomalous against the rest."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f.removeprefix("feat_")).alias("feature"), F.col(f).cast("double").alias("x")) for f in features
    ]))
    return scores.select(is_anomalous().alias("anomalous"), pairs.alias("p")).groupBy("p.feature", "anomalous").agg(
        F.round(F.avg("p.x"), 4).alias("mean"), F.round(F.stddev_pop("p.x"), 4).alias("std"),
        F.round(F.min("p.x"), 4).alias("min"), F.round(F.max("p.x"), 4).alias("max"),
    )


def _anomaly_buckets(df: DataFrame, label: Column, name: str, order_by: str | None, extra: list[Column]) -> DataFrame:
    grouped = df.groupBy(label.alias(name)).agg(
        F.count("*").alias("total"), F.count_if(is_anomalous()).alias("anom"), rate(is_anomalous()).alias("rate"),
        mean("cohort_index", 1).alias("avg_cohort"), *extra,
        *([F.min(order_by).alias("_low")] if order_by else []),
    )
    return grouped.orderBy("_low").drop("_low") if order_by else grouped.orderBy(F.desc("rate"), name)


def sector_rates(scored: DataFrame) -> DataFrame:
    return _anomaly_buckets(
        scored, F.col("industry_sector"), "industry_sector", None, [mean("baseline_index", 1).alias("avg_baseline")]
    )


def lag_buckets(scores: DataFrame) -> DataFrame:
    label = N.bucket("feat_disclosure_lag", LAG_EDGES, "90d+", inclusive=True)
    return _anomaly_buckets(
        scores, label, "lag_bucket", "feat_disclosure_lag", [mean("baseline_index", 1).alias("avg_baseline")]
    )


def alpha_buckets(scores: DataFrame) -> DataFrame:
    label = N.bucket("feat_cohort_alpha", ALPHA_EDGES, "large_gain (>+10%)")
    return _anomaly_buckets(scores, label, "alpha_bucket", "feat_cohort_alpha", [])


def relevance_buckets(scores: DataFrame) -> DataFrame:
    x = F.col("feat_committee_relevance")
    label = F.when(x == 0, "none (0.0)").otherwise(
        N.bucket(x, [(0.5, "low (0.01-0.49)"), (0.8, "medium (0.5-0.79)")], "high (0.8-1.0)")
    )
    return _anomaly_buckets(scores, label, "cr_bucket", "feat_committee_relevance", [])


def scorecards(scored: DataFrame, politicians: DataFrame, patterns: list[str]) -> DataFrame:
    """Scores of named people, one row per matching pattern and person."""
    grouped = scored.groupBy("politician_id").agg(
        F.count("*").alias("total"), F.count_if(is_anomalous()).alias("anom"), rate(is_anomalous()).alias("rate"),
        count_quadrant("SEVERE").alias("severe"), mean("cohort_index", 1).alias("avg_cohort"),
        mean("baseline_index", 1).alias("avg_baseline"), F.max("cohort_index").alias("max_cohort"),
    )
    return grouped.join(name_matches(politicians, patterns), "politician_id")


def index_deciles(scores: DataFrame) -> DataFrame:
    """Histogram of both indices in steps of ten with shares."""
    pairs = F.explode(F.array(
        F.struct(F.lit("cohort").alias("model"), F.col("cohort_index").alias("x")),
        F.struct(F.lit("baseline").alias("model"), F.col("baseline_index").alias("x")),
    ))
    grouped = scores.select(pairs.alias("p")).groupBy(
        "p.model", (F.floor(F.col("p.x") / 10) * 10).cast("int").alias("bucket")
    ).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("model"))
    return grouped.withColumn("pct", share_pct(F.col("n"), total)).orderBy("model", "bucket")


# --- comparison of two scoring runs ----------------------------------------------------------

def transition_cube(compared: DataFrame) -> DataFrame:
    """Counts per (first, second) quadrant with margins; NULL stands for "all"."""
    return compared.cube("severity_quadrant_v1", "severity_quadrant_v2").agg(F.count("*").alias("n"))


def transition_matrix(compared: DataFrame) -> DataFrame:
    """The same as a matrix: rows first run, columns second run, with an `All` row and column."""
    rows = transition_cube(compared).select(
        F.coalesce("severity_quadrant_v1", F.lit("All")).alias("severity_quadrant_v1"),
        F.coalesce("severity_quadrant_v2", F.lit("All")).alias("second"), "n",
    )
    return rows.groupBy("severity_quadrant_v1").pivot("second", [*V.QUADRANTS, "All"]).agg(F.sum("n")).fillna(0)


def run_comparison(first: DataFrame, second: DataFrame) -> DataFrame:
    """Counts, shares and difference per quadrant and for audits."""
    def tally(df: DataFrame, tag: str) -> DataFrame:
        kinds = F.array_compact(F.array(
            _quadrant(), F.when(F.col("audit_triggered"), "Audit triggered"), F.lit("_all")
        ))
        counted = df.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias(f"n_{tag}"))
        total = counted.where("kind = '_all'").select(f"n_{tag}").scalar()
        return counted.where("kind <> '_all'").withColumn(f"pct_{tag}", share_pct(F.col(f"n_{tag}"), total))

    joined = tally(first, "v1").join(tally(second, "v2"), "kind", "full")
    return joined.fillna(0, ["n_v1", "n_v2"]).fillna(0.0, ["pct_v1", "pct_v2"]).withColumn(
        "delta", F.col("n_v2") - F.col("n_v1")
    )


def changed_quadrants(compared: DataFrame) -> DataFrame:
    moved = F.col("severity_quadrant_v1") != F.col("severity_quadrant_v2")
    return compared.agg(
        F.count("*").alias("matched"), F.count_if(moved).alias("changed"), rate(moved).alias("changed_pct")
    )


def newly_severe(compared: DataFrame) -> DataFrame:
    return compared.where((F.col("severity_quadrant_v2") == "SEVERE") & (F.col("severity_quadrant_v1") != "SEVERE"))


def score_summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, median, sample deviation and maximum of both indices (indices have 101 values)."""
    columns = []
    for name in ("cohort", "baseline"):
        c = f"{name}_index"
        columns += [
            mean(c, 1).alias(f"{name}_mean"), F.median(c).alias(f"{name}_median"),
            F.round(F.stddev_samp(c), 1).alias(f"{name}_std"), F.max(c).alias(f"{name}_max"),
        ]
    return scores.groupBy(*(by or [])).agg(*columns)


def lag_dominance(scores: DataFrame) -> DataFrame:
    """Mean lag feature of anomalous against other trades and their ratio."""
    pair = scores.agg(
        F.avg(F.when(is_anomalous(), F.col("feat_disclosure_lag"))).alias("flagged_lag"),
        F.avg(F.when(~is_anomalous(), F.col("feat_disclosure_lag"))).alias("unflagged_lag"),
    )
    return pair.withColumn("ratio", F.when(F.col("unflagged_lag") > 0, F.col("flagged_lag") / F.col("unflagged_lag")))


def named_comparison(compared: DataFrame, politicians: DataFrame, patterns: list[str]) -> DataFrame:
    """Both runs' anomaly counts and mean indices per name pattern (needs politician_id_v2)."""
    sums = compared.groupBy(F.col("politician_id_v2").alias("politician_id")).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(f"severity_quadrant_{v}") != "UNREMARKABLE").alias(f"flagged_{v}") for v in ("v1", "v2")],
        *[F.sum(f"{m}_index_{v}").alias(f"{m}_{v}") for m in ("cohort", "baseline") for v in ("v1", "v2")],
    )
    joined = sums.join(name_matches(politicians, patterns), "politician_id").groupBy("pattern")
    return joined.agg(
        F.sum("n").alias("trades"), F.sum("flagged_v1").alias("flagged_v1"), F.sum("flagged_v2").alias("flagged_v2"),
        *[F.round(F.sum(f"{m}_{v}") / F.sum("n"), 1).alias(f"{m}_avg_{v}") for m in ("cohort", "baseline") for v in ("v1", "v2")],
    )


# --- sector access, bridge, depth -------------------------------------------------------------

def relevance_impact(df: DataFrame) -> DataFrame:
    """Effect of multi-sector tickers: `cr_single` against `cr_multi`."""
    single, multi = F.col("cr_single"), F.col("cr_multi")
    out = df.agg(
        F.count("*").alias("trades"), F.count_if(single > 0).alias("single_nonzero"),
        F.count_if(multi > 0).alias("multi_nonzero"), F.count_if((multi > 0) & (single == 0)).alias("gained"),
        F.count_if((multi > single) & (single > 0)).alias("improved"),
        F.round(F.avg(single), 4).alias("mean_single"), F.round(F.avg(multi), 4).alias("mean_multi"),
        F.round(F.stddev_samp(single), 4).alias("std_single"), F.round(F.stddev_samp(multi), 4).alias("std_multi"),
        F.round((F.try_divide(F.var_samp(multi), F.var_samp(single)) - 1) * 100, 1).alias("variance_gain_pct"),
    )
    return out.withColumn("net", F.col("multi_nonzero") - F.col("single_nonzero"))


def top_gaining_tickers(df: DataFrame, limit: int = 15) -> DataFrame:
    gained = (F.col("cr_multi") > 0) & (F.col("cr_single") == 0)
    return df.where(gained).groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(limit)


def bridge_distribution(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("sector").agg(F.count("*").alias("n"))


def multi_sector_trades(bridge: DataFrame) -> DataFrame:
    """Trades with several sectors and their sorted list (the sector vocabulary bounds it)."""
    grouped = bridge.groupBy("trade_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("sector")).alias("s"))
    return grouped.where("n > 1").select("trade_id", F.array_join("s", ",").alias("sectors"))


def amount_buckets(trades: DataFrame) -> DataFrame:
    label = N.bucket("amount_midpoint", AMOUNT_EDGES, "E_1M+", inclusive=True).alias("bucket")
    return trades.groupBy(label).agg(F.count("*").alias("n")).orderBy("bucket")


def date_range(trades: DataFrame, since: str, until: str) -> DataFrame:
    kept = trades.where(F.col("trade_date").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    return kept.agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def trader_depth(trades: DataFrame, enough: int = 20) -> DataFrame:
    """How many people have enough trades for a personal baseline."""
    return trades.groupBy("politician_id").agg(F.count("*").alias("c")).agg(
        F.count_if(F.col("c") >= enough).alias("enough"), F.count_if(F.col("c") < enough).alias("too_few")
    )


def flagged_quadrant_sector(scored: DataFrame) -> DataFrame:
    return scored.where(is_flagged()).groupBy("severity_quadrant", "industry_sector").agg(F.count("*").alias("n"))


def bills_by_area(bills: DataFrame) -> DataFrame:
    return bills.where("policy_area is not null and policy_area <> ''").groupBy("policy_area").agg(F.count("*").alias("n"))


def tickers_by_sector(mapping: DataFrame) -> DataFrame:
    """The ticker map in listing order (sector, ticker) with the size of each sector.

    Rows instead of one list per sector, so a sector of any size stays distributed.
    """
    sizes = mapping.groupBy("sector").agg(F.count("*").alias("n"))
    return enrich(mapping.select("sector", "ticker"), sizes, ["sector"]).orderBy("sector", "ticker")


def quadrant_counts(scores: DataFrame) -> DataFrame:
    """Count per quadrant and the flagged total as a row `FLAGGED`."""
    kinds = F.array_compact(F.array(_quadrant(), F.when(is_flagged(), "FLAGGED")))
    return scores.select(F.explode(kinds).alias("severity_quadrant")).groupBy("severity_quadrant").agg(F.count("*").alias("n"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum per column (exact)."""
    from ledgerlight.operators.quantiles import exact_percentiles

    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ]))
    long = df.select(pairs.alias("p")).select("p.column", "p.value").where("value is not null")
    basics = long.groupBy("column").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_percentiles(long, "column", "value", [0.25, 0.5, 0.75])
    wide = quartiles.groupBy("column").agg(*[
        F.max(F.when(F.abs(F.col("q") - q) < 1e-9, F.col("value"))).alias(n)
        for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
    ])
    return basics.join(wide, "column", "left")
