"""Dual scoring: both forests, quadrant, audit flag; model checks and retrain triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import scores as N
from ledgerlight.plans.features import ID_COLUMNS
from ledgerlight.plans.iforest import Forest, label_from_raw, raw_from_score, with_scores
from ledgerlight.operators.clean import scoreable

RETRAIN_RATE = 0.25
RETRAIN_DAYS = 7


def model_version(cohort_trained: str, baseline_trained: str, version: int = 2) -> str:
    return f"v{version}_cohort_{cohort_trained[:10]}_baseline_{baseline_trained[:10]}"


def dual_score(
    features: DataFrame, cohort: Forest, baseline: Forest, version: str, scored_at: str | None = None
) -> DataFrame:
    """Score every scoreable trade with both models (raw value, label, index) and place it."""
    rows = scoreable(features)
    out = with_scores(rows, {"_c": cohort, "_b": baseline})
    out = out.withColumns({"cohort_raw_score": raw_from_score(F.col("_c")), "baseline_raw_score": raw_from_score(F.col("_b"))})
    out = out.withColumns({
        f"{m}_{name}": make(F.col(f"{m}_raw_score"))
        for m in ("cohort", "baseline") for name, make in (("label", label_from_raw), ("index", N.index_from_raw))
    })
    ids = [c for c in ID_COLUMNS if c in rows.columns]
    stamp = F.lit(scored_at).cast("timestamp_ntz")
    return out.select(
        *ids,
        "cohort_raw_score", "cohort_label", "cohort_index", "baseline_raw_score", "baseline_label", "baseline_index",
        N.quadrant("cohort_index", "baseline_index").alias("severity_quadrant"),
        N.audit_flag("cohort_index", "baseline_index").alias("audit_triggered"),
        *[(F.round(f, 4) if f == "disclosure_lag" else F.col(f)).alias(f"feat_{f}") for f in cohort.features],
        F.lit(version).alias("model_version"), stamp.alias("scored_at"),
    )


def model_checks(scores: DataFrame) -> DataFrame:
    """One row: outlier rate within 1..20 %, mean gap below 20, both-high rate, correlation below 0.80."""
    both = (F.col("cohort_index") >= 55) & (F.col("baseline_index") >= 55)
    out = scores.agg(
        F.round(F.count_if(F.col("cohort_label") == -1) / F.count("*"), 4).alias("outlier_rate"),
        F.round(F.abs(F.avg("cohort_index") - F.avg("baseline_index")), 4).alias("mean_gap"),
        F.round(F.count_if(both) / F.count("*"), 4).alias("both_high_rate"),
        F.round(F.corr("cohort_index", "baseline_index"), 4).alias("correlation"),
    )
    return out.withColumns({
        "outlier_rate_ok": F.col("outlier_rate").between(0.01, 0.20), "mean_gap_ok": F.col("mean_gap") < 20,
        "both_high_ok": F.col("both_high_rate") >= 0.003, "correlation_ok": F.coalesce(F.col("correlation") < 0.80, F.lit(True)),
    })


def probe(forest: Forest, df: DataFrame) -> DataFrame:
    """Index of single probe rows."""
    return df.withColumn("index", N.index_from_raw(raw_from_score(forest.score_column())))


def retrain_triggers(scores: DataFrame, day: str = "trade_date", outlier: Column | None = None) -> DataFrame:
    """Days that end a run of seven scored days in a row with an outlier rate above 25 %.

    The window runs over one row per day.
    """
    outlier = F.col("cohort_label") == -1 if outlier is None else outlier
    daily = scores.groupBy(day).agg((F.count_if(outlier) / F.count("*")).alias("rate"))
    last = Window.orderBy(day).rowsBetween(-(RETRAIN_DAYS - 1), 0)
    return daily.withColumns({"lowest": F.min("rate").over(last), "days": F.count("*").over(last)}).where(
        (F.col("days") == RETRAIN_DAYS) & (F.col("lowest") > RETRAIN_RATE)
    ).select(day, F.round("lowest", 4).alias("lowest_rate"))


def correlation_trigger(scores: DataFrame) -> DataFrame:
    """Retrain when the two models' indices correlate negatively."""
    return scores.agg(F.round(F.corr("cohort_index", "baseline_index"), 4).alias("correlation")).withColumn(
        "retrain", F.coalesce(F.col("correlation") < 0, F.lit(False))
    )
