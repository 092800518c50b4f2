"""Numeric feature and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlight.functions import vocab as V
from ledgerlight.functions.text import ColumnLike, as_col, lookup


def null_greatest(a: ColumnLike, b: ColumnLike) -> Column:
    """Greatest of two values, NULL when either is NULL."""
    x, y = as_col(a), as_col(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y))


def excess_return(p0: ColumnLike, p1: ColumnLike, s0: ColumnLike, s1: ColumnLike) -> Column:
    """Return of the asset minus return of the benchmark; NULL without all four prices or on a zero base."""
    p0, p1, s0, s1 = (as_col(c).cast("double") for c in (p0, p1, s0, s1))
    return F.when((p0 != 0) & (s0 != 0), F.try_divide(p1 - p0, p0) - F.try_divide(s1 - s0, s0))


def clipped_lag(days: ColumnLike) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(365), F.coalesce(as_col(days), F.lit(0)))).cast("int")


def log_lag(days: ColumnLike) -> Column:
    return F.log1p(clipped_lag(days).cast("double"))


def log_amount(amount: ColumnLike) -> Column:
    return F.log(as_col(amount).cast("double") + 1)


def amount_zscore(amount: ColumnLike, mean: ColumnLike, std: ColumnLike) -> Column:
    """Personal z-score of the log amount; 0 without statistics or spread."""
    filled = F.coalesce(as_col(amount).cast("double"), F.lit(float(V.DEFAULT_AMOUNT)))
    return F.when(as_col(std) > 0, (log_amount(filled) - as_col(mean)) / as_col(std)).otherwise(F.lit(0.0))


def impute_days(days: ColumnLike, median: ColumnLike, fallback: int) -> Column:
    """Days with the whole-number part of the median put in for NULL."""
    return F.coalesce(as_col(days), F.floor(as_col(median)), F.lit(fallback)).cast("int")


def index_from_raw(raw: ColumnLike) -> Column:
    """Decision value (negative = unusual) -> index 0..100."""
    clipped = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), as_col(raw)))
    return F.floor((-clipped + 0.5) * 100).cast("int")


def quadrant(cohort: ColumnLike, baseline: ColumnLike) -> Column:
    high_c, high_b = as_col(cohort) >= V.HIGH_INDEX, as_col(baseline) >= V.HIGH_INDEX
    return (
        F.when(high_c & high_b, "SEVERE").when(high_b, "SYSTEMIC").when(high_c, "OUTLIER").otherwise("UNREMARKABLE")
    )


def audit_flag(cohort: ColumnLike, baseline: ColumnLike) -> Column:
    return (as_col(cohort) >= V.AUDIT_INDEX) | (as_col(baseline) >= V.AUDIT_INDEX)


def risk_level(quadrant_name: ColumnLike) -> Column:
    return F.coalesce(lookup(V.RISK_LEVELS, F.upper(as_col(quadrant_name))), F.lit("medium"))


def position_change(prior: ColumnLike, current: ColumnLike) -> Column:
    """Direction of a change in shares between two quarters."""
    before, after = as_col(prior), as_col(current)
    return (
        F.when((before == 0) & (after > 0), "new_position")
        .when((after == 0) & (before > 0), "exit_position")
        .when(after > before, "increase")
        .when(after < before, "decrease")
        .otherwise("unchanged")
    )


def bucket(value: ColumnLike, edges: list[tuple[float, str]], last: str, inclusive: bool = False) -> Column:
    """Label of the first edge above `value` (or at least `value` when inclusive)."""
    x = as_col(value)
    out = None
    for edge, label in edges:
        hit = (x <= edge) if inclusive else (x < edge)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(last)
