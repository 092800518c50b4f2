"""Counts taken by the job that writes, without another pass over its input.

The counts are observed directly below the write, in its last stage: a task that is run again is
counted once. `write` has to run one job over the rows it is given (`VersionedTable.replace`, `append`,
or any `df.write` call); columns named in metrics have to be there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlight.operators.quality import gate_counts, gate_verdicts

Write = Callable[[DataFrame], object]


class GateFailed(ValueError):
    """A strict gate was missed; `verdicts` holds its rows."""

    def __init__(self, table: str, verdicts: DataFrame):
        super().__init__(f"{table} misses its quality gate")
        self.verdicts = verdicts


def write_observed(df: DataFrame, metrics: dict[str, Column], write: Write, keep: Column | None = None) -> dict:
    """Write `df`, or its rows for which `keep` is true; `metrics` over all rows of `df`."""
    seen = Observation()
    observed = df.observe(seen, *[column.alias(name) for name, column in metrics.items()])
    write(observed if keep is None else observed.where(keep))
    return dict(seen.get)


def write_resolved(df: DataFrame, columns: list[str], write: Write) -> dict[str, int]:
    """Write the rows whose keys are all resolved; numbers of rows kept and dropped, and of NULLs per key."""
    resolved = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])
    counts = {"kept": F.count_if(resolved), "dropped": F.count_if(~resolved)}
    return write_observed(df, counts | {f"null_{c}": F.count_if(F.col(f"`{c}`").isNull()) for c in columns}, write, resolved)


def write_backfilled(filled: DataFrame, write: Write) -> dict[str, int]:
    """Write the rows of `merge.backfill` without their mark; numbers of rows and of enriched ones."""
    counts = {"total": F.count(F.lit(1)), "enriched": F.count_if("was_filled")}
    return write_observed(filled, counts, lambda rows: write(rows.drop("was_filled")))


def write_gated(df: DataFrame, table: str, rules: list[tuple[str, float, int]], write: Write, strict: bool = False) -> DataFrame:
    """Write `df`; the verdicts of `quality.quality_gate` from that job's counts.

    A missed gate raises GateFailed if `strict`, after the rows are written: give a `write` to a
    staging folder there, and publish it when this returns.
    """
    counts = write_observed(df, gate_counts(rules), write)
    row = df.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"`{c}` long" for c in counts))
    verdicts = gate_verdicts(row, table, rules, strict)
    if strict and not verdicts.where("rows_verdict = 'fail' or nulls_verdict = 'fail'").isEmpty():
        raise GateFailed(table, verdicts)
    return verdicts
