"""Data-quality operators: NULL profiles, coverage, gates, orphans, duplicates, report audits."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import text as X
from ledgerlight.operators.merge import union_aligned

# Default gates (table, column, most NULLs allowed, fewest rows).
DEFAULT_GATES = [
    ("bills", "policy_area", 0.50, 100), ("bills", "latest_action_date", 0.30, 100), ("bills", "url", 0.50, 100),
    ("trades", "ticker", 0.05, 50), ("trades", "trade_date", 0.02, 50),
]
MAX_HEADLINE = 120


def filled(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def share_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), digits)


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def orphan_report(relations: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """One row per relation with its number of orphans (keys counted before they are joined)."""
    rows = []
    for name, child, child_key, parent, parent_key in relations:
        counts = child.where(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count("*").alias("n"))
        left = orphans(counts, child_key, parent, parent_key)
        rows.append(left.agg(F.lit(name).alias("relation"), F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")))
    return union_aligned(rows)


def uncovered(df: DataFrame, key: str, covered: DataFrame) -> DataFrame:
    """Rows whose key is known but not among `covered` (NULLs in `covered` are ignored)."""
    return df.where(F.col(key).isNotNull()).join(covered.select(key).dropna().distinct(), key, "left_anti")


def uncovered_counts(df: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: for each table the number of rows of `df` whose key it does not cover."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    for name, table in tables.items():
        present = table.select(key).dropna().distinct().withColumn(f"_{name}", F.lit(True))
        counts = counts.join(present, key, "left")
    return counts.agg(*[
        F.coalesce(F.sum(F.when(F.col(f"_{name}").isNull(), F.col("_n"))), F.lit(0)).alias(name) for name in tables
    ])


def null_profile(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """NULL count and share per column, from one aggregation pass."""
    columns = columns or df.columns
    counted = df.agg(F.count("*").alias("_total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns]))
    return counted.select("_total", pairs.alias("p")).select(
        F.lit(table).alias("table"), "p.column", "p.nulls", F.col("_total").alias("total"),
        share_pct(F.col("p.nulls"), F.col("_total")).alias("null_pct"),
    )


def population(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: total and the number of non-NULL, non-empty values per column."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(filled(c)).alias(f"has_{c}") for c in columns])


def coverage(df: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: distinct keys of `df`, how many it covers, and the rows of `df` left out."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    rows = []
    for name, table in tables.items():
        present = table.select(key).dropna().distinct().withColumn("_there", F.lit(True))
        rows.append(counts.join(present, key, "left").agg(
            F.lit(name).alias("source"), F.count("*").alias("keys"), F.count("_there").alias("covered"),
            F.coalesce(F.sum(F.when(F.col("_there").isNull(), F.col("_n"))), F.lit(0)).alias("rows_uncovered"),
        ))
    return union_aligned(rows)


def gate_counts(rules: list[tuple[str, float, int]]) -> dict[str, Column]:
    """The aggregates that `gate_verdicts` reads."""
    return {"_total": F.count(F.lit(1))} | {c: F.count_if(F.col(c).isNull()) for c, _, _ in rules}


def gate_verdicts(counted: DataFrame, table: str, rules: list[tuple[str, float, int]], strict: bool = False) -> DataFrame:
    """Verdict per rule from one row of `gate_counts`."""
    bad = F.lit("fail" if strict else "warn")
    entries = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col("_total").alias("total"), F.col(c).alias("nulls"),
            F.round(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("_total")), F.lit(0.0)), 4).alias("null_share"),
            F.when(F.col("_total") < fewest, bad).otherwise("ok").alias("rows_verdict"),
            F.when(F.try_divide(F.col(c).cast("double"), F.col("_total")) > most, bad).otherwise("ok").alias("nulls_verdict"),
        ) for c, most, fewest in rules
    ]))
    return counted.select(entries.alias("e")).select(F.lit(table).alias("table"), "e.*")


def quality_gate(df: DataFrame, table: str, rules: list[tuple[str, float, int]], strict: bool = False) -> DataFrame:
    """Verdict per rule (column, most NULLs allowed, fewest rows): ok, warn, or fail when strict."""
    return gate_verdicts(df.agg(*[column.alias(name) for name, column in gate_counts(rules).items()]), table, rules, strict)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and a final `TOTAL` row."""
    counts = union_aligned([df.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows")) for name, df in tables.items()])
    return counts.unionByName(counts.agg(F.lit("TOTAL").alias("table"), F.sum("n_rows").alias("n_rows")))


# --- evidence reports -------------------------------------------------------------------------

def report_problems(reports: DataFrame) -> DataFrame:
    """Every report with the array of its problems."""
    severe = F.col("severity_quadrant") == "SEVERE"
    evidence = F.coalesce(F.col("evidence_json"), F.lit(""))
    empty = (evidence == "") | (F.regexp_replace(evidence, r"\s", "") == "{}")
    factors = F.coalesce(F.json_array_length(F.get_json_object("evidence_json", "$.key_factors")), F.lit(0))
    driver = F.coalesce(F.get_json_object("evidence_json", "$.score_driver"), F.lit(""))

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    length = F.length("headline")
    problems = F.array_compact(F.array(
        F.when(length > MAX_HEADLINE, F.concat(F.lit("headline too long ("), length, F.lit(" chars)"))),
        F.when(blank("headline"), "missing headline"),
        F.when(blank("narrative"), "missing narrative"),
        F.when(empty, "empty evidence_json").when(factors == 0, "no key_factors in evidence")
        .when(driver == "", "no score_driver in evidence"),
        F.when(blank("disclaimer"), "missing disclaimer"),
        F.when(severe & blank("video_prompt"), "SEVERE but no video_prompt"),
        F.when(severe & blank("narration_script"), "SEVERE but no narration_script"),
    ))
    return reports.withColumn("problems", problems)


def report_summary(reports: DataFrame) -> DataFrame:
    """One row of report counts, gaps and token statistics."""
    severe = F.col("severity_quadrant") == "SEVERE"
    cited = X.json_items("citation_image_prompts") > 0

    def blank(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "")

    return reports.agg(
        F.count("*").alias("total"), F.count_if(severe).alias("severe"),
        F.count_if(F.col("severity_quadrant") == "SYSTEMIC").alias("systemic"),
        F.count_if(F.length("headline") > MAX_HEADLINE).alias("long_headlines"),
        F.count_if(blank("narrative")).alias("missing_narrative"),
        F.count_if(F.col("evidence_json").isNull()).alias("missing_evidence"),
        F.count_if(blank("disclaimer")).alias("missing_disclaimer"),
        F.count_if(severe & F.col("video_prompt").isNull()).alias("severe_no_video"),
        F.count_if(severe & F.col("narration_script").isNull()).alias("severe_no_narration"),
        F.count_if(cited).alias("with_bills"), F.count_if(~cited).alias("without_bills"),
    )


def token_stats(reports: DataFrame, by: Column | None = None) -> DataFrame:
    """Token sums, means and extremes, overall or per group (e.g. model or a JSON path)."""
    grouped = reports.groupBy() if by is None else reports.groupBy(by)
    return grouped.agg(
        F.count("*").alias("n_reports"), F.sum("prompt_tokens").alias("total_prompt"),
        F.sum("output_tokens").alias("total_output"), F.round(F.avg("prompt_tokens"), 4).alias("avg_prompt"),
        F.round(F.avg("output_tokens"), 4).alias("avg_output"), F.min("output_tokens").alias("min_output"),
        F.max("output_tokens").alias("max_output"),
    )


def media_field_gaps(reports: DataFrame) -> DataFrame:
    """Per quadrant: reports with and without the two media texts."""
    has_video, has_script = F.col("video_prompt").isNotNull(), F.col("narration_script").isNotNull()
    return reports.groupBy("severity_quadrant").agg(
        F.count("*").alias("total"), F.count_if(has_video).alias("has_video"), F.count_if(~has_video).alias("no_video"),
        F.count_if(has_script).alias("has_narration"), F.count_if(~has_script).alias("no_narration"),
    )


# --- gap details -----------------------------------------------------------------------------

def untagged_committees(committees: DataFrame) -> DataFrame:
    return committees.where("sector_tag is null").select("name")


def tickers_without_sector(trades: DataFrame, limit: int | None = 20) -> DataFrame:
    counted = trades.where("industry_sector is null").groupBy("ticker").agg(F.count("*").alias("n_trades"))
    ordered = counted.orderBy(F.desc("n_trades"), "ticker")
    return ordered if limit is None else ordered.limit(limit)


def tickers_without_price(trades: DataFrame, prices: DataFrame, limit: int | None = 25) -> DataFrame:
    """Unpriced tickers with trade count and date range; aggregated before the anti join."""
    counted = trades.where("ticker is not null").groupBy("ticker").agg(
        F.count("*").alias("n_trades"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date")
    )
    ordered = counted.join(prices.select("ticker"), "ticker", "left_anti").orderBy(F.desc("n_trades"), "ticker")
    return ordered if limit is None else ordered.limit(limit)


def bridge_coverage(trades: DataFrame, bridge: DataFrame) -> DataFrame:
    """Trades, trades in the sector bridge, and those covered by the bridge alone."""
    linked = bridge.select("trade_id").distinct().withColumn("_linked", F.lit(True))
    joined = trades.select("trade_id", "industry_sector").join(linked, "trade_id", "left")
    return joined.agg(
        F.count("*").alias("trades"), F.count("_linked").alias("in_bridge"),
        F.count_if(F.col("_linked") & F.col("industry_sector").isNull()).alias("bridge_only"),
    )

