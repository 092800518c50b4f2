"""Sorted, limited and paged reads. Every order ends with a key, so pages are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import scores as N
from ledgerlight.functions import sectors as S
from ledgerlight.functions import vocab as V
from ledgerlight.operators.analytics import is_flagged, listed_order
from ledgerlight.operators.clean import optional_filters, search_people, select_person
from ledgerlight.operators.lookup import enrich
from ledgerlight.operators.merge import keep_first

LATE_DAYS = 45
EXTREME_ALPHA = 0.15


def max_index() -> Column:
    return N.null_greatest("cohort_index", "baseline_index")


def _with_people(page: DataFrame, politicians: DataFrame, *columns: str) -> DataFrame:
    """People of a page that is already cut to its limit."""
    person = politicians.select(F.col("id").alias("politician_id"), *columns)
    return page.join(person, "politician_id", "left")


def leaderboard(
    scored: DataFrame, politicians: DataFrame, quadrant: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Highest index first, then newest; the page is cut before people are joined."""
    wanted = optional_filters(scored, quadrants=[quadrant] if quadrant else None).withColumn("max_index", max_index())
    order = [F.desc("max_index"), F.desc("trade_date"), F.col("trade_id")]
    page = wanted.orderBy(*order).offset(offset).limit(limit) if offset else wanted.orderBy(*order).limit(limit)
    page = page.withColumn("sectors", S.parse_sector("industry_sector"))
    return _with_people(page, politicians, "bioguide_id", "full_name", "party", "state").orderBy(*order)


def leaderboard_total(scored: DataFrame, quadrant: str | None = None) -> DataFrame:
    return optional_filters(scored, quadrants=[quadrant] if quadrant else None).agg(F.count("*").alias("total"))


def list_people(politicians: DataFrame, search: str | None = None, limit: int = 25, offset: int = 0) -> DataFrame:
    wanted = search_people(politicians, search) if search else politicians
    ordered = wanted.orderBy("full_name", "id")
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def list_people_total(politicians: DataFrame, search: str | None = None) -> DataFrame:
    return (search_people(politicians, search) if search else politicians).agg(F.count("*").alias("total"))


def recent_trades(scored: DataFrame, politicians: DataFrame, person: str, limit: int = 50) -> DataFrame:
    """Newest trades of one person, chosen by id or natural key."""
    one = select_person(politicians, person).select(F.col("id").alias("politician_id"), "full_name")
    return scored.join(F.broadcast(one.limit(1)), "politician_id").withColumn("max_index", max_index()).orderBy(
        F.desc("trade_date"), "trade_id"
    ).limit(limit)


def top_combined(scores: DataFrame, limit: int = 20) -> DataFrame:
    total = F.col("cohort_index") + F.col("baseline_index")
    return scores.withColumn("combined_score", total).orderBy(F.desc("combined_score"), "trade_id").limit(limit)


def severe_first(scored: DataFrame, limit: int = 10) -> DataFrame:
    """Fixed category order first, then highest index."""
    order = listed_order("severity_quadrant", V.QUADRANTS)
    return scored.orderBy(order, F.desc(max_index()), "trade_id").limit(limit)


def extreme_alpha(scored: DataFrame, politicians: DataFrame, above: float = EXTREME_ALPHA, limit: int = 20) -> DataFrame:
    size = F.abs("feat_cohort_alpha")
    page = scored.where(size > above).withColumn("alpha_pct", F.round(F.col("feat_cohort_alpha") * 100, 1)).orderBy(
        F.desc(size), "trade_id"
    ).limit(limit)
    return _with_people(page, politicians, "full_name", "party")


def late_filers(scored: DataFrame, politicians: DataFrame, days: int = LATE_DAYS, limit: int = 20) -> DataFrame:
    page = scored.where((F.col("disclosure_lag_days") > days) & F.col("politician_id").isNotNull()).orderBy(
        F.desc("disclosure_lag_days"), "trade_id"
    ).limit(limit)
    return _with_people(page, politicians, "full_name", "party", "chamber")


def case_trades(
    scored: DataFrame, politicians: DataFrame, name: str | None = None, ticker: str | None = None,
    since: str | None = None, until: str | None = None, quadrants: list[str] | None = None,
    order: str = "trade_date", limit: int | None = None,
) -> DataFrame:
    """Trades of a case: by name part, ticker, dates and quadrants (each optional)."""
    people = politicians if name is None else politicians.where(F.contains(F.lower("full_name"), F.lit(name.lower())))
    wanted = optional_filters(scored, quadrants=quadrants, since=since, until=until, ticker=ticker)
    person = people.select(F.col("id").alias("politician_id"), "full_name", "party", "chamber")
    known = enrich(wanted, person.withColumn("_known", F.lit(True)), ["politician_id"]).where("_known").drop("_known")
    joined = known.withColumn("alpha_30d", F.round("feat_cohort_alpha", 3))
    by = F.desc("baseline_index") if order == "baseline_index" else F.asc(order)
    ordered = joined.orderBy(by, "trade_id")
    return ordered if limit is None else ordered.limit(limit)


def committee_overlap(
    scored: DataFrame, politicians: DataFrame, seats: DataFrame, above: float = 0.0, inclusive: bool = False,
    sector: str | None = None, limit: int | None = 20,
) -> DataFrame:
    """Flagged trades with committee relevance and the person's committees, most relevant first.

    The committee list is made once per person and joined to the page.
    """
    x = F.col("feat_committee_relevance")
    wanted = scored.where(is_flagged() & ((x >= above) if inclusive else (x > above)))
    if sector:
        wanted = wanted.where(F.col("industry_sector") == sector)
    total = F.col("cohort_index") + F.col("baseline_index")
    page = wanted.withColumn("combined_score", total).orderBy(F.desc(x), F.desc("combined_score"), "trade_id")
    page = page if limit is None else page.limit(limit)
    committees = seats.groupBy("politician_id").agg(
        F.array_join(F.array_sort(F.collect_set("committee_name")), "; ").alias("committees")
    )
    if limit is not None:
        return _with_people(page, politicians, "full_name", "party", "state").join(committees, "politician_id", "left")
    person = politicians.select(F.col("id").alias("politician_id"), "full_name", "party", "state").join(committees, "politician_id", "left")
    return enrich(wanted.withColumn("combined_score", total), person, ["politician_id"]).orderBy(F.desc(x), F.desc("combined_score"), "trade_id")


def media_queue(scored: DataFrame, reports: DataFrame, limit: int = 100) -> DataFrame:
    """SEVERE trades whose report has both media texts, highest index first."""
    texts = reports.where("video_prompt is not null and narration_script is not null").select(
        "trade_id", F.col("id").alias("audit_report_id"), "video_prompt", "narration_script", "headline"
    )
    severe = scored.where(F.col("severity_quadrant") == "SEVERE").join(texts, "trade_id")
    return severe.withColumn("max_index", max_index()).orderBy(F.desc("max_index"), "trade_id").limit(limit)


def latest_report(daily: DataFrame) -> DataFrame:
    return daily.orderBy(F.desc("report_date")).limit(1)


def report_of(daily: DataFrame, day: str) -> DataFrame:
    return daily.where(F.col("report_date") == F.lit(day).cast("date")).limit(1)


def price_series(
    prices: DataFrame, ticker: str, since: str | None = None, until: str | None = None, limit: int = 200
) -> DataFrame:
    if since and until and since > until:
        raise ValueError("since must not be after until")
    wanted = optional_filters(prices, since=since, until=until, date="price_date").where(F.col("ticker") == ticker.upper())
    return wanted.select("price_date", "close").orderBy("price_date").limit(limit)


def top_contributors(contributions: DataFrame, limit: int = 200) -> DataFrame:
    """Largest contributors of every committee by total amount."""
    totals = contributions.groupBy("committee_id", "contributor_name").agg(F.sum("amount").alias("total"))
    return keep_first(totals, ["committee_id"], [F.desc("total"), F.col("contributor_name")], limit)


def latest_ready_asset(media: DataFrame, kind: str = "video") -> DataFrame:
    """Newest ready asset of one kind per trade."""
    ready = media.where((F.col("asset_type") == kind) & (F.col("generation_status") == "ready"))
    return ready.groupBy("trade_id").agg(
        F.max_by(F.struct("id", "storage_url"), F.struct("generated_at", "id")).alias("a")
    ).select("trade_id", "a.*")


def first_ready_assets(media: DataFrame, kind: str = "citation_image", per_trade: int = 3) -> DataFrame:
    """Oldest ready assets of one kind, at most `per_trade` each, with their position."""
    ready = media.where((F.col("asset_type") == kind) & (F.col("generation_status") == "ready"))
    rank = F.row_number().over(Window.partitionBy("trade_id").orderBy("generated_at", "id"))
    return ready.withColumn("position", rank).where(F.col("position") <= per_trade)
