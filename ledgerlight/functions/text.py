"""Scalar text functions: every one takes and returns Spark columns (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlight.functions import vocab as V

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column) -> Column:
    """Without white space (also tabs and line ends) on both sides."""
    return F.btrim(value, F.lit(" \t\n\r\x0b\x0c"))


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of `key` in a small fixed table, NULL when absent."""
    return F.try_element_at(literal_map(mapping), key)


def first_containing(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Result of the first rule whose fragment occurs in `text`."""
    return F.coalesce(*[F.when(text.contains(fragment), F.lit(result)) for fragment, result in rules])


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


# --- names, places, roles -------------------------------------------------------------------

def state_abbrev(value: ColumnLike) -> Column:
    name = strip(as_col(value))
    return F.when(F.length(name) <= 2, F.upper(name)).otherwise(
        F.coalesce(lookup(V.STATE_ABBREV, F.lower(name)), F.upper(F.left(name, F.lit(2))))
    )


def chamber_name(value: ColumnLike) -> Column:
    raw = as_col(value)
    return F.coalesce(lookup(V.CHAMBERS, F.lower(strip(raw))), raw)


def member_chamber(value: ColumnLike) -> Column:
    low = F.lower(as_col(value))
    return F.when(low == "house of representatives", "house").otherwise(low)


def committee_chamber(value: ColumnLike) -> Column:
    low = F.lower(as_col(value))
    return (
        F.when(low == "house of representatives", "house")
        .when(low.isin("senate", "joint"), low)
        .otherwise("joint")
    )


def party_code(value: ColumnLike) -> Column:
    raw = as_col(value)
    return F.when(raw.contains("Republican"), "R").when(raw.contains("Democrat"), "D").otherwise("I")


def office_name(value: ColumnLike) -> Column:
    return lookup(V.OFFICES, as_col(value))


def vote_cast(value: ColumnLike) -> Column:
    """Spoken vote -> yes / no / not_voting / abstain."""
    return F.coalesce(lookup(V.VOTE_CASTS, F.lower(strip(as_col(value)))), F.lit("not_voting"))


def vote_position(value: ColumnLike) -> Column:
    """Normalised vote -> stored spelling."""
    return F.coalesce(lookup(V.VOTE_POSITIONS, as_col(value)), F.lit("Not Voting"))


def seat_role(title: ColumnLike) -> Column:
    low = F.lower(as_col(title))
    return (
        F.when(low.contains("chairman") | (low.contains("chair") & ~low.contains("vice")), "chair")
        .when(low.contains("ranking"), "ranking_member")
        .when(low.contains("vice"), "vice_chair")
        .when(low.contains("ex officio"), "ex_officio")
        .otherwise("member")
    )


def is_leader(role: ColumnLike) -> Column:
    low = F.lower(F.coalesce(as_col(role), F.lit("")))
    return low.contains("chair") | low.contains("ranking")


# --- amounts, tickers, transactions ---------------------------------------------------------

def amount_range(text: ColumnLike, ranges=V.HOUSE_AMOUNTS) -> Column:
    """Range text -> struct(lower, upper, midpoint); the first matching pattern wins."""
    raw = as_col(text)

    def bounds(lower: int, upper: int) -> Column:
        named = {"lower": lower, "upper": upper, "midpoint": (lower + upper) // 2}
        return F.struct(*[F.lit(v).cast("long").alias(n) for n, v in named.items()])

    matches = [F.when(raw.rlike(pattern), bounds(lower, upper)) for pattern, lower, upper in ranges]
    return F.coalesce(*matches, bounds(*V.DEFAULT_RANGE))


def labelled_ticker(text: ColumnLike, pattern: str = V.HOUSE_TICKER) -> Column:
    """Ticker in brackets or after a label, NULL when there is none."""
    raw, groups = as_col(text), pattern.count("([A-Z]{1,5})")
    found = [blank_to_null(F.regexp_extract(raw, pattern, i)) for i in range(1, groups + 1)]
    return F.upper(F.coalesce(*found))


def ticker_from_text(text: ColumnLike) -> Column:
    """Labelled ticker, else the first short word that is not a stop word."""
    raw = as_col(text)
    words = F.transform(F.split(F.upper(raw), r"\s+"), lambda w: F.btrim(w, F.lit("()[].,")))
    short = F.filter(words, lambda w: w.rlike("^[A-Z]{1,5}$") & ~w.isin(V.NOT_TICKERS))
    return F.coalesce(labelled_ticker(raw), F.try_element_at(short, F.lit(1)))


def valid_ticker_cell(cell: ColumnLike) -> Column:
    clean = F.upper(strip(as_col(cell)))
    return F.when(clean.rlike("^[A-Z]{1,5}$"), clean)


def company_ticker(name: ColumnLike) -> Column:
    return first_containing(F.lower(strip(as_col(name))), list(V.COMPANY_TICKERS.items()))


def trade_type(text: ColumnLike, table=V.HOUSE_TRANSACTIONS) -> Column:
    """Exact wording first, then the first wording contained in the text."""
    low = F.lower(strip(as_col(text)))
    return F.coalesce(lookup(table, low), first_containing(low, list(table.items())))


def trade_type_contained(text: ColumnLike, table=V.SENATE_TRANSACTIONS) -> Column:
    return first_containing(F.lower(as_col(text)), list(table.items()))


# --- dates ------------------------------------------------------------------------------------

# Accepted date spellings, rewritten to year-month-day.
DATE_SPELLINGS = [
    (r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?!\d).*$", "$3-$1-$2"),
    (r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2})(?!\d).*$", "20$3-$1-$2"),
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2}).*$", "$1-$2-$3"),
]
WORDED_DATE = (r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}), (\d{4}).*$", "$1 $2 $3")
OFFSET_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ].*(Z|[+-]\d{2}:?\d{2})$"


def parse_date(text: ColumnLike) -> Column:
    """Month-first mixed-format date; NULL when nothing fits. Offsets are taken to UTC."""
    raw = strip(as_col(text))
    instant = F.try_to_timestamp(raw)
    utc_day = F.when(raw.rlike(OFFSET_INSTANT), F.to_date(F.to_utc_timestamp(instant, F.current_timezone())))
    dashed = raw
    for pattern, rewritten in DATE_SPELLINGS:
        dashed = F.regexp_replace(dashed, pattern, rewritten)
    worded = F.initcap(F.regexp_replace(raw, *WORDED_DATE))
    return F.coalesce(utc_day, F.try_to_date(dashed, "yyyy-M-d"), F.try_to_date(worded, "MMM d yyyy"))


def lag_days(later: ColumnLike, earlier: ColumnLike) -> Column:
    return F.datediff(as_col(later), as_col(earlier))


# --- bills and roll calls -----------------------------------------------------------------

def bill_number_parts(text: ColumnLike) -> Column:
    """'HR144' -> struct('HR', 144)."""
    raw = as_col(text)
    return F.struct(
        F.upper(blank_to_null(F.regexp_extract(raw, r"^([A-Za-z]+)", 1))).alias("bill_type"),
        blank_to_null(F.regexp_extract(raw, r"(\d+)", 1)).cast("int").alias("bill_number"),
    )


def bill_id_from_title(title: ColumnLike, congress: int = 119) -> Column:
    raw = as_col(title)
    kind = lookup(V.BILL_TYPES, F.lower(F.regexp_extract(raw, V.BILL_REFERENCE, 1)))
    return F.concat(kind, F.regexp_extract(raw, V.BILL_REFERENCE, 2), F.lit(f"-{congress}"))


def bill_id_from_package(package_id: ColumnLike) -> Column:
    raw = as_col(package_id)
    part = [F.regexp_extract(raw, V.PACKAGE_ID, i) for i in (1, 2, 3)]
    return F.when(raw.rlike(V.PACKAGE_ID), F.concat(F.lower(part[1]), part[2], F.lit("-"), part[0]))


def congress_of_roll_call(roll_call_id: ColumnLike) -> Column:
    return F.try_element_at(F.split(as_col(roll_call_id), "-"), F.lit(2)).try_cast("int")


def committee_code(code: ColumnLike) -> Column:
    low = F.lower(strip(as_col(code)))
    return F.when(low.rlike(r"\d"), low).otherwise(F.concat(low, F.lit("00")))


def filing_url(doc_id: ColumnLike) -> Column:
    raw = as_col(doc_id)
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit(V.FILING_URL), raw, F.lit(".pdf"))
    )


def bill_url(bill_type: ColumnLike, number: ColumnLike) -> Column:
    slug = lookup(V.BILL_SLUGS, F.lower(as_col(bill_type)))
    return F.concat(F.lit(V.BILL_URL), slug, F.lit("/"), as_col(number).cast("string"))


def bill_links(text: ColumnLike) -> Column:
    """Distinct bill mentions as array<struct<label, url>>."""
    found = F.array_distinct(F.regexp_extract_all(as_col(text), F.lit(V.BILL_LINK), F.lit(1)))

    def link(label: Column) -> Column:
        slug = F.lower(F.regexp_replace(F.regexp_replace(label, r"\.\s*", ""), r"\s+", ""))
        house = F.when(slug.startswith("s"), "senate").otherwise("house")
        number = F.regexp_replace(slug, r"\D", "")
        url = F.concat(F.lit(V.BILL_URL), house, F.lit("-bill/"), number)
        return F.struct(label.alias("label"), url.alias("url"))

    return F.transform(found, link)


# --- identifiers and JSON ---------------------------------------------------------------------

def cik_of_accession(accession: ColumnLike) -> Column:
    return F.ltrim(F.split(as_col(accession), "-").getItem(0), F.lit("0"))


def clean_cik(value: ColumnLike) -> Column:
    return F.ltrim(strip(as_col(value)), F.lit("0"))


def clean_cusip(value: ColumnLike) -> Column:
    """First nine characters, NULL below six."""
    trimmed = strip(as_col(value))
    return F.when(F.length(trimmed) >= 6, F.left(trimmed, F.lit(9)))


def lenient_number(value: ColumnLike) -> Column:
    return F.coalesce(as_col(value).try_cast("double"), F.lit(0.0))


def truncate_text(value: ColumnLike, size: int = 100) -> Column:
    return F.left(as_col(value), F.lit(size))


def json_items(value: ColumnLike) -> Column:
    """Number of elements of a JSON array, 0 for NULL or anything else."""
    return F.coalesce(F.json_array_length(as_col(value)), F.lit(0))


def unfence_json(value: ColumnLike) -> Column:
    """JSON text without a surrounding Markdown fence."""
    trimmed = strip(as_col(value))
    inner = F.btrim(trimmed, F.lit("`"))
    inner = F.when(inner.startswith("json"), strip(F.substring(inner, 5, 1 << 30))).otherwise(inner)
    return F.when(trimmed.startswith("```"), strip(inner)).otherwise(trimmed)


def concat_all(*parts: Column | str) -> Column:
    """Concatenation in which strings are literal and NULL columns read 'None'."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.concat(*texts)
