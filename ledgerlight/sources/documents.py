"""Semi-structured sources: XML roll calls and filing indexes, JSON API records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions import sectors as S
from ledgerlight.functions import text as X
from ledgerlight.operators.lookup import enrich

ROLL_CALL = (
    "congress string, session string, vote_number string, vote_date string, question string, vote_result string, "
    "vote_title string, members struct<member: array<struct<last_name: string, first_name: string, party: string, "
    "state: string, vote_cast: string, lis_member_id: string>>>"
)
FILING = (
    "Prefix string, Last string, First string, Suffix string, FilingType string, StateDst string, Year string, "
    "FilingDate string, DocID string"
)
#: XML files of more bytes are read in splits; a record that is cut out of one has at most so many bytes.
SPLIT_BYTES = 32 << 20
RECORD_BYTES = 16 << 20
#: Comments, CDATA and instructions, where tags don't count; the text before the first and after the last record.
SECTIONS = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?(?!xml\s).*?\?>"
OPENING = (
    r"^\uFEFF?(?:<\?xml\s+version\s*=\s*[\"']1\.0[\"'](?:\s+encoding\s*=\s*[\"'](?i:utf-8)[\"'])?(?:\s+standalone\s*=\s*[\"'](?:yes|no)[\"'])?\s*\?>)?"
    r"\s*<([^\s<>/!?]+)(?:\s(?:[^<>]*[^<>/])?)?>\s*$"
)
CLOSING = r"^\s*</([^\s<>]+)\s*>\s*$"


def _text(value: Column | str) -> Column:
    return X.strip(F.coalesce(X.as_col(value), F.lit("")))


def read_xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements `tag` of XML files as Spark's XML reader gives them, with large files read in splits.

    That reader takes a file whole in one task. Files of more than SPLIT_BYTES are read as text instead, cut at the
    ends of their records. A pass before that finds those where the cut could give other rows: records have to be all
    there is in one root element, each whole, well-formed and of at most RECORD_BYTES, with no other start or end of
    one in comments or CDATA; the file has to be UTF-8. Any other file is read whole.
    """
    whole = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    # A longer record is left out here, so that the bytes don't add up to those of the file.
    text = spark.read.option("lineSep", f"</{tag}>").option("mapreduce.input.linerecordreader.line.maxlength", RECORD_BYTES).text(path)
    folders = text.drop("value").columns
    if len(whole.columns) < len(spark.createDataFrame([], schema).columns) + len(folders):
        return whole  # a folder's name gives a column's value
    size, file = F.col("_metadata.file_size"), F.col("_metadata.file_path")
    text = text.where(size > SPLIT_BYTES)
    odd = file.isin(_not_split(text, tag, schema))
    rests = text.where(~odd).select(F.explode(F.slice(F.split("value", _start(tag), 2), 2, 1)).alias("rest"), *folders)
    # A generated row is parsed once, whatever filters follow.
    split = rests.select(F.inline(F.array(F.from_xml(_record(F.col("rest"), tag), schema))), *folders)
    return whole.where((size <= SPLIT_BYTES) | odd).unionByName(split)


def _start(tag: str) -> str:
    return rf"<{re.escape(tag)}(?=[\s/>])"


def _record(rest: Column, tag: str) -> Column:
    return F.concat(F.lit(f"<{tag}"), rest, F.lit(f"</{tag}>"))


def _not_split(text: DataFrame, tag: str, schema: str) -> list[str]:
    """Files whose records can't be told from `text`, the parts between the records' ends."""
    end = len(f"</{tag}>".encode())
    marked = F.col("value").contains("<!") | F.col("value").contains("<?")
    parts = text.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
        F.split("value", _start(tag)).alias("raw"),
    ).withColumns({
        "bare": F.when(marked, F.split(F.regexp_replace("value", SECTIONS, " "), _start(tag))).otherwise(F.col("raw")),
        "wrong": F.from_xml(_record(F.get("raw", F.lit(1)), tag), f"{schema}, _corrupt_record string")["_corrupt_record"].isNotNull()})
    starts, inside = F.size("raw") - 1, F.get("bare", F.lit(1))
    odd = (
        ~F.is_valid_utf8("value") | (starts != F.size("bare") - 1) | inside.contains("<!") | inside.contains("<?")
        | inside.rlike(r"^(\s[^<]*)?/>") | inside.rlike(rf"</{re.escape(tag)}\s") | F.col("wrong"))
    files = parts.select(
        "file", "size", "place", starts.alias("starts"), odd.alias("odd"), F.get("bare", F.lit(0)).alias("gap"), (F.octet_length("value") + end).alias("bytes"),
    ).groupBy("file", "size").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count_if(F.col("starts") == 1).alias("records"),
        F.count_if(F.col("odd")).alias("odd"), F.count_if(F.col("gap").rlike(r"\S")).alias("gaps"),
        F.min_by("gap", "place").alias("first"), F.max_by(F.struct("gap", "starts"), "place").alias("last"))
    root, closed = F.regexp_extract("first", OPENING, 1), F.regexp_extract("last.gap", CLOSING, 1)
    # All parts but the last end a record; the reader leaves out a byte order mark.
    plain = (
        (F.col("odd") == 0) & (F.col("records") == F.col("n") - 1) & (F.col("last.starts") == 0) & (F.col("gaps") == 2)
        & (root != "") & (root == closed) & (F.col("bytes") - F.col("size")).isin(end, end - 3))
    return [r["file"] for r in files.where(~plain).select("file").collect()]


def read_roll_calls(spark: SparkSession, path: str, congress: int | None = None, session: int | None = None) -> DataFrame:
    """Roll-call XML -> one row per vote with the member array."""
    raw = read_xml(spark, path, "roll_call_vote", ROLL_CALL)
    parts = [
        F.lit(str(congress)) if congress else _text("congress"), F.lit(str(session)) if session else _text("session"),
        F.regexp_replace(_text("vote_number"), "^0+(?=.)", ""),
    ]
    return raw.select(
        F.concat(F.lit("senate-"), F.concat_ws("-", *parts)).alias("id"), F.lit("").alias("bill_id"),
        _text("vote_date").alias("vote_date"), F.lit("senate").alias("chamber"), _text("question").alias("vote_question"),
        F.coalesce(X.blank_to_null(_text("vote_title")), _text("vote_result")).alias("description"),
        F.lit(None).cast("string").alias("related_sector"), F.col("members.member").alias("members"),
    )


def roll_call_positions(votes: DataFrame, lis_map: DataFrame) -> DataFrame:
    """One row per member vote; the member key is mapped by (lis_member_id, bioguide_id)."""
    rows = votes.select(F.col("id").alias("vote_id"), F.explode("members").alias("m")).select(
        _text("m.lis_member_id").alias("lis_member_id"), _text("m.last_name").alias("last_name"),
        _text("m.first_name").alias("first_name"), _text("m.party").alias("party"), _text("m.state").alias("state"),
        "vote_id", X.vote_cast("m.vote_cast").alias("position"),
    )
    known = lis_map.where("lis_member_id <> '' and bioguide_id <> ''").groupBy(
        F.trim("lis_member_id").alias("lis_member_id")
    ).agg(F.max(F.trim("bioguide_id")).alias("politician_id"))
    return enrich(rows, known, ["lis_member_id"]).withColumn(
        "politician_id", F.coalesce("politician_id", F.lit(""))
    )


def read_filing_index(spark: SparkSession, path: str) -> DataFrame:
    """Filing-index XML -> transaction reports only, with the full name built from its parts."""
    raw = read_xml(spark, path, "Member", FILING)
    return raw.where(F.upper(_text("FilingType")).isin("P", "PTR")).select(
        _text("Prefix").alias("prefix"), _text("Last").alias("last_name"), _text("First").alias("first_name"),
        _text("Suffix").alias("suffix"), _text("FilingType").alias("filing_type"),
        _text("StateDst").alias("state_district"), _text("Year").alias("year"), _text("FilingDate").alias("filing_date"),
        _text("DocID").alias("doc_id"), F.trim(F.concat_ws(" ", _text("First"), _text("Last"))).alias("full_name"),
    )


MEMBERS = (
    "bioguideId string, name string, partyName string, state string, depiction struct<imageUrl: string>, "
    "terms struct<item: array<struct<chamber: string, district: string>>>"
)
COMMITTEES = "systemCode string, name string, chamber string"
BILLS = (
    "type string, number string, congress int, title string, introducedDate string, originChamber string, url string, "
    "latestAction struct<text: string, actionDate: string>"
)
BILL_DETAILS = (
    "type string, number string, congress int, introducedDate string, originChamber string, legislationUrl string, "
    "policyArea struct<name: string>, latestAction struct<text: string, actionDate: string>, "
    "sponsors array<struct<bioguideId: string>>"
)
HOUSE_VOTES = (
    "rollCallNumber long, startDate string, voteQuestion string, result string, legislationType string, "
    "legislationNumber string, results array<struct<bioguideID: string, voteCast: string>>"
)
CANDIDATES = (
    "candidate_id string, name string, party_full string, state string, district string, office string, "
    "incumbent_challenge_full string, principal_committees array<struct<committee_id: string>>"
)
TOTALS = (
    "candidate_id string, name string, party_full string, receipts double, disbursements double, "
    "cash_on_hand_end_period double, individual_contributions double, other_political_committee_contributions double"
)
CONTRIBUTIONS = (
    "contributor_name string, contributor_type string, contributor_employer string, contributor_occupation string, "
    "committee_id string, committee struct<name: string>, candidate_id string, contribution_receipt_amount double, "
    "contribution_receipt_date string, contributor_state string"
)
PACKAGES = (
    "packages array<struct<packageId: string, title: string, lastModified: string, dateIssued: string, "
    "docClass: string, category: string, packageLink: string>>"
)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def flatten_members(df: DataFrame) -> DataFrame:
    """API members -> raw people; chamber and district of the latest term."""
    term = F.try_element_at("terms.item", F.lit(-1))
    return df.where(F.coalesce("bioguideId", F.lit("")) != "").select(
        F.col("bioguideId").alias("id"), F.coalesce("name", F.lit("")).alias("full_name"),
        X.party_code(F.coalesce("partyName", F.lit(""))).alias("party"),
        X.member_chamber(F.coalesce(term["chamber"], F.lit(""))).alias("chamber"),
        F.coalesce("state", F.lit("")).alias("state"), term["district"].alias("district"),
        F.coalesce("depiction.imageUrl", F.lit("")).alias("photo_url"), F.lit(True).alias("in_office"),
    )


def flatten_committees(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("systemCode").alias("id"), "name", X.committee_chamber(F.coalesce("chamber", F.lit(""))).alias("chamber"),
        S.committee_tag("name").alias("industry_sector"),
    )


def _bill_key(congress: int | None = None) -> Column:
    where = F.col("congress") if congress is None else F.lit(congress)
    return F.concat(F.lower("type"), F.col("number"), F.lit("-"), where)


def flatten_bills(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Listed bills with their detail records: a detail value wins over the listed one."""
    detail = details.select(
        _bill_key().alias("id"), F.col("policyArea.name").alias("policy_area"),
        F.col("latestAction.text").alias("d_action"), F.col("latestAction.actionDate").alias("d_date"),
        F.col("originChamber").alias("d_chamber"), F.try_element_at("sponsors", F.lit(1))["bioguideId"].alias("sponsor_bioguide"),
        F.col("legislationUrl").alias("url"), F.col("introducedDate").alias("d_introduced"),
    )
    base = listed.withColumn("id", _bill_key()).drop("url")

    def either(first: str, second: str) -> Column:
        return F.coalesce(X.blank_to_null(F.col(first)), X.blank_to_null(F.col(second)))

    return base.join(detail, "id", "left").select(
        "id", "congress", F.concat(F.upper("type"), F.col("number")).alias("bill_number"), "title",
        either("introducedDate", "d_introduced").alias("introduced_date"), "policy_area",
        S.policy_sector("policy_area").alias("related_sector"), either("d_action", "latestAction.text").alias("latest_action"),
        either("d_date", "latestAction.actionDate").alias("latest_action_date"),
        either("d_chamber", "originChamber").alias("origin_chamber"), "sponsor_bioguide", "url",
    )


def read_variant(spark: SparkSession, path: str, name: str = "record") -> DataFrame:
    """JSON records without a schema, each whole in one VARIANT column: fields nobody asked for stay readable."""
    return spark.read.format("json").option("singleVariantColumn", name).load(path)


def variant_field(record: Column | str, path: str, kind: str = "string") -> Column:
    """The value at `path`; NULL if it is missing or can't be read as `kind`."""
    return F.try_variant_get(X.as_col(record), path, kind)


def either_field(detail: Column | str, listed: Column | str, path: str, listed_path: str | None = None) -> Column:
    """Text at `path` of the detail record, else of the listed one; empty text counts as missing."""
    found = [variant_field(detail, path), variant_field(listed, listed_path or path)]
    return F.coalesce(*[X.blank_to_null(f) for f in found])


def flatten_bill_records(listed: DataFrame, details: DataFrame, extra: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Bills out of schema-less records (`record`): a detail value, where it is there, wins over the listed one.

    `extra` names further columns as (path, type), looked up in the detail and then in the listed record.
    Repeated details of a bill count once: that with the greatest JSON text. Records without type, number
    or congress match nothing.
    """
    def key(record: str) -> Column:
        kind, number, congress = (variant_field(record, f"$.{f}") for f in ("type", "number", "congress"))
        return F.concat(F.lower(kind), number, F.lit("-"), congress)

    text = F.max(F.to_json("record")).alias("_text")
    detail = details.select(key("record").alias("id"), "record").where("id IS NOT NULL").groupBy("id").agg(text)
    joined = listed.select(key("record").alias("id"), F.col("record").alias("l")).join(detail, "id", "left").select(
        "id", "l", F.try_parse_json("_text").alias("d")
    )
    kind, number = variant_field("l", "$.type"), variant_field("l", "$.number")
    area = variant_field("d", "$.policyArea.name")
    return joined.select(
        "id", variant_field("l", "$.congress", "int").alias("congress"), F.concat(F.upper(kind), number).alias("bill_number"),
        variant_field("l", "$.title").alias("title"), either_field("l", "d", "$.introducedDate").alias("introduced_date"),
        area.alias("policy_area"), S.policy_sector(area).alias("related_sector"),
        either_field("d", "l", "$.latestAction.text").alias("latest_action"),
        either_field("d", "l", "$.latestAction.actionDate").alias("latest_action_date"),
        either_field("d", "l", "$.originChamber").alias("origin_chamber"),
        variant_field("d", "$.sponsors[0].bioguideId").alias("sponsor_bioguide"), variant_field("d", "$.legislationUrl").alias("url"),
        *[F.coalesce(variant_field("d", p, k), variant_field("l", p, k)).alias(n) for n, (p, k) in (extra or {}).items()],
    )


def flatten_house_votes(df: DataFrame, congress: int = 119) -> DataFrame:
    bill = F.concat("legislationType", "legislationNumber", F.lit(f"-{congress}"))
    return df.select(
        F.concat(F.lit(f"house-{congress}-"), F.col("rollCallNumber")).alias("id"),
        F.coalesce(bill, F.lit("")).alias("bill_id"), F.col("startDate").alias("vote_date"), F.lit("house").alias("chamber"),
        F.col("voteQuestion").alias("vote_question"), F.col("result").alias("description"),
        F.lit(None).cast("string").alias("related_sector"),
    )


def flatten_house_positions(df: DataFrame, congress: int = 119) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"house-{congress}-"), F.col("rollCallNumber")).alias("vote_id"), F.explode("results").alias("r")
    ).where(F.coalesce("r.bioguideID", F.lit("")) != "").select(
        F.col("r.bioguideID").alias("politician_id"), "vote_id", X.vote_cast("r.voteCast").alias("position")
    )


def flatten_candidates(df: DataFrame, election_year: int = 2024) -> DataFrame:
    return df.select(
        "candidate_id", "name", F.col("party_full").alias("party"), "state", "district",
        X.office_name("office").alias("office"), F.col("incumbent_challenge_full").alias("incumbent_challenge"),
        F.lit(election_year).alias("election_year"),
        F.try_element_at("principal_committees", F.lit(1))["committee_id"].alias("principal_committee_id"),
    )


def flatten_totals(df: DataFrame, election_year: int = 2024) -> DataFrame:
    return df.select(
        "candidate_id", "name", F.col("party_full").alias("party"), F.col("receipts").alias("total_receipts"),
        F.col("disbursements").alias("total_disbursements"), F.col("cash_on_hand_end_period").alias("cash_on_hand"),
        F.col("individual_contributions").alias("total_individual_contributions"),
        F.col("other_political_committee_contributions").alias("total_pac_contributions"),
        F.lit(election_year).alias("election_year"),
    )


def flatten_contributions(df: DataFrame) -> DataFrame:
    return df.select(
        "contributor_name", "contributor_type", "contributor_employer", "contributor_occupation", "committee_id",
        F.col("committee.name").alias("committee_name"), "candidate_id",
        F.col("contribution_receipt_amount").alias("amount"), F.col("contribution_receipt_date").alias("receipt_date"),
        F.col("contributor_state").alias("state"),
    )


def flatten_packages(pages: DataFrame, bill_type: str, congress: int) -> DataFrame:
    """Publication catalogue -> packages of one bill type and congress (by substring of the id)."""
    rows = pages.select(F.explode("packages").alias("p")).where(
        F.upper("p.packageId").contains(bill_type.upper()) & F.col("p.packageId").contains(f"-{congress}")
    )
    return rows.select(
        F.col("p.packageId").alias("package_id"), X.bill_id_from_package("p.packageId").alias("bill_id"),
        F.col("p.title").alias("title"), F.lit(congress).alias("congress"), F.lit(bill_type).alias("bill_type"),
        F.col("p.lastModified").alias("last_modified"), F.col("p.dateIssued").alias("date_issued"),
        F.col("p.docClass").alias("doc_class"), F.col("p.category").alias("category"),
        F.col("p.packageLink").alias("download_url"),
    )


def flatten_committee_reports(pages: DataFrame, congress: int) -> DataFrame:
    rows = pages.select(F.explode("packages").alias("p")).where(F.col("p.packageId").contains(f"-{congress}"))
    return rows.select(
        F.col("p.packageId").alias("package_id"), F.col("p.title").alias("title"), F.lit(congress).alias("congress"),
        F.col("p.lastModified").alias("last_modified"), F.col("p.dateIssued").alias("date_issued"),
        F.col("p.docClass").alias("doc_class"),
    )
