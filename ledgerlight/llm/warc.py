"""WARC archives: written with identical payloads as revisits, read by verifying the chain of record boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.shared import scratch_table, small

# Fixed values of the format.
MAGIC = "WARC/1."
BREAK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What separates the pieces that a file is read in. It cannot end where another one begins, so no match hides one.
SEPARATOR = f"\n{MAGIC}"
PAGE = "urn:page:"


def digest(payload: Column) -> Column:
    """Base32 SHA-1 of a binary column: five hex digits are four base-32 ones."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(record) per row of `pages` (page_id, url, html): the text of its WARC record without the closing line breaks.

    The payload is the html, empty for NULL. Of rows with equal payloads of `least` bytes or more that with
    the largest page_id is a response, and the others revisit it; rows that repeat its page_id are responses
    too, and a NULL page_id revisits any known one. Other columns are ignored. A line break in a URL is escaped,
    and a NULL URL leaves the field out.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("_key", F.sha2(F.col("html").cast("binary"), 256))
    size = F.octet_length("html")
    copies = rows.where(size >= least).groupBy("_key").agg(F.max("page_id").alias("_keeper"), F.count(F.lit(1)).alias("_n"))
    copies = scratch_table(copies.where("_n > 1").drop("_n"), "copies")
    marked = rows.join(small(copies), "_key", "left")
    revisit = F.col("_keeper").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_keeper")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(BREAK))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def name(page: Column) -> Column:
        return F.concat(F.lit(f"<{PAGE}"), F.coalesce(page.cast("string"), F.lit("unknown")), F.lit(">"))

    lines = [
        F.lit("WARC/1.1"), F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))), F.lit("WARC-Date: 2000-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), address),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest(F.col("html").cast("binary"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("_keeper")))), F.when(revisit, f"WARC-Profile: {PROFILE}"),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length("_block").cast("string")),
    ]
    return marked.withColumn("_block", block).select(F.concat(F.concat_ws("\r\n", *lines), F.lit(BREAK), F.col("_block")).alias("record"))


def write(pages: DataFrame, folder: str, least: int = 0, compression: str = "gzip") -> None:
    """One archive per partition of `pages`, by Spark's own writer and committer: any file system will do."""
    records(pages, least).write.option("lineSep", BREAK).option("compression", compression).text(folder)


# --- reading -------------------------------------------------------------------------------------

def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def _page(name: Column) -> Column:
    return F.regexp_extract(name, rf"<{PAGE}(-?\d+)>", 1).try_cast("long")


def _parsed(body: Column) -> dict[str, Column]:
    """What a piece says if it is a record; `body` is the text after the magic."""
    closed = F.contains(body, F.lit(BREAK))
    # A payload that itself begins with the magic takes the header's last byte into the separator.
    header = F.when(closed, F.substring_index(body, BREAK, 1)).when(F.endswith(body, F.lit("\r\n\r")), F.expr("left(_body, length(_body) - 3)"))
    return {"_header": F.when(header.rlike(r"^[01]\r\n"), header)}


def _contents(rows: DataFrame) -> DataFrame:
    """Adds the fields of the record that `_body` (text after the magic) begins with, and of its payload as far as it goes."""
    rows = rows.withColumns(_parsed(F.col("_body")))
    rows = rows.withColumns({"_length": _field(F.col("_header"), "Content-Length").try_cast("long"), "_head": F.octet_length("_header") + 4})
    http = F.coalesce(_field(F.col("_header"), "Content-Type").startswith("application/http"), F.lit(False))
    rows = rows.withColumn("_block", F.expr("substring(cast(_body AS binary), cast(_head + 1 AS int), cast(_length AS int))"))
    rows = rows.withColumn("_http", F.when(http, F.substring_index(F.col("_block").cast("string"), BREAK, 1)))
    rows = rows.withColumn(
        "_payload", F.when(http, F.expr("substring(_block, octet_length(_http) + 5)")).otherwise(F.col("_block"))
    )
    revisit = _field(F.col("_header"), "WARC-Type") == "revisit"
    said = F.regexp_replace(_field(F.col("_header"), "WARC-Payload-Digest"), "^sha1:", "")
    return rows.withColumns({
        "record_type": _field(F.col("_header"), "WARC-Type"), "record_id": _field(F.col("_header"), "WARC-Record-ID"),
        "refers_to_id": _field(F.col("_header"), "WARC-Refers-To"), "url": _field(F.col("_header"), "WARC-Target-URI"),
        "payload_bytes": F.when(revisit, _field(F.col("_http"), "Content-Length").try_cast("long")).otherwise(F.octet_length("_payload").cast("long")),
        "payload_digest": F.when(revisit, said).otherwise(digest(F.col("_payload"))), "said_digest": said,
        "_complete": F.octet_length(F.col("_body").cast("binary")) >= F.col("_head") + F.col("_length"),
    })


FIELDS = ["record_type", "record_id", "refers_to_id", "url", "payload_bytes", "payload_digest", "said_digest"]


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The files cut at every magic that begins a line: file, _block (of the file), _row (order), _first, _size, _body."""
    read = spark.read.option("lineSep", SEPARATOR).text(folder).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return read.withColumn("_size", F.octet_length(F.col("value")).cast("long"))


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds `at`, the byte after the magic that a piece follows. A file's pieces and separators make up all its bytes."""
    order = Window.partitionBy("file").orderBy("_start", "_row")
    before = F.coalesce(F.sum(F.col("_size") + len(SEPARATOR)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pieces.withColumn("at", F.when(before == 0, len(MAGIC)).otherwise(before))


def reachable(candidates: DataFrame) -> DataFrame:
    """The rows of `candidates` (file, at, after) that the chain from each file's first byte leads to.

    `after` is where the record that begins at `at` says the next one begins, NULL for what is no record.
    Most candidates lead to the very next one. Such runs are taken as one step; between runs, pointers are
    doubled until every run that the start leads to is known, so the rounds grow with the logarithm of the
    number of breaks, each of which is a magic inside a payload.
    """
    order = Window.partitionBy("file").orderBy("at")
    linked = F.lag("after").over(order) == F.col("at")
    runs = candidates.withColumn("_new", F.when(linked, 0).otherwise(1)).withColumn("run", F.sum("_new").over(order)).drop("_new")
    runs = scratch_table(runs, "runs")
    ends = runs.groupBy("file", "run").agg(F.max_by("after", "at").alias("after"))
    jumps = ends.join(runs.select("file", F.col("at").alias("after"), F.col("run").alias("to")), ["file", "after"]).select(
        "file", "run", "to", F.col("after").alias("entry")
    )
    reached = scratch_table(runs.where(F.col("at") == len(MAGIC)).select("file", "run", F.col("at").alias("entry")), "reached")
    jumps = scratch_table(jumps, "jumps")
    count = reached.count()
    while not jumps.isEmpty():
        step = reached.select("file", "run").join(jumps, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        reached = scratch_table(reached.unionByName(step).groupBy("file", "run").agg(F.min("entry").alias("entry")), "reached")
        more = reached.count()
        if more == count:
            break
        count = more
        onward = jumps.select("file", F.col("run").alias("to"), F.col("to").alias("_to"), F.col("entry").alias("_entry"))
        jumps = scratch_table(jumps.drop("entry").join(onward, ["file", "to"]).select("file", "run", F.col("_to").alias("to"), F.col("_entry").alias("entry")), "jumps")
    return runs.join(reached, ["file", "run"]).where(F.col("at") >= F.col("entry")).drop("run", "entry")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives in `folder`: file, offset, record_type, record_id, refers_to_id, url, payload_bytes,
    payload_digest (of the bytes read, for revisits as recorded) and said_digest (as recorded, NULL if it isn't).

    Files are cut at every magic at the start of a line, by Spark's own reader: in splits, where the compression
    allows. A piece is a candidate record and names its successor; the chain from the start of the file tells
    records from text inside payloads. Only the few columns of the candidates are sorted, a file's at a time. Payloads
    that hold the magic span several pieces; their files are read once more and the pieces put together.
    A damaged record ends its file's chain.
    """
    cut = _pieces(spark, folder)
    first = F.col("value").startswith(MAGIC) & (F.col("_start") == 0)
    # Only a file's first piece begins with the magic and no line break before it; the text of any other follows its magic.
    body = F.when(first, F.substring(F.col("value"), len(MAGIC) + 1, 2**31 - 1)).otherwise(F.col("value"))
    parsed = _contents(cut.withColumn("_body", body))
    narrow = scratch_table(parsed.select("file", "_start", "_row", "_size", "_head", "_length", "_complete", *FIELDS), "candidates")
    placed = _placed(narrow).withColumn("after", F.col("at") + F.col("_head") + F.col("_length") + len(BREAK) + len(MAGIC))
    found = reachable(placed).where("after IS NOT NULL").withColumn("offset", F.col("at") - len(MAGIC))
    found = scratch_table(found, "records")
    whole = found.where("_complete").select("file", "offset", *FIELDS)
    broken = found.where("NOT _complete").select("file", "at", "after")
    if broken.isEmpty():
        return whole
    texts = _placed(cut.join(small(broken.select("file").distinct()), "file", "left_semi"))
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = texts.join(broken, ["file", "at"], "left").withColumns({
        "_owner": F.last(F.when(F.col("after").isNotNull(), F.col("at")), True).over(order), "_until": F.last("after", True).over(order),
    }).where("at < _until")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: p["value"])
    joined = owned.groupBy("file", "_owner").agg(F.array_join(parts, SEPARATOR).alias("value"))
    opening = F.when(F.col("_owner") == len(MAGIC), F.substring(F.col("value"), len(MAGIC) + 1, 2**31 - 1)).otherwise(F.col("value"))
    mended = _contents(joined.withColumn("_body", opening)).where("_complete")
    return whole.unionByName(mended.withColumn("offset", F.col("_owner") - len(MAGIC)).select("file", "offset", *FIELDS))


def page_of(record_id: Column) -> Column:
    return _page(record_id)
