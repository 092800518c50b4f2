"""Benchmark items inside documents: size-partitioned MinHash containment search. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.shared import scratch_table, small, whole_row

SHINGLE = 5
CONTAINMENT = 0.8


def _words(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def _shingles(words: Column, width: Column) -> Column:
    """Distinct shingles of `width` words; a shorter text has none."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (width - 1)))
    made = F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, width), " ")))
    return F.when(F.size(words) >= width, made).otherwise(F.array().cast("array<string>"))


def _text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _need(n: Column, threshold: float) -> Column:
    """Fewest of n shingles that make the share `threshold`."""
    return F.ceil(n * F.lit(threshold) - 1e-9)


def _window_hash(hashes: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + i) for i in range(width)])


def sketches(items: DataFrame, width: int, threshold: float) -> DataFrame:
    """(hash, item_key, width, need): the smallest MinHash values of every item, as many as its size partition needs.

    `width` is the most words of a shingle; an item's own, in its column of that name, is less where it is shorter.
    Items are partitioned by their number of shingles n, at powers of two. A text that holds the share
    t of an item lacks at most n - ceil(t*n) of its shingles, so of any n - ceil(t*n) + 1 of them it holds
    one. Every item keeps that many of its smallest hash values, counted for the largest n of its
    partition: a document that reaches t holds at least one value of the sketch, none is missed.
    """
    hashes = F.transform(F.col("words"), lambda w: F.xxhash64(w))
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - F.col("width")))

    def windows(w: int) -> Column:
        return F.array_distinct(F.transform(at, lambda i: _window_hash(F.col("_h"), i, w)))

    hashed = items.withColumn("_h", hashes).withColumn("_h", F.coalesce(*[F.when(F.col("width") == w, windows(w)) for w in range(1, width + 1)]))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))
    depth = (upper - _need(upper, threshold) + 1).cast("int")
    return hashed.select(
        F.explode(F.slice(F.array_sort("_h"), F.lit(1), depth)).alias("hash"), "item_key", "width", _need(F.col("n"), threshold).alias("need")
    )


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, width: int = SHINGLE, threshold: float = CONTAINMENT) -> DataFrame:
    """(text_key, item_key, containment) for every distinct text that holds `threshold` or more of an item's shingles.

    text_key and item_key are the MD5 of the texts, so exact copies are looked at once. Texts are first
    searched for the items' sketches, each position of a text hashed once; the candidates' shingles are
    then intersected with the items' own. NULL, blank and wordless texts hold nothing and are in nothing.
    An item of fewer than `width` words is one shingle of its own width: it is in every text that has just
    these words in a row, so an item of one common word is in very many.
    """
    items = benchmark.select(_text_key(F.col("text")).alias("item_key"), _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.dropDuplicates(["item_key"]).withColumn("width", F.least(F.lit(width), F.size("words")))
    items = scratch_table(items.withColumn("shingles", _shingles(F.col("words"), F.col("width"))).withColumn("n", F.size("shingles")), "items")
    sketch = scratch_table(sketches(items, width, threshold), "sketches")
    # At most `width` numbers: those of the shingles' words that items have.
    widths = sorted(r["width"] for r in items.select("width").distinct().collect()) or [width]

    hashes = F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))
    hashed = docs.where(F.col("text").isNotNull()).select(_text_key(F.col("text")).alias("text_key"), hashes.alias("hashes"))
    last = F.size("hashes") - widths[0]
    at = hashed.where(last >= 0).select("text_key", "hashes", F.explode(F.sequence(F.lit(0), last)).alias("at"))

    def window(w: int) -> Column:
        return F.when(F.col("at") + w <= F.size("hashes"), _window_hash(F.col("hashes"), F.col("at"), w))

    starts = F.size("hashes").alias("size"), F.col("at")
    positions = at.select("text_key", *starts, window(widths[0]).alias("hash")) if len(widths) == 1 else at.select(
        "text_key", *starts, F.explode(F.array_compact(F.array(*[window(w) for w in widths]))).alias("hash"))
    candidates = scratch_table(
        positions.join(small(sketch), "hash").where("size - width + 1 >= need").select("text_key", "item_key", "width").distinct(), "candidates"
    )

    wanted = candidates.select("text_key").distinct()
    texts = docs.select(_text_key(F.col("text")).alias("text_key"), "text").join(small(wanted), "text_key", "left_semi")
    # The words are a column of their own: inside the lambda that joins them they would be made once per shingle.
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text")).select("text_key", _words(F.col("text")).alias("words"))
    found = [F.struct(F.lit(w).alias("width"), _shingles(F.col("words"), F.lit(w)).alias("found")) for w in widths]
    texts = texts.select("text_key", F.inline(F.array(*found)))
    pairs = candidates.join(texts, ["text_key", "width"]).join(items.select("item_key", "shingles", "n"), "item_key")
    shared = F.size(F.array_intersect("shingles", "found"))
    return pairs.withColumn("shared", shared).where(F.col("shared") >= _need(F.col("n"), threshold)).select(
        "text_key", "item_key", (F.col("shared") / F.col("n")).alias("containment")
    )


def contaminations(docs: DataFrame, benchmark: DataFrame, width: int = SHINGLE, threshold: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, containment) for every document and item it holds; see `contaminated_texts`.

    Rows of the same ids count once, with their largest containment; NULL ids are kept as they are.
    """
    held = scratch_table(contaminated_texts(docs, benchmark, width, threshold), "contaminated")
    keyed = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"))
    named = benchmark.select("item_id", _text_key(F.col("text")).alias("item_key"))
    return keyed.join(small(held), "text_key").join(named, "item_key").groupBy("doc_id", "item_id").agg(
        F.max("containment").alias("containment")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = SHINGLE, threshold: float = CONTAINMENT) -> DataFrame:
    """`docs` (all columns) without the documents that hold an item; NULL texts stay."""
    held = scratch_table(contaminated_texts(docs, benchmark, width, threshold).select("text_key").distinct(), "contaminated")
    keyed = docs.select(whole_row(docs), _text_key(F.col("text")).alias("text_key"))
    return keyed.join(small(held), "text_key", "left_anti").select("row.*")
