"""Exact top-k lexical search: hashed max-sketches give upper bounds, rescoring in descending order of bounds.

Terms are maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased. A document's impact of a
term grows with the term's count alone, given the document's length. So the sketch folds the counts: every
term is hashed to a slot, and a slot keeps the greatest count of its terms. The impact that belongs to a
slot's count is at least that of any term hashed to it; summed over a query's terms, times their weights, that
bounds the score from above. The sketch needs no statistics of the corpus, so an index can be extended.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.shared import scratch_table, ship, text_parts, unship

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
TOP = 10
#: Slots per different term of a document: a term that isn't there meets another one's count once in 16 times.
SLOTS = 16
#: Largest count of a slot, which stands for any larger one too.
MOST = 15
#: Items searched for in one pass over the index, and bounds kept at once.
ITEMS, CELLS = 2_000, 1 << 21
#: Score of a term: weight * (UNIT * tf // (1000 * tf + 8 * m)), below UNIT // 1000 whatever tf.
UNIT = 1_000_000_000
KEEP = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(KEEP).split(b" ") if text else []


def term_hashes(text: str | None) -> np.ndarray:
    """64 bits per term, repeats included."""
    found = [t for t in terms(text) if t]
    return np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found))


def sketch(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The greatest count (MOST: that or more) of the terms in each slot; a power of two of slots, at least SLOTS per term.

    A byte holds two slots. `hashes` are sorted, so a slot, their first bits, is a stretch of them.
    """
    bits = slot_bits(len(hashes))
    out = np.zeros(1 << bits, np.uint8)
    if len(hashes):
        slots = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
        out[slots[starts]] = np.maximum.reduceat(np.minimum(counts, MOST), starts)
    return out[0::2] | out[1::2] << 4


def unpacked(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(hashes, np.uint64), np.frombuffer(counts, f"<u{len(counts) * 8 // max(1, len(hashes))}" if hashes else "<u2")


def slot_bits(n: int) -> int:
    return max(4, (SLOTS * n - 1).bit_length())


def impacts(counts: np.ndarray, m: int) -> np.ndarray:
    """Share of a term's weight that its count earns in a document with length factor m, in millionths."""
    counts = counts.astype(np.int64)
    return UNIT * counts // (1000 * counts + 8 * m)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_parts(batch):
            sizes, sketches, hashes, counts = [], [], [], []
            for text in part.column("text"):
                found = term_hashes(text.as_py())
                distinct, n = np.unique(found, return_counts=True)
                sizes.append(len(found))
                sketches.append(sketch(distinct, n).tobytes())
                hashes.append(distinct.tobytes())
                counts.append(n.astype("<u2" if n.max(initial=0) < 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), *[pa.array(c, pa.binary()) for c in (sketches, hashes, counts)]],
                names=["doc_id", "n", "sketch", "hashes", "counts"])


def index(docs: DataFrame) -> DataFrame:
    """A written table (doc_id, n, sketch, hashes, counts) per row of `docs` (doc_id, text): terms with repeats, the
    sketch, and the different terms' hashes and counts for exact scores. One pass, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return scratch_table(docs.select("doc_id", "text").mapInArrow(_index, f"doc_id {kind}, n long, sketch binary, hashes binary, counts binary"), "lexical-index")


class Batch:
    """Items of one pass: their different terms, weights, and which items hold which terms how often."""

    def __init__(self, ids: list, texts: list[str | None]):
        found = [np.unique(term_hashes(t), return_counts=True) for t in texts]
        self.ids = ids
        self.hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in found]]))
        self.starts = np.cumsum([0] + [len(h) for h, _ in found])
        self.places = np.searchsorted(self.hashes, np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in found]]))
        self.repeats = np.concatenate([np.zeros(0, np.int64), *[n for _, n in found]])
        self.weights = np.zeros(len(self.hashes), np.int64)
        self.docs = self.words = 0

    def weigh(self, found: dict[int, int], docs: int, words: int) -> None:
        """Take over the corpus statistics: per place of a term the documents that hold it; documents with terms, all terms."""
        self.docs, self.words = docs, words
        for place, n in found.items():
            self.weights[place] = math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1)))

    def factor(self, n: int) -> int:
        return 100 - 75 + (75 * n * self.docs) // self.words

    def bounds(self, sketch_: np.ndarray, m: int) -> np.ndarray:
        """No item's score with the sketched document is above its bound."""
        earned = np.append(impacts(np.arange(MOST), m), UNIT // 1000)
        slots = (self.hashes >> np.uint64(64 - len(sketch_).bit_length())).astype(np.int64)
        return self._sums(self.weights * earned[sketch_[slots >> 1] >> ((slots & 1) * 4).astype(np.uint8) & MOST])

    def _sums(self, worth: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(worth[self.places] * self.repeats)))
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def score(self, item: int, hashes: np.ndarray, counts: np.ndarray, m: int) -> int:
        places = self.places[self.starts[item] : self.starts[item + 1]]
        wanted = self.hashes[places]
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        held = hashes[at] == wanted
        worth = self.weights[places[held]] * impacts(counts[at[held]], m)
        return int((worth * self.repeats[self.starts[item] : self.starts[item + 1]][held]).sum())


def _holders(sent):
    """(place, n): in how many documents of a batch each term of the items is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = unship(sent)
        total = np.zeros(len(items.hashes), np.int64)
        for batch in batches:
            for blob in batch.column("hashes"):
                hashes = np.frombuffer(blob.as_py(), np.uint64)
                if len(hashes) and len(items.hashes):
                    at = np.minimum(np.searchsorted(items.hashes, hashes), len(items.hashes) - 1)
                    total[at[items.hashes[at] == hashes]] += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["place", "n"])

    return run


def _order(found: tuple[int, object]) -> tuple:
    score, doc_id = found
    return -score, doc_id is None, doc_id if doc_id is not None else 0


def _search(sent, top: int, id_types: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best documents of the task's part of the index for every item."""
        items = unship(sent)
        best: list[list[tuple[int, object]]] = [[] for _ in items.ids]
        least = np.ones(len(items.ids), np.int64)  # a document has to reach this to matter to the item
        step = max(1, CELLS // max(1, len(items.ids)))
        for batch in batches if len(items.hashes) else ():
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, sizes = part.column("doc_id").to_pylist(), part.column("n").to_pylist()
                factors = [items.factor(n) if n else 0 for n in sizes]
                bounds = np.zeros((part.num_rows, len(items.ids)), np.int64)
                for i, blob in enumerate(part.column("sketch")):
                    if sizes[i]:
                        bounds[i] = items.bounds(np.frombuffer(blob.as_py(), np.uint8), factors[i])
                held: dict[int, tuple] = {}
                for item in np.flatnonzero((bounds >= least).any(axis=0)).tolist():
                    rows = np.flatnonzero(bounds[:, item] >= least[item])
                    for row in rows[np.argsort(-bounds[rows, item], kind="stable")].tolist():
                        if bounds[row, item] < least[item]:
                            break  # so are all that follow
                        if row not in held:
                            held[row] = unpacked(part.column("hashes")[row].as_py(), part.column("counts")[row].as_py())
                        score = items.score(item, *held[row], factors[row])
                        if score >= least[item]:
                            best[item] = sorted([*best[item], (score, ids[row])], key=_order)[:top]
                            if len(best[item]) == top:
                                least[item] = best[item][-1][0]
        rows = [(i, item_id, doc_id, score) for i, (item_id, found) in enumerate(zip(items.ids, best)) for score, doc_id in found]
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int32(), id_types[0], id_types[1], pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["number", "item_id", "doc_id", "score"])

    return run


def _id_type(df: DataFrame, column: str) -> pa.DataType:
    return df.select(column).limit(0).toArrow().schema.field(column).type


def search(indexed: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of the index with the highest scores above 0 for every row of `items`.

    `items` has item_id and text; other columns are ignored. Equal scores rank by ascending doc_id, NULL last. Items
    without terms have no rows; items that are there twice come out twice. Statistics are exact and count every
    document of the index. Items are taken ITEMS at a time: their terms' document counts come from one pass,
    the best documents from another, in which each task reads its sketches and scores exactly, in descending
    order of the bounds, until none reaches the item's best so far. A task passes on `top` rows an item.
    """
    spark = indexed.sparkSession
    total = indexed.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    dealt = items.select("item_id", "text").where("text IS NOT NULL")
    n_parts = -(-dealt.count() // ITEMS)
    kinds = items.schema["item_id"].dataType.simpleString(), indexed.schema["doc_id"].dataType.simpleString()
    schema = f"number int, item_id {kinds[0]}, doc_id {kinds[1]}, score long"
    found = spark.createDataFrame([], schema).withColumn("part", F.lit(0))
    if n_parts and total["docs"]:
        dealt = scratch_table(dealt.repartition(n_parts).withColumn("part", F.spark_partition_id()), "items")
        id_types = _id_type(items, "item_id"), _id_type(indexed, "doc_id")
        for part in range(n_parts):
            rows = dealt.where(F.col("part") == part).collect()  # about ITEMS rows
            batch = Batch([r["item_id"] for r in rows], [r["text"] for r in rows])
            holders = indexed.select("hashes").mapInArrow(_holders(ship(spark, batch)), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
            batch.weigh({r["place"]: r["n"] for r in holders.collect()}, total["docs"], total["words"])  # one row a term of these items
            best = indexed.mapInArrow(_search(ship(spark, batch), top, id_types), schema).withColumn("part", F.lit(part))
            found = found.unionByName(scratch_table(best, "best"))
    ranks = Window.partitionBy("part", "number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
