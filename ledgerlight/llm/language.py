"""Language identification with a bit-sliced Bloom filter of character n-grams."""

from __future__ import annotations

import math
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ledgerlight.llm.shared import remainder, scratch_table, shared_folder, ship, unship, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
#: Fewest slots; more are taken until the language with the most n-grams has FALSE_RATE or less.
SLOTS = 1 << 18
HASHES = 4
FALSE_RATE = 0.01
#: A filter of more 64-bit words than this isn't sent but mapped from the shared folder.
SENT = 1 << 21
#: Most words of a filter: 16 GB, or 2^27 n-grams of a language at FALSE_RATE while there are 64 languages or fewer.
MOST = 1 << 31
#: Slots written by one task, a power of two.
PART = 1 << 18
#: An n-gram belongs to a language if it is at least this share as frequent there as where it is most frequent.
SHARE = 0.25
LEAST = 2
#: Characters looked at together.
PIECE = 1 << 19


def _letters() -> np.ndarray:
    cache = worker_cache("letters")
    if not cache:
        cache[0] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return cache[0]


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram codes, text number of each) of pieces of the texts, lower case.

    Every letter gives one n-gram: itself between its neighbours, of which those that aren't letters count
    as blanks. Long texts are cut, with one character of context on both sides, so that no n-gram is lost.
    """
    letters = _letters()
    held, owners, size = [], [], 0

    def flush():
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), "<u4")
        letter = letters[codes]
        codes = np.where(letter, codes, 32).astype(np.uint64)
        ends = np.cumsum(lengths)
        letter[ends - 1] = letter[ends - lengths] = False
        at = np.flatnonzero(letter)
        grams = codes[at - 1] << np.uint64(42) | codes[at] << np.uint64(21) | codes[at + 1]
        return grams, np.repeat(np.asarray(owners), lengths)[at]

    for number, text in enumerate(texts):
        text = f"\n{text.lower()}\n"
        for start in range(0, max(1, len(text) - 2), PIECE):
            held.append(text[start : start + PIECE + 2])
            owners.append(number)
            size += len(held[-1])
            if size >= PIECE:
                yield flush()
                held, owners, size = [], [], 0
    if held:
        yield flush()


def slots_of(grams: np.ndarray, slots: int, hashes: int) -> np.ndarray:
    """The filter's slots of each n-gram, one row per hash function: h1 + i*h2 from one mixed 64-bit value."""
    x = grams * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    step = x >> np.uint64(33) | np.uint64(1)
    return np.stack([((x + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(hashes)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _letters()  # before a batch comes: what another operator has left in this worker goes first
    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            for grams, _ in _pieces([t for t, one in zip(texts, langs) if one == lang]):
                found, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def _mark(slots: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = slots_of(np.asarray(batch.column("gram")).view(np.uint64), slots, hashes)
            columns = {"slot": at.ravel(), "word": np.tile(np.asarray(batch.column("word")), hashes), "mask": np.tile(np.asarray(batch.column("mask")), hashes)}
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    return run


def _words_of(languages: list[str]) -> int:
    return max(1, -(-len(languages) // 64))


def slots_for(ngrams: int, hashes: int = HASHES, rate: float = FALSE_RATE) -> int:
    """Fewest slots, as a power of two, at which `ngrams` n-grams give a false positive rate of `rate` or less."""
    need = -hashes * ngrams / math.log(1 - rate ** (1 / hashes))
    return 1 << math.ceil(math.log2(max(1.0, need)))


def _put(path: str, shape: tuple[int, int]):
    """Writes cells of the filter into its file; a task has whole parts of it to itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.memmap(path, np.uint64, "r+", shape=shape)
        for batch in batches:
            table[np.asarray(batch.column("slot")), np.asarray(batch.column("word"))] = np.asarray(batch.column("mask")).view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("slot")], names=["slot"])
        table.flush()

    return run


class Model:
    """languages in code point order, and the filter: slots x words of 64 language bits, or the path of its file."""

    def __init__(self, languages: list[str], table: np.ndarray | str, hashes: int):
        self.languages, self.hashes = languages, hashes
        self.path = table if isinstance(table, str) else None
        self.table = self._mapped() if self.path else table
        filled = np.zeros(len(languages))
        for at in range(0, len(self.table), PART):
            part = self.table[at : at + PART]
            filled += [np.count_nonzero(part[:, i // 64] & np.uint64(1 << i % 64)) for i in range(len(languages))]
        self.false_rate = (filled / max(1, len(self.table))) ** hashes

    def _mapped(self) -> np.ndarray:
        return np.memmap(self.path, np.uint64, "r").view(np.ndarray).reshape(-1, _words_of(self.languages))

    def __getstate__(self) -> dict:
        return self.__dict__ | ({"table": None} if self.path else {})

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.path:
            self.table = self._mapped()

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Languages that may contain each n-gram: the AND of its slots."""
        at = slots_of(grams, len(self.table), self.hashes)
        out = self.table[at[0]]
        for row in at[1:]:
            out &= self.table[row]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. The score is the language's share of all corrected counts."""
        n = len(texts)
        total, counts = np.zeros(n), np.zeros((n, len(self.languages)))
        for grams, owner in _pieces([t or "" for t in texts]):
            if not len(grams):
                continue
            total += np.bincount(owner, minlength=n)
            masks = self.hits(grams)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            for i in range(len(self.languages)):
                bit = (masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64)
                counts[owner[starts], i] += np.add.reduceat(bit, starts)
        # Of n-grams that aren't the language's, the filter still returns the false positive rate.
        true = np.maximum(0, (counts - total[:, None] * self.false_rate) / (1 - np.minimum(self.false_rate, 0.999)))
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        best, whole = true.argmax(axis=1), true.sum(axis=1)
        score = np.where(whole > 0, true.max(axis=1) / np.where(whole > 0, whole, 1), 0.0)
        score = np.where((total > 0) & (whole == 0), 1 / len(self.languages), score)
        names = [self.languages[b] if t > 0 else UNKNOWN for b, t in zip(best, total)]
        return names, np.where(total > 0, score, 0.0)


def fit(docs: DataFrame, slots: int = SLOTS, hashes: int = HASHES, share: float = SHARE, least: int = LEAST) -> Model:
    """Learn from `docs` (text, lang), all rows with both. The filter has `slots` rows (a power of two) for every 64
    languages, or as many more as the language with the most n-grams needs for FALSE_RATE. The driver gets a
    filter of up to SENT words; a larger one is written by the executors to the shared folder. Over MOST words
    is an error."""
    counts = scratch_table(
        docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngrams",
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = [r["lang"] for r in totals.select("lang").orderBy("lang").collect()]
    numbers = docs.sparkSession.createDataFrame(list(enumerate(languages)), "number int, lang string")
    rates = counts.join(F.broadcast(totals.join(numbers, "lang")), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = F.max("rate").over(Window.partitionBy("gram"))
    owned = rates.withColumn("top", top).where((F.col("rate") >= share * F.col("top")) & (F.col("n") >= least))
    owned = scratch_table(owned.select("gram", "number"), "owned-ngrams")
    fullest = owned.groupBy("number").count().agg(F.max("count")).first()[0] or 0
    slots, width = max(slots, slots_for(fullest, hashes)), _words_of(languages)
    if slots * width > MOST:
        raise ValueError(f"{fullest} n-grams of one of {len(languages)} languages need a filter of {slots * width} words; {MOST} are the most")
    masks = owned.groupBy("gram", F.floor(F.col("number") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number") % 64)).alias("mask")
    )
    marked = masks.mapInArrow(_mark(slots, hashes), "slot long, word int, mask long")
    filled = marked.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    if slots * width > SENT:
        path = os.path.join(shared_folder(docs.sparkSession, "filter"), "filter")
        with open(path, "wb") as file:
            file.truncate(8 * slots * width)
        put = filled.repartition(F.floor(F.col("slot") / PART)).mapInArrow(_put(path, (slots, width)), "slot long")
        put.write.format("noop").mode("overwrite").save()
        return Model(languages, path, hashes)
    filled = filled.toPandas()
    table = np.zeros((slots, width), np.uint64)
    table[filled["slot"].to_numpy(np.int64), filled["word"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    return Model(languages, table, hashes)


def _predict(model, columns: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = unship(model)
        for batch in batches:
            names, scores = filters.predict(batch.column("text").to_pylist())
            kept = [batch.column(i) for i in range(batch.num_columns)]  # by place: names may differ in case only
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores)], names=[*batch.schema.names, *columns])

    return run


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with the predicted language and its score appended as `names`, replacing columns of these names.

    A text that is NULL or has no letter is `und` with score 0; if no n-gram of a text is known, the first
    language gets an equal share as score. The filter is broadcast, or mapped if it is large.
    """
    shared = ship(docs.sparkSession, model)
    kept = docs.drop(*names)
    schema = StructType([*kept.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return kept.mapInArrow(_predict(shared, names), schema)


def fold(docs: DataFrame, modulus: int = 3, held: int = 1):
    """Column: is the document held out from learning?"""
    return remainder(docs["doc_id"], modulus) == held
