"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped by workers."""

from __future__ import annotations

import os
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.shared import scratch_table, shared_folder, ship, unship, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text looked at together, and n-grams a task holds before it sends them on.
PIECE = 2 << 20
HELD = 3_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
END = np.uint64(0x243F6A8885A308D3)


# --- words as hashes -----------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values, which makes sorted arrays of them evenly spread."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def unmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31) ^ x >> np.uint64(62)) * np.uint64(0x319642B2D24D8EC3)
    x = (x ^ x >> np.uint64(27) ^ x >> np.uint64(54)) * np.uint64(0x96DE1B173F119089)
    return x ^ x >> np.uint64(30) ^ x >> np.uint64(60)


def _hash_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each blank-separated word of `data`, letters A-Z lowered; `first` are bytes at which texts begin."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.empty(len(data), bool)
    begins[:1], begins[1:] = True, blank[:-1]
    begins[first[first < len(data)]] = True
    starts = np.flatnonzero(begins & ~blank)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    data, blank = data[starts[0] :], blank[starts[0] :]
    lengths = np.diff(np.append(starts, starts[0] + len(data)))
    powers = np.multiply.accumulate(np.full(int(lengths.max()), BASE))
    values = (data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))).astype(np.uint64) + np.uint64(1)
    values[blank] = 0
    place = np.arange(len(data)) - np.repeat(starts - starts[0], lengths)
    values *= powers[place]
    return mix(np.add.reduceat(values, starts - starts[0])), starts


def token_groups(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, word hashes, words per text) for successive groups of texts. NULL is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        data, bounds = whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        hashes, places, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        while start < len(data):  # a text longer than a piece is cut before a blank
            stop = min(len(data), start + 2 * PIECE)
            while stop < len(data) and data[stop] != 32 and not 9 <= data[stop] <= 13:
                stop += 1
            h, s = _hash_words(data[start:stop], bounds[(bounds >= start) & (bounds < stop)] - start)
            hashes.append(h)
            places.append(s + start)
            start = stop
        counts = np.bincount(np.searchsorted(bounds, np.concatenate(places), "right") - 1, minlength=to - at)
        yield at, np.concatenate(hashes), counts[: to - at]
        at = to


# --- sorted runs ---------------------------------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as bytes, same-place bytes together, compressed."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        raw = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes()
        small = pa.compress(raw, "zstd", asbytes=True)
        out += [struct.pack("<2sQQ", a.dtype.str[1:].encode(), len(a), len(small)), small]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    arrays, at = [], 1
    for _ in range(data[0]):
        kind, n, size = struct.unpack_from("<2sQQ", data, at)
        at += struct.calcsize("<2sQQ")
        kind = np.dtype(kind.decode())
        raw = pa.decompress(data[at : at + size], n * kind.itemsize, "zstd", asbytes=True) if n else b""
        arrays.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel())
        at += size
    return arrays


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts[order], starts)


class Counter:
    """Counts of 64-bit keys in sorted runs; those of one shard (by a key's top bits) go out as one row."""

    def __init__(self, bits: int):
        self.bits, self.runs, self.size = bits, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(keys, return_counts=True)
        self.runs.append((found, n))
        self.size += len(found)
        if self.size > HELD:
            self.runs = [summed(*map(np.concatenate, zip(*self.runs)))]
            self.size = len(self.runs[0][0])
            if 2 * self.size > HELD:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.runs:
            return
        keys, counts = summed(*map(np.concatenate, zip(*self.runs)))
        self.runs, self.size = [], 0
        cuts = shard_cuts(keys, self.bits)
        full = np.flatnonzero(np.diff(cuts))
        packed = []
        for s in full:
            part = keys[cuts[s] : cuts[s + 1]]
            packed.append(pack(np.concatenate((part[:1], np.diff(part))), counts[cuts[s] : cuts[s + 1]]))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(packed, pa.binary())], names=["shard", "run"])


def merged(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(r) for r in runs]
    return summed(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts]), np.concatenate([c for _, c in parts]))


def shard_cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard of the sorted `keys` begins, and the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _save(folder: str, name: str, array: np.ndarray) -> str:
    """Each attempt writes a file of its own; the manifest names those of attempts that ended well."""
    path = os.path.join(folder, f"{name}-{uuid.uuid4().hex}.npy")
    np.save(path, array)
    return path


def _mapped(path: str) -> np.ndarray:
    cache = worker_cache("mapped")
    if path not in cache:
        cache[path] = np.load(path, mmap_mode="r")
    return cache[path]


# --- the model -----------------------------------------------------------------------------------

@dataclass
class Model:
    """Paths of the arrays and the few numbers that belong to the whole; a row per shard, none per word.

    vocabulary: (first id, hashes, counts) per shard; ids are ranks in the sorted word hashes, then
    `unknown` and `begin`. bigrams: (hashes of id pairs, counts) per shard or None. statistics: per range
    of ids, after how many words a word's bigrams occur once, twice, more often, and how many words it follows.
    """

    bits: int
    words: int = 0
    tokens: int = 0
    texts: int = 0
    vocabulary: list = field(default_factory=list)
    bigrams: list = field(default_factory=list)
    statistics: list = field(default_factory=list)
    width: int = 1
    kinds: int = 0
    discounts: tuple = (0.0, 0.5, 1.0, 1.5)
    lower_discounts: tuple = (0.0, 0.5, 1.0, 1.5)
    lower_counts: tuple = (0, 0, 0)

    @property
    def unknown(self) -> int:
        return self.words

    @property
    def begin(self) -> int:
        return self.words + 1

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each word hash; the unknown word's id and 0 for others."""
        order = np.argsort(hashes)
        keys = hashes[order]
        ids, counts = np.full(len(keys), self.unknown, np.int64), np.zeros(len(keys), np.int64)
        cuts = shard_cuts(keys, self.bits)
        for shard in np.flatnonzero(np.diff(cuts)):
            if self.vocabulary[shard] is None:
                continue
            first, known, n = self.vocabulary[shard]
            a, b = cuts[shard], cuts[shard + 1]
            known, n = _mapped(known), _mapped(n)
            at = np.minimum(np.searchsorted(known, keys[a:b]), len(known) - 1)
            hit = known[at] == keys[a:b]
            ids[a:b][hit] = at[hit] + first
            counts[a:b][hit] = n[at[hit]]
        out_ids, out_counts = np.empty_like(ids), np.empty_like(counts)
        out_ids[order], out_counts[order] = ids, counts
        return out_ids, out_counts

    def pairs(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Counts of the bigrams."""
        keys = mix(before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64))
        order = np.argsort(keys)
        keys = keys[order]
        found = np.zeros(len(keys), np.int64)
        cuts = shard_cuts(keys, self.bits)
        for shard in np.flatnonzero(np.diff(cuts)):
            if self.bigrams[shard] is None:
                continue
            known, n = map(_mapped, self.bigrams[shard])
            part = keys[cuts[shard] : cuts[shard + 1]]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            found[cuts[shard] : cuts[shard + 1]] = np.where(known[at] == part, n[at], 0)
        out = np.empty_like(found)
        out[order] = found
        return out

    def statistics_of(self, ids: np.ndarray) -> np.ndarray:
        """A row (n1, n2, n3+, words it follows) per id; `ids` in any order."""
        out = np.zeros((len(ids), 4), np.int64)
        ranges = ids // self.width
        for r in np.unique(ranges):
            if self.statistics[r] is not None:
                own = ranges == r
                out[own] = _mapped(self.statistics[r])[ids[own] - r * self.width]
        return out

    def ids_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the distinct words, their ids, their counts) for a group's hashes and, at the end, END."""
        places, distinct = pd.factorize(np.append(hashes, END))
        return places, *self.look_up(distinct)

    def score(self, hashes: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of a group of texts: word hashes of all, and words per text."""
        places, ids, counts = self.ids_of(hashes)
        sizes = words + 1
        ends = np.cumsum(sizes)
        starts = ends - sizes
        last = np.zeros(int(ends[-1]), bool)
        last[ends - 1] = True
        token = np.empty(len(last), np.int64)
        token[~last], token[last] = places[:-1], places[-1]
        count = counts[token]
        stats = self.statistics_of(np.append(ids, self.begin))
        follow, lower = stats[:-1, 3], np.asarray(self.lower_discounts)
        one, two, many = self.lower_counts
        uniform = 1 / (self.words + 1)
        if self.kinds:
            left = (lower[1] * one + lower[2] * two + lower[3] * many) / self.kinds
            unigram = np.maximum(follow - lower[np.minimum(follow, 3)], 0) / self.kinds + left * uniform
        else:
            unigram = np.full(len(ids), uniform)
        context = np.empty(len(token), np.int64)  # place of the word before; beyond the last place: the text's beginning
        context[1:], context[starts] = token[:-1], len(ids)
        context_ids, context_count = np.append(ids, self.begin), np.append(counts, self.texts)
        discount = np.asarray(self.discounts)
        back_off = stats[:, :3] @ discount[1:] / np.maximum(context_count, 1)
        back_off[context_count == 0] = 1.0
        pair = self.pairs(context_ids[context], ids[token])
        top = (pair - discount[np.minimum(pair, 3)]) / np.maximum(context_count[context], 1)
        probability = np.maximum(top, 0) + back_off[context] * unigram[token]
        base = (count + 0.1) / (self.tokens + 0.1 * (self.words + 1))
        return {
            "n_tokens": sizes, "n_known": np.add.reduceat((count > 0).astype(np.int64), starts),
            "base_score": np.add.reduceat(np.log10(base), starts), "score": np.add.reduceat(np.log10(probability), starts),
        }


def discounts_of(n: list[int]) -> tuple[float, float, float, float]:
    """Modified Kneser-Ney discounts from how many n-grams occur once, twice, three and four times.

    Where such a count is zero, as on tiny texts, the usual fixed values 0.5, 1 and 1.5 stand in.
    """
    one, two, three, four = n
    if not (one and two and three):
        return 0.0, 0.5, 1.0, 1.5
    y = one / (one + 2 * two)
    found = (1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three)
    return 0.0, *(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(bits)
        for batch in batches:
            for _, hashes, words in token_groups(batch.column("text")):
                yield from counter.add(np.concatenate((hashes, np.full(len(words), END))))
        yield from counter.flush()

    return run


def _write_words(folder: str):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        hashes, counts = merged(rows.column("run").to_pylist())
        shard = key[0].as_py()
        return pa.table({
            "shard": pa.array([shard], pa.int32()), "hashes": [_save(folder, f"words-{shard}", hashes)],
            "counts": [_save(folder, f"counts-{shard}", counts)], "words": [len(hashes)], "tokens": [int(counts.sum())],
        })

    return run


def _count_pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unship(shared)
        counter = Counter(model.bits)
        for batch in batches:
            for _, hashes, words in token_groups(batch.column("text")):
                places, ids, _ = model.ids_of(hashes)
                ends = np.cumsum(words + 1)
                last = np.zeros(int(ends[-1]), bool)
                last[ends - 1] = True
                token, before = np.empty(len(last), np.uint64), np.empty(len(last), np.uint64)
                token[~last], token[last] = ids[places[:-1]], ids[places[-1]]
                before[1:], before[ends - words - 1] = token[:-1], model.begin
                yield from counter.add(mix(before << np.uint64(32) | token))
        yield from counter.flush()

    return run


def _per_range(ids: np.ndarray, rows: np.ndarray, width: int) -> dict[int, bytes]:
    """Packed (id, values...) of the sorted `ids` by range of ids."""
    out = {}
    ranges = ids // width
    starts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1]))) if len(ids) else np.zeros(0, np.int64)
    for a, b in zip(starts, np.append(starts[1:], len(ids))):
        out[int(ranges[a])] = pack(np.concatenate((ids[a : a + 1], np.diff(ids[a:b]))), *(r[a:b].astype(np.int32) for r in rows))
    return out


def _write_pairs(folder: str, width: int):
    """A shard's bigrams go to its files; what they say about words goes on, by range of ids."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        hashes, counts = merged(rows.column("run").to_pylist())
        shard = key[0].as_py()
        pairs = unmix(hashes)
        before, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.argsort(before, kind="stable")
        ids, starts = np.unique(before[order], return_index=True)
        often = np.minimum(counts[order], 3)
        contexts = _per_range(ids, np.stack([np.add.reduceat((often == k).astype(np.int64), starts) for k in (1, 2, 3)]), width)
        ids, n = np.unique(word, return_counts=True)
        follows = _per_range(ids, n[None, :], width)
        ranges = sorted(contexts.keys() | follows.keys())
        paths = [_save(folder, f"pairs-{shard}", hashes), _save(folder, f"pair-counts-{shard}", counts.astype(np.min_scalar_type(int(counts.max()))))]
        seen = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()
        n = len(ranges)
        return pa.table({
            "shard": pa.array([shard] * n, pa.int32()), "hashes": [paths[0]] * n, "counts": [paths[1]] * n, "seen": pa.array([seen] * n, pa.list_(pa.int64())),
            "range": pa.array(ranges, pa.int64()), "contexts": pa.array([contexts.get(r) for r in ranges], pa.binary()),
            "follows": pa.array([follows.get(r) for r in ranges], pa.binary()),
        })

    return run


def _write_statistics(folder: str, width: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        number = key[0].as_py()
        table = np.zeros((width, 4), np.int64)
        for column, first in (("contexts", 0), ("follows", 3)):
            for run in rows.column(column).to_pylist():
                if run is not None:
                    ids, *values = unpack(run)
                    at = np.cumsum(ids) - number * width
                    for k, v in enumerate(values):
                        table[at, first + k] += v
        seen = np.bincount(np.minimum(table[:, 3], 5), minlength=6)[1:5].tolist()
        return pa.table({
            "number": pa.array([number], pa.int64()), "path": [_save(folder, f"statistics-{number}", table.astype(np.uint32 if table.max() < 1 << 32 else np.int64))],
            "seen": pa.array([seen], pa.list_(pa.int64())), "kinds": [int(table[:, 3].sum())], "words": [int((table[:, 3] > 0).sum())],
        })

    return run


def fit(texts: DataFrame) -> Model:
    """Count `texts` (text) and write the model's arrays to the shared folder.

    Tasks send sorted runs of hashes, one per shard of the hash space; each shard's runs are merged and
    written as sorted arrays. There are as many shards as shuffle partitions, so a shard's size is that of
    any other shuffle partition, however frequent a word or pair is: its count is one entry. The driver
    sees one row per shard. At most 2^32 - 2 different words.
    """
    spark = texts.sparkSession
    texts = texts.select("text")
    bits = max(0, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    folder = shared_folder(spark, "ngrams")
    runs = texts.mapInArrow(_count_words(bits), "shard int, run binary")
    found = runs.groupBy("shard").applyInArrow(_write_words(folder), "shard int, hashes string, counts string, words long, tokens long")
    model = Model(bits, vocabulary=[None] * (1 << bits), bigrams=[None] * (1 << bits))
    for row in sorted(found.collect()):
        model.vocabulary[row["shard"]] = (model.words, row["hashes"], row["counts"])
        model.words += row["words"]
        model.tokens += row["tokens"]
    if model.words > (1 << 32) - 2:
        raise ValueError("the vocabulary exceeds 2^32 - 2 words")
    model.width = max(1, -(-(model.words + 2) >> bits))
    model.statistics = [None] * (1 << bits)
    if not model.words:
        return model

    runs = texts.mapInArrow(_count_pairs(ship(spark, model)), "shard int, run binary")
    written = scratch_table(runs.groupBy("shard").applyInArrow(
        _write_pairs(folder, model.width), "shard int, hashes string, counts string, seen array<long>, range long, contexts binary, follows binary"
    ), "pairs")
    seen = np.zeros(4, np.int64)
    for row in written.select("shard", "hashes", "counts", "seen").distinct().collect():
        model.bigrams[row["shard"]] = (row["hashes"], row["counts"])
        seen += row["seen"]
    model.discounts = discounts_of(seen.tolist())
    about = written.select("range", "contexts", "follows").groupBy("range").applyInArrow(
        _write_statistics(folder, model.width), "number long, path string, seen array<long>, kinds long, words long"
    )
    lower, following = np.zeros(4, np.int64), 0
    for row in about.collect():
        model.statistics[row["number"]] = row["path"]
        lower += row["seen"]
        model.kinds += row["kinds"]
        following += row["words"]
    model.lower_discounts = discounts_of(lower.tolist())
    model.lower_counts = (int(lower[0]), int(lower[1]), int(following - lower[0] - lower[1]))
    model.texts = texts.count()
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unship(shared)
        for batch in batches:
            found = [model.score(hashes, words) for _, hashes, words in token_groups(batch.column("text"))]
            names = [n for n in batch.schema.names if n != "text"]
            columns = [batch.column(n) for n in names]
            for n in ("n_tokens", "n_known", "base_score", "score"):
                columns.append(pa.array(np.concatenate([f[n] for f in found]) if found else np.zeros(0, float if "score" in n else int)))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `text` replaced by n_tokens, n_known, base_score and score (log10 of the text's probability).

    Tokens are the words and one end; a NULL or blank text is the end alone. Workers map the model's
    files and touch the pages they need. Perplexity is 10 ** (-score / n_tokens).
    """
    shared = ship(docs.sparkSession, model)
    kept = docs.drop("n_tokens", "n_known", "base_score", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text")
    return kept.mapInArrow(_score(shared), f"{fields}, n_tokens long, n_known long, base_score double, score double")


def perplexity(log10_probability: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -log10_probability / n_tokens)
