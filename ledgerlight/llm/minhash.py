"""MinHash fingerprints: universal hash permutations over word shingles, bands joined in Spark, Jaccard verified.

Words are blank-separated runs, A-Z lower-cased; a shingle is five of them, a shorter text is one shingle,
a text without words has none. A shingle's 64 bits are a multilinear hash of its words' XXH64. A permutation
is a multiply-add-shift function (universal on 32-bit values); a fingerprint holds, for each of them, 8 bits
of a hash of the text's least value (b-bit MinHash), so likeness is corrected for values that agree by chance.
"""

from __future__ import annotations

import hashlib
import os
import sys
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.components import connected_components
from ledgerlight.llm.shared import scratch_table, shared_folder, small, text_parts, worker_cache
from ledgerlight.llm.simhash import rooted_groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: A pair of similarity s shares no band with probability (1 - s**ROWS)**BANDS: 5e-8 at 0.8.
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
CHANCE = 1 / 256
#: Pairs whose fingerprints agree in a share this much below the threshold aren't verified: it passes over one in 7e8 at 0.8.
MARGIN = 0.25
#: Members of one band that a task takes from one side; larger bands are compared part by part.
PART = 4096
#: Shingles hashed together, shingles compared together.
CHUNK, PIECE = 1 << 14, 1 << 18
#: Bytes of text whose words and shingles a worker holds together: they take about ten times as much.
TEXT_BYTES = 1 << 20
EMPTY = np.full(PERMUTATIONS, 0xFF, np.uint8)
BLANKS = " \t\n\x0b\x0c\r"


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors and shifts of the permutations, odd factors of a shingle's words."""
    rng = np.random.default_rng(SEED)
    factors, shifts = rng.integers(0, 2**64, (2, PERMUTATIONS), dtype=np.uint64)
    return factors | np.uint64(1), shifts, rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(found: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the texts' words, one text after another."""
    counts = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(found), repeat(SEED)), np.uint64, int(counts.sum())), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the shingles of the texts one after another, repeats included, and how many each text has."""
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))  # words from here to the text's end
    sums = np.minimum(left, width).astype(np.uint64)
    for k, factor in enumerate(_draws()[2][:width]):
        there = np.flatnonzero(left > k)
        sums[there] += hashes[there + k] * factor
    return _mixed(sums[left >= np.repeat(np.minimum(counts, width), counts)]), np.where(counts, np.maximum(counts - width + 1, 1), 0)


def shingles_of(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*word_hashes([words(t or "") for t in texts]), width)


def fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of PERMUTATIONS bytes per text; EMPTY for a text without shingles."""
    factors, shifts, _ = _draws()
    out = np.tile(EMPTY, (len(sizes), 1))
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[full])
    least = np.empty((PERMUTATIONS, len(full)), np.uint64)
    at = 0
    while at < len(full):
        start = ends[at] - sizes[full[at]]
        stop = max(at + 1, int(np.searchsorted(ends, start + CHUNK, "right")))
        values = hashes[start : ends[stop - 1]] >> np.uint64(32)
        firsts = np.concatenate(([0], ends[at : stop - 1] - start))
        moved = np.empty_like(values)
        for k in range(PERMUTATIONS):
            np.multiply(values, factors[k], out=moved)
            moved += shifts[k]
            least[k, at:stop] = np.minimum.reduceat(moved, firsts)
        at = stop
    # A long text's least values are all small; their top bits alone would agree by chance.
    out[full] = (_mixed(least >> np.uint64(32)) >> np.uint64(56)).T.astype(np.uint8)
    return out


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """An estimate of the Jaccard similarity of the texts' shingles, row by row: 1.0 for equal fingerprints."""
    return np.maximum(0.0, ((one == other).mean(axis=1) - CHANCE) / (1 - CHANCE))


def set_key(found: np.ndarray) -> int:
    """64 bits (signed) that name a sorted set of shingles; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64)) if len(found) else 0


def sets(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return [np.unique(part) for part in np.split(hashes, np.cumsum(sizes)[:-1])] if len(sizes) else []


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, TEXT_BYTES):
                hashes, sizes = shingles_of(part.column("text").to_pylist(), width)
                keys = pa.array([set_key(s) for s in sets(hashes, sizes)], pa.int64())
                columns = [part.column("doc_id"), part.column("text_key"), keys, _binary(fingerprints(hashes, sizes))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "fp", "signature"])

    return run


def signatures(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp, signature) per row of `docs`: a hash of the text, one of its shingle set, the fingerprint's bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        _sign(width), f"doc_id {kind}, text_key long, fp long, signature binary")


# --- fingerprints of texts and of their edited versions ------------------------------------------

SUCCESSIVE = [
    ("kind", "int", pa.int32()), ("shard", "int", pa.int32()), ("doc_id", None, None), ("text", "string", pa.string()), ("n_chars", "long", pa.int64()),
    ("signature", "binary", pa.binary()), ("edited_sha256", "binary", pa.binary()), ("edited_signature", "binary", pa.binary()),
    ("near_edited", "double", pa.float64()), ("near_next", "double", pa.float64()),
]
RESULT, FIRST, LAST = 0, 1, 2


def edited(text: str, following: str) -> str:
    """`text` with its last quarter (rounded down, in code points) replaced by the first as many of `following`."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _edited_hashes(text: str, hashes: np.ndarray, following: str) -> tuple[np.ndarray, str]:
    """The word hashes of the edited text, given those of `text`: only words after the last blank before the cut are hashed."""
    cut = len(text) // 4
    kept = len(text) - cut
    start = max(text.rfind(b, 0, kept) for b in BLANKS) + 1
    same = len(hashes) - len(words(text[start:]))
    tail = text[start:kept] + following[:cut]
    return np.concatenate((hashes[:same], word_hashes([words(tail)])[0])), text[:start] + tail


def _rows(kind: int, shard: int, id_type: pa.DataType, own: list[tuple], following: list[tuple] | None, width: int) -> pa.RecordBatch:
    """Rows (doc_id, text, word hashes, signature) with what their successors add to them."""
    n = len(own)
    columns = {
        "kind": [kind] * n, "shard": [shard] * n, "doc_id": [r[0] for r in own], "text": [r[1] if kind else None for r in own],
        "n_chars": [len(r[1]) for r in own], "signature": [r[3].tobytes() for r in own],
    }
    if following is not None and n:
        found = [_edited_hashes(a[1], a[2], b[1]) for a, b in zip(own, following)]
        prints = fingerprints(*shingles(np.concatenate([h for h, _ in found]), np.array([len(h) for h, _ in found]), width))
        signed, nexts = np.stack([r[3] for r in own]), np.stack([r[3] for r in following])
        columns |= {
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for _, t in found],
            "edited_signature": [row.tobytes() for row in prints],
            "near_edited": likeness(signed, prints), "near_next": likeness(signed, nexts),
        }
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), id_type if name == "doc_id" else t) for name, _, t in SUCCESSIVE], names=[s[0] for s in SUCCESSIVE])


def _signed_rows(ids: list, texts: list[str], width: int) -> list[tuple]:
    hashes, counts = word_hashes([words(t) for t in texts])
    return list(zip(ids, texts, np.split(hashes, np.cumsum(counts)[:-1]), fingerprints(*shingles(hashes, counts, width))))


def _successive(width: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows in order. Its last row waits for the next task's first one."""
        shard, held = TaskContext.get().partitionId(), []
        for batch in batches:
            for part in text_parts(batch):
                rows = _signed_rows(part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()], width)
                if not held:
                    yield _rows(FIRST, shard, id_type, rows[:1], None, width)
                rows = held + rows
                yield _rows(RESULT, shard, id_type, rows[:-1], rows[1:], width)
                held = rows[-1:]
        if held:
            yield _rows(LAST, shard, id_type, held, None, width)

    return run


def _across(width: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = _signed_rows([r["doc_id"]], [r["text"]], width)
                yield _rows(RESULT, -1, id_type, own, [(None, r["next_text"], None, np.frombuffer(r["next_signature"], np.uint8))], width)

    return run


def with_edits(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Fingerprints of every row's text and of that text edited with its successor's beginning.

    Returns (doc_id, n_chars, signature, edited_sha256, edited_signature, near_edited, near_next), hashes as bytes.
    Rows follow one another by doc_id, NULL ids first and rows of one id by their texts; the last is followed
    by the first. A NULL text counts as empty; its fingerprint is EMPTY, like only to its own kind. One shuffle
    brings the rows in order; what crosses from task to task is one row each, joined by the tasks' numbers.
    """
    kind = docs.schema["doc_id"].dataType
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    schema = ", ".join(f"{name} {t or kind.simpleString()}" for name, t, _ in SUCCESSIVE)
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    ordered = placed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    found = scratch_table(ordered.mapInArrow(_successive(width, id_type), schema), "successive")
    # One number per task that had rows: the driver links each to the next.
    shards = [r["shard"] for r in found.where(F.col("kind") == FIRST).select("shard").orderBy("shard").collect()]
    following = docs.sparkSession.createDataFrame(list(zip(shards, shards[1:] + shards[:1])), "shard int, next_shard int")
    firsts = found.where(F.col("kind") == FIRST).select(F.col("shard").alias("next_shard"), F.col("text").alias("next_text"), F.col("signature").alias("next_signature"))
    last = found.where(F.col("kind") == LAST).join(F.broadcast(following), "shard").join(firsts, "next_shard")
    result = found.where(F.col("kind") == RESULT).unionByName(last.drop("next_shard").mapInArrow(_across(width, id_type), schema))
    return result.drop("kind", "shard", "text")


# --- near duplicates ----------------------------------------------------------------------------


def _explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bands of every fingerprint but that of texts without words; a band's number is part of its hash."""
    for batch in batches:
        held = [(k, s.as_py()) for k, s in zip(batch.column("fp").to_pylist(), batch.column("signature")) if k != 0]
        rows = np.frombuffer(b"".join(s for _, s in held), f"<u{ROWS}").reshape(len(held), BANDS).astype(np.uint64)
        bands = _mixed(rows | np.arange(BANDS, dtype=np.uint64) << np.uint64(8 * ROWS))
        keys = np.repeat(np.array([k for k, _ in held], np.int64), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(bands.ravel().view(np.int64)), pa.array(keys)], names=["band", "fp"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by band, of bands with two or more members; every PART members of a band are a part of it."""
    band, seen, alone = None, 0, None
    for batch in batches:
        bands, keys = np.asarray(batch.column("band")), np.asarray(batch.column("fp"))
        if not len(bands):
            continue
        if alone is not None:
            bands, keys, alone, seen, band = np.append(alone[0], bands), np.append(alone[1], keys), None, 0, None
        starts = np.flatnonzero(np.concatenate(([True], bands[1:] != bands[:-1])))
        lengths = np.diff(np.append(starts, len(bands)))
        before = np.zeros(len(starts), np.int64)
        if bands[0] == band:
            before[0] = seen
        place = np.arange(len(bands)) - np.repeat(starts - before, lengths)
        kept = np.repeat(lengths + before > 1, lengths)
        band, seen = bands[-1], int(lengths[-1] + before[-1])
        if seen == 1:
            alone = bands[-1:], keys[-1:]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bands[kept]), pa.array(keys[kept]), pa.array((place[kept] // PART).astype(np.int32))], names=["band", "fp", "part"])


def _write_sets(folder: str, width: int):
    """Fingerprints and sets of the texts go one after another to a file of the task's own; rows tell where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at = uuid.uuid4().int >> 65, 0
        with open(os.path.join(folder, f"{name}.sets"), "wb") as file:
            for batch in batches:
                for part in text_parts(batch, TEXT_BYTES):
                    hashes, sizes = shingles_of(part.column("text").to_pylist(), width)
                    keys, starts, lengths = [], [], []
                    for found, signature in zip(sets(hashes, sizes), fingerprints(hashes, sizes)):
                        file.write(signature)
                        file.write(found)
                        keys.append(set_key(found))
                        starts.append(at)
                        lengths.append(len(found))
                        at += len(found) + PERMUTATIONS // 8
                    columns = [pa.array(c, pa.int64()) for c in (keys, [name] * len(keys), starts, lengths)]
                    yield pa.RecordBatch.from_arrays(columns, names=["fp", "file", "start", "size"])

    return run


def linked(members: list[np.ndarray], prints: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (i, j) of sets as similar as `threshold`, enough to connect all that chains of them connect.

    Each set meets those not reached yet: by size and fingerprint first, which costs little for sets
    that are unlike, then by the whole sets.
    """
    sizes = np.fromiter(map(len, members), np.int64, len(members))
    agree = max(0.0, threshold - MARGIN) * prints.shape[1]
    links, rest = [], np.arange(len(members))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.zeros(len(rest), bool)
            # Sets whose sizes differ more can't be as similar.
            fit = np.flatnonzero(np.minimum(sizes[rest], sizes[one]) >= threshold * np.maximum(sizes[rest], sizes[one]) - 1e-9)
            fit = fit[(prints[rest[fit]] == prints[one]).sum(axis=1) >= agree]
            cuts = np.searchsorted(np.cumsum(sizes[rest[fit]]), np.arange(PIECE, int(sizes[rest[fit]].sum()) + 1, PIECE)) + 1
            for part in np.split(fit, np.unique(cuts)):
                if not len(part):
                    continue
                other = sizes[rest[part]]
                flat = np.concatenate([members[i] for i in rest[part]])
                at = np.minimum(np.searchsorted(members[one], flat), sizes[one] - 1)
                shared = np.add.reduceat((members[one][at] == flat).astype(np.int64), np.cumsum(other) - other)
                near[part] = shared >= threshold * (sizes[one] + other - shared) - 1e-9
            reached = rest[near].tolist()
            links += [(one, j) for j in reached]
            queue += reached
            rest = rest[~near]
    return links


def _verify(folder: str, threshold: float):
    def links_of(held: list[dict]) -> pa.RecordBatch:
        files = worker_cache(f"sets of {folder}")
        columns = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        ends = np.flatnonzero((np.diff(columns["band"]) != 0) | (np.diff(columns["block"]) != 0)) + 1
        a, b = [], []
        for rows in np.split(np.arange(len(columns["band"])), ends):
            members, prints = [], []
            for name, start, size in zip(columns["file"][rows].tolist(), columns["start"][rows].tolist(), columns["size"][rows].tolist()):
                if name not in files:
                    files[name] = np.memmap(os.path.join(folder, f"{name}.sets"), "<u8", "r")
                at = start + PERMUTATIONS // 8
                prints.append(np.asarray(files[name][start:at]).view(np.uint8))
                members.append(np.asarray(files[name][at : at + size]))
            links = linked(members, np.stack(prints), threshold)
            a += [int(columns["fp"][rows[i]]) for i, _ in links]
            b += [int(columns["fp"][rows[j]]) for _, j in links]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by band and block; the last group of a batch may go on in the next one."""
        held = []
        for batch in batches:
            rows = {c: np.asarray(batch.column(c)) for c in batch.schema.names}
            if not batch.num_rows:
                continue
            last = (rows["band"] == rows["band"][-1]) & (rows["block"] == rows["block"][-1])
            cut = int(np.argmax(last))
            if cut or held and (held[-1]["band"][-1], held[-1]["block"][-1]) != (rows["band"][-1], rows["block"][-1]):
                yield links_of([*held, {c: v[:cut] for c, v in rows.items()}])
                held, rows = [], {c: v[cut:] for c, v in rows.items()}
            held.append(rows)
        if held:
            yield links_of(held)

    return run


def _blocks(buckets: DataFrame) -> DataFrame:
    """(band, fp, block): a band of one part is one block, one of n parts is a block for every two of its parts."""
    crowded = buckets.where("part > 0").groupBy("band").agg((F.max("part") + 1).alias("parts"))
    others = F.transform(
        F.sequence(F.lit(1), F.col("parts") - 1),
        lambda k: F.least(F.col("part"), (F.col("part") + k) % F.col("parts")).cast("long") * (1 << 31) + F.greatest(F.col("part"), (F.col("part") + k) % F.col("parts")),
    )
    return buckets.join(small(crowded), "band", "left").select("band", "fp", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(others)).alias("block"))


def links(docs: DataFrame, signed: DataFrame, width: int = SHINGLE, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(distinct, links): (fp, first_id) per different set of shingles, and verified links (a, b) among their fps.

    `signed` is a written table (doc_id, text_key, fp, signature) of `docs`. Sets that share one of BANDS bands
    meet. A band's members are dealt to parts of PART; a band of several parts is compared part against part in
    as many tasks as that takes, so no group has to fit in one. Every link is verified by the whole sets, mapped
    from files in the shared folder; only sets that meet another are made and written.
    """
    if threshold < 0.7:
        raise ValueError("the bands are made for a similarity of 0.7 or more")
    distinct = signed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.first("signature").alias("signature"))
    distinct = scratch_table(distinct, "distinct-signatures")
    bands = distinct.select("fp", "signature").mapInArrow(_explode_bands, "band long, fp long")
    buckets = scratch_table(bands.repartition("band").sortWithinPartitions("band", "fp").mapInArrow(_meeting, "band long, fp long, part int"), "buckets")
    wanted = distinct.join(small(scratch_table(buckets.select("fp").distinct(), "candidates")), "fp", "left_semi").select("text_key")
    texts = docs.select("text", F.xxhash64("text").alias("text_key")).join(small(wanted.distinct()), "text_key", "left_semi")
    texts = texts.distinct()  # equal texts are one row before their shingles are made
    folder = shared_folder(docs.sparkSession, "sets")
    # Made and written by one worker: whole sets don't pass through the JVM to a second one beside it.
    places = scratch_table(texts.select("text").mapInArrow(_write_sets(folder, width), "fp long, file long, start long, size long"), "places")
    near = _blocks(buckets).join(places, "fp").repartition("band", "block").sortWithinPartitions("band", "block", "fp")
    return distinct.select("fp", "first_id"), near.mapInArrow(_verify(folder, threshold), "a long, b long")


def classes(docs: DataFrame, signed: DataFrame, width: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """(fp, root, component_id) per different set of shingles: the set's component and the smallest doc_id in it."""
    distinct, found = links(docs, signed, width, threshold)
    return rooted_groups(distinct, connected_components(found))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, signature, class_id) per row of `docs`.

    class_id is the smallest doc_id that links lead to, itself included; links join texts whose sets of
    shingles have a Jaccard similarity of `threshold` or more, and texts without words. A pair at 0.8 is missed
    with a probability of 5e-8. Rows with a NULL doc_id get their class's smallest known id (NULL if it
    has none); repeated rows come out repeated; other columns of `docs` are ignored.
    """
    signed = scratch_table(signatures(docs.select("doc_id", "text"), width), "signatures")
    return signed.join(classes(docs, signed, width, threshold), "fp").select("doc_id", "signature", F.col("component_id").alias("class_id"))
