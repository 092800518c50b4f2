"""SimHash near-duplicates found through the anchors of a covering code."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.components import connected_components
from ledgerlight.llm.shared import scratch_table, small, whole_row

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 3
SHINGLE = 3
SEED = 42
#: Runs of one anchor with more fingerprints than this are searched breadth first.
DENSE = 16
#: An anchor with more fingerprints than this isn't compared by one task: its fingerprints are split further.
CROWD = 1 << 14


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], seed) for a, b in zip(starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist())],
        dtype="<u8",
    )
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(print_: int) -> int:
    return print_ - (print_ >> 63 << 64)


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) per row of `docs`; fp holds the 64 bits as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(width, seed), f"doc_id {kind}, fp long")


# --- the covering code ---------------------------------------------------------------------------
#
# Of two 64-bit words that differ in at most three bits, one pair of 32-bit halves differs in at most
# one. On a half, the anchors are the words of the Hamming code [31, 26] with one free bit: every half
# lies within covering radius 1 of an anchor. A half within threshold 1 of it is thus within 1 + 1 = 2
# of that anchor, so replicating each half to all anchors within 2 makes every such pair meet: 2 or 17
# anchors a half, 33 a fingerprint, of the 2 * 2^27 anchors.


def _error_patterns() -> list[np.ndarray]:
    """For every syndrome the words of weight 2 or less whose removal leads to an anchor."""
    bit = np.left_shift(np.uint64(1), np.arange(32, dtype=np.uint64))  # bit 0 is the free one, bit i has syndrome i
    found = []
    for syndrome in range(32):
        if syndrome == 0:
            found.append(np.array([0, bit[0]], np.uint64))
            continue
        pairs = [bit[i] ^ bit[i ^ syndrome] for i in range(1, 32) if i < i ^ syndrome]
        found.append(np.array([bit[syndrome], bit[syndrome] ^ bit[0], *pairs], np.uint64))
    return found


def _syndromes(half: np.ndarray) -> np.ndarray:
    positions = np.arange(32, dtype=np.uint64)
    out = np.zeros(len(half), np.int64)
    for k in range(5):
        mask = np.bitwise_or.reduce(np.left_shift(np.uint64(1), positions[(positions >> np.uint64(k)) & np.uint64(1) == 1]))
        out |= (np.bitwise_count(half & mask).astype(np.int64) & 1) << k
    return out


def anchors_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, position in `prints`) of every replica. The half's number is the anchor's 33rd bit."""
    patterns = _error_patterns()
    anchors, owners = [], []
    for number, half in enumerate((prints & np.uint64(0xFFFFFFFF), prints >> np.uint64(32))):
        syndrome = _syndromes(half)
        for s in range(32):
            at = np.flatnonzero(syndrome == s)
            anchors.append(((half[at, None] ^ patterns[s][None, :]) | np.uint64(number << 32)).ravel())
            owners.append(np.repeat(at, len(patterns[s])))
    return np.concatenate(anchors), np.concatenate(owners)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.asarray(batch.column("fp")).view(np.uint64)
        anchors, owners = anchors_of(prints)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors.view(np.int64)), pa.array(prints[owners].view(np.int64))], names=["anchor", "fp"]
        )


def _dense_links(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all the fingerprints which chains of near ones connect: one per new member.

    Each member is compared with those not reached yet, so a dense group costs little more than its size.
    """
    left, right, rest = [], [], prints
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= threshold
            if near.any():
                reached = rest[near]
                left.append(np.full(len(reached), one))
                right.append(reached)
                queue.extend(reached)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links(anchors: np.ndarray, prints: np.ndarray, threshold: int) -> pa.RecordBatch:
    starts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    lengths = np.diff(np.append(starts, len(anchors)))
    left, right = [], []
    for at, n in zip(starts[lengths > DENSE], lengths[lengths > DENSE]):
        a, b = _dense_links(prints[at : at + n], threshold)
        left.append(a)
        right.append(b)
    sparse = np.repeat((lengths > 1) & (lengths <= DENSE), lengths)
    anchors, prints = anchors[sparse], prints[sparse]
    for step in range(1, DENSE):
        if len(anchors) <= step:
            break
        near = (anchors[step:] == anchors[:-step]) & (np.bitwise_count(prints[step:] ^ prints[:-step]) <= threshold)
        left.append(prints[:-step][near])
        right.append(prints[step:][near])
    none = np.zeros(0, np.uint64)
    ends = [np.concatenate([none, *x]).view(np.int64) for x in (left, right)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=["a", "b"])


def _with_kind(found: pa.RecordBatch, crowded: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*found.columns, pa.array(np.full(found.num_rows, crowded))], names=["a", "b", "crowded"])


def _compare(threshold: int, most: int | None = None):
    """Links (a, b, False); of anchors with more than `most` rows, the rows instead: (anchor, fp, True)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = CROWD if most is None else most
        crowd = None
        for a, p in _whole_anchors(batches, limit):
            if limit and (len(a) > limit and a[0] == a[-1] or a[0] == crowd):
                crowd = a[0]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(p.view(np.int64)), pa.array(np.full(len(a), True))], names=["a", "b", "crowded"])
            else:
                yield _with_kind(_links(a, p, threshold), False)

    return run


def _whole_anchors(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchors, fps) of whole anchors, several or one; an anchor of more than `most` (if not 0) rows comes alone, in parts.

    Rows come sorted by anchor; the last anchor of a batch may go on in the next one.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    held, crowd = [none], None
    for batch in batches:
        a, p = np.asarray(batch.column("anchor")), np.asarray(batch.column("fp")).view(np.uint64)
        if not len(a):
            continue
        if crowd is not None:
            cut = int(np.searchsorted(a, crowd, "right"))
            if cut:
                yield a[:cut], p[:cut]
            if cut == len(a):
                continue
            a, p, crowd = a[cut:], p[cut:], None
        a, p = np.concatenate([*[h[0] for h in held], a]), np.concatenate([*[h[1] for h in held], p])
        ends = np.append(np.flatnonzero(a[1:] != a[:-1]) + 1, len(a))
        starts = np.concatenate(([0], ends[:-1]))
        at = 0
        for i in np.flatnonzero(ends - starts > most).tolist() if most else ():
            if starts[i] > at:
                yield a[at : starts[i]], p[at : starts[i]]
            yield a[starts[i] : ends[i]], p[starts[i] : ends[i]]
            at = int(ends[i])
        if at == len(a):  # the last anchor is a crowd and may go on
            held, crowd = [none], a[-1]
            continue
        if starts[-1] > at:
            yield a[at : starts[-1]], p[at : starts[-1]]
        held = [(a[starts[-1] :], p[starts[-1] :])]
    a, p = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    if len(a):
        yield a, p


def near_links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links among the distinct fingerprints `prints` (fp), enough to connect all that chains of links connect.

    Every pair that differs in at most `threshold` (3 or fewer) bits meets at an anchor. Rows are streamed in
    sorted order; an anchor of more than CROWD of them passes them on and is split, see `_crowd_links`.
    """
    if threshold > THRESHOLD:
        raise ValueError("the anchors cover pairs that differ in at most 3 bits")
    found = scratch_table(_compared(prints.mapInArrow(_replicate, "anchor long, fp long"), threshold), "links")
    plain, crowded = found.where("NOT crowded").select("a", "b"), found.where("crowded").select(F.col("a").alias("anchor"), F.col("b").alias("fp"))
    return plain if crowded.isEmpty() else plain.unionByName(_crowd_links(crowded, threshold))


def _compared(rows: DataFrame, threshold: int, most: int | None = None) -> DataFrame:
    return rows.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(_compare(threshold, most), "a long, b long, crowded boolean")


def _crowd_links(crowded: DataFrame, threshold: int) -> DataFrame:
    """The links within crowded anchors. An anchor stands for one half of its fingerprints, so the other halves tell them apart.

    Of the other half's four bytes, two fingerprints within three bits share one: members meet per byte. Where even
    these groups are crowded, they are dealt to parts, and every two parts are compared, by as many tasks as that takes.
    """
    other = F.when(F.shiftright("anchor", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    byte = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.xxhash64("anchor", k, other.bitwiseAND(F.element_at(F.array(*[F.lit(0xFF << 8 * i) for i in range(4)]), k + 1))))
    met = crowded.select("fp", F.explode(byte).alias("group"))
    counted = met.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    parts = counted.select("group", F.ceil(F.col("n") / CROWD).cast("int").alias("parts"))
    dealt = met.join(small(parts), "group", "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
    pairs = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda k: F.array_sort(F.array(F.col("part"), (F.col("part") + k) % F.col("parts"))))
    blocks = dealt.select("fp", "group", F.explode(F.when(F.col("parts") > 1, pairs).otherwise(F.array(F.array(F.lit(0), F.lit(0))))).alias("block"))
    return _compared(blocks.select(F.xxhash64("group", "block").alias("anchor"), "fp"), threshold, most=0).select("a", "b")


def _grouped(docs: DataFrame, width: int, seed: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) per row and (fp, root, component_id) per distinct fingerprint."""
    each = scratch_table(fingerprints(docs, width, seed), "fingerprints")
    distinct = scratch_table(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(near_links(distinct.select("fp"), threshold))
    return each, rooted_groups(distinct, roots)


def rooted_groups(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, root, component_id) of `distinct` (fp, first_id) by its components' `roots`."""
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, seed: int = SEED, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) per row of `docs` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that links of `threshold` or fewer differing bits lead to,
    itself included. A NULL or blank text has fingerprint 0 and links like any other. Equal
    fingerprints are one row until the end, so copies cost nothing. Rows with a NULL doc_id get their
    group's smallest known id (NULL if it has none); repeated rows come out repeated.
    """
    each, groups = _grouped(docs, width, seed, threshold)
    return each.join(groups, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, width: int = SHINGLE, seed: int = SEED, threshold: int = THRESHOLD) -> DataFrame:
    """`docs` (all columns) with one row of each near-duplicate group: one with the group's smallest doc_id.

    Ids that several rows share, or that are NULL, don't tell a row's group; such rows are looked up by
    their own fingerprint. A group without any known id keeps one row.
    """
    each, groups = _grouped(docs, width, seed, threshold)

    def prints(texts: list[str | None]) -> list[int]:
        return [_signed(fingerprint(t, width, seed)) for t in texts]

    return first_of_groups(docs, each, groups, prints)


def _with_prints(prints: Callable[[list[str | None]], list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(prints(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], names=["row", "fp"])

    return run


def first_of_groups(docs: DataFrame, each: DataFrame, groups: DataFrame, prints: Callable[[list[str | None]], list[int]]) -> DataFrame:
    """The rows of `docs` that `keep_first` keeps, by `each` (doc_id, fp), `groups` and the function that gives texts' fps."""
    groups = scratch_table(groups, "groups")
    shared = scratch_table(each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "shared-ids")
    dropped = each.join(groups, "fp").where("doc_id <> component_id").select("doc_id").distinct()
    dropped = scratch_table(dropped.unionByName(shared.where("doc_id IS NOT NULL")).distinct(), "dropped-ids")
    rows = docs.select(whole_row(docs), "doc_id", "text")
    kept = rows.where("doc_id IS NOT NULL").join(small(dropped), "doc_id", "left_anti").select("row.*")
    if shared.isEmpty():
        return kept
    unclear = rows.join(shared.withColumnRenamed("doc_id", "shared_id"), F.col("doc_id").eqNullSafe(F.col("shared_id")), "left_semi").select("row", "text")
    looked_up = unclear.mapInArrow(_with_prints(prints), T.StructType([unclear.schema["row"], T.StructField("fp", T.LongType())])).join(groups, "fp")
    first = looked_up.where(F.col("row.doc_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["root"])
    return kept.unionByName(first.select("row.*"))
