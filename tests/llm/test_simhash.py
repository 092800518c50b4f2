"""Fingerprints, the covering code, groups and their first documents against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlight.llm import simhash
from ledgerlight.llm.components import connected_components
from ledgerlight.llm.queries import QUERIES


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, threshold=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= threshold:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


TEXTS = ["", None, " \n", "one", "ONE", "one two", "One TWO three", "one two three four", "É é É", "a b c " * 4000, "a b c " * 4000 + "d", "x\x0by\x0cz w", "nb sp is a word"]


def test_fingerprints():
    for text in TEXTS[:9] + ["a b c " * 50 + "d e f g", TEXTS[11], TEXTS[12]]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_every_near_pair_meets_at_an_anchor():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    base[:3] = [0, 2**64 - 1, 1 << 63]
    for distance in (0, 1, 2, 3):
        other = base.copy()
        for _ in range(distance):
            flips = np.left_shift(np.uint64(1), rng.integers(0, 64, len(base), dtype=np.uint64))
            other ^= flips
        for a, b in zip(base, other):
            left, right = (set(simhash.anchors_of(np.array([x]))[0].tolist()) for x in (a, b))
            assert left & right
    half = np.concatenate([simhash.anchors_of(base)[0]]) & np.uint64(0xFFFFFFFF)
    assert (simhash._syndromes(half) == 0).all()  # anchors are words of the code


def planted(rng):
    """Groups of fingerprints in chains and crowds, far singles, and copies."""
    prints = []
    for size in (1, 2, 5, 60):
        for _ in range(6):
            one = rng.getrandbits(64)
            for _ in range(size):
                prints.append(one)
                for _ in range(rng.randint(0, 4)):
                    one ^= 1 << rng.randrange(64)
    center = rng.getrandbits(64)
    prints += [center ^ 1 << i for i in range(64)] + [center ^ 3 << i for i in range(63)] + [prints[0]] * 20
    return prints


@pytest.mark.parametrize("crowd,low", [(simhash.CROWD, False), (6, False), (6, True)])
def test_groups_against_brute_force(spark, monkeypatch, crowd, low):
    """Also with anchors split at six members, and with half of the bits shared by most fingerprints."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(8)
    prints = planted(rng)
    if low:
        prints = [p & 0xFFFFFFFF | 0xABCD << 32 for p in prints[:100]] + [p >> 32 << 32 | 0x1234 for p in prints[:100]] + prints[300:]
    signed = [simhash._signed(p) for p in prints]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in set(signed)], "fp long"))
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    mine = [roots.get(s, s) for s in signed]
    theirs = components(prints)
    assert len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs))


def test_crowded_anchors_come_in_parts():
    import pyarrow as pa

    anchors = np.repeat([1, 2, 3, 4, 5, 6], [3, 40, 1, 25, 2, 30])
    prints = np.arange(len(anchors), dtype=np.int64)
    for size in (1, 4, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(anchors[i : i + size]), pa.array(prints[i : i + size])], names=["anchor", "fp"]) for i in range(0, len(anchors), size)]
        got = list(simhash._whole_anchors(iter(batches), 10))
        assert np.concatenate([p for _, p in got]).tolist() == prints.tolist()
        seen = [set(a.tolist()) for a, _ in got]
        assert all(len(s) == 1 for s in seen if s & {2, 4, 6}) and all(sum(a in s for s in seen) == 1 for a in (1, 3, 5))
        assert max(len(p) for a, p in got) <= 10 + size
        out = pa.Table.from_batches(simhash._compare(3, 10)(iter(batches))).to_pydict()
        assert sorted(b for b, c in zip(out["b"], out["crowded"]) if c) == prints[np.isin(anchors, [2, 4, 6])].tolist()


def test_many_members_of_one_anchor(spark):
    """60,000 fingerprints that share one half: no task compares more than a small part of the pairs."""
    one = 0x5A5A5A5A
    rows = spark.range(60_000).select(F.shiftleft(F.xxhash64("id"), 32).bitwiseOR(F.lit(one)).alias("fp")).distinct()
    near = rows.limit(1).select(F.col("fp").bitwiseXOR(F.lit(7 << 40)).alias("fp"))
    prints = rows.unionByName(near).distinct()
    found = simhash.near_links(prints)
    values = np.array([r["fp"] for r in prints.collect()]).view(np.uint64)
    links = found.collect()
    assert len(links) > 0
    joined = np.array([[r["a"], r["b"]] for r in links]).view(np.uint64)
    assert (np.bitwise_count(joined[:, 0] ^ joined[:, 1]) <= 3).all()
    linked = set(joined.ravel().tolist())
    some = [v for v in values[:: len(values) // 300] if (np.bitwise_count(values ^ v) <= 3).sum() > 1]
    assert all(int(v) in linked for v in some)


def test_long_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (7, 3), (3, 7), (-5, 900), (900, 901)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 900: -5, 901: -5}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_and_first_ones(spark):
    rows = [(i, t, f"x{i}") for i, t in enumerate(TEXTS)] + [(None, "one", "n1"), (None, "only nameless text", "n2"), (None, "only nameless text", "n3"), (40, "shared id a", "s1"), (40, "other words here", "s2"), (41, "twice", "t"), (41, "twice", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("root", F.lit(1)).withColumn("row", F.lit("r"))
    found = simhash.near_duplicates(docs).collect()
    prints = [slow_fingerprint(t) for _, t, _ in rows]
    group = components(prints)
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    want = sorted(((r[0], simhash._signed(p), least[g]) for r, p, g in zip(rows, prints, group)), key=repr)
    assert sorted((tuple(r) for r in found), key=repr) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    mine = sorted(components([slow_fingerprint(r["text"]) for r in kept]))
    assert len(kept) == len(set(group)) and len(set(mine)) == len(kept)
    assert all(r["doc_id"] == least[group[[x[2] for x in rows].index(r["fp"])]] for r in kept)
    assert simhash.keep_first(docs.where("doc_id > 99")).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [slow_fingerprint(d["text"]) for d in docs]
    group = components(prints)
    least = {g: min(d["doc_id"] for d, h in zip(docs, group) if h == g) for g in group}
    want = sorted((d["doc_id"], f"{p:016x}", least[g]) for d, p, g in zip(docs, prints, group))
    assert sorted(tuple(r) for r in QUERIES["op1_simhash"](spark, sf_dir).collect()) == want
