"""MinHash fingerprints, edited texts, bands and verified links against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import minhash as M
from ledgerlight.llm.queries import QUERIES
from tests.llm.test_jaccard import edited, firsts
from tests.llm.test_jaccard import shingles as slow_shingles


def jaccard(a, b):
    a, b = slow_shingles(a), slow_shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def signed(*texts):
    return M.fingerprints(*M.shingles_of(list(texts)))


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    errors = []
    for edits in (0, 1, 3, 8, 20, 60):
        for n in (30, 250, 3000):
            words = [f"w{rng.randrange(4000)}" for _ in range(n)]
            a, b = " ".join(words), " ".join(edited(rng, words, min(edits, n // 2)))
            found = M.likeness(signed(a), signed(b))[0]
            errors.append(found - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.16
    same = signed("A b c d e f", "a B c\nd e  f", "a b", "A B", None, "", " \n")
    assert (same[0] == same[1]).all() and (same[2] == same[3]).all() and (same[4:] == M.EMPTY).all()
    assert M.likeness(same[:1], same[2:3])[0] < 0.1 and M.likeness(same[4:5], same[:1])[0] < 0.1
    words = [f"w{i % 700}" for i in range(3 * M.CHUNK)]  # longer than what is hashed together
    parts = signed(" ".join(words), " ".join(words[:704]), "x " * 9)
    assert (parts[0] == parts[1]).all()


def test_shingles_are_those_of_the_words():
    texts = ["a b c d e f g", "g f", None, "a b c d e", "c d e f g h", "x", "b c d e f"]
    hashes, sizes = M.shingles_of(texts)
    assert sizes.tolist() == [3, 1, 0, 1, 2, 1, 1]
    parts = [set(p.tolist()) for p in np.split(hashes, np.cumsum(sizes)[:-1])]
    assert parts[0] & parts[3] and parts[0] & parts[4] and parts[0] & parts[6] and not parts[1] & parts[5]
    assert len(set().union(*parts)) == len({s for t in texts for s in slow_shingles(t)})


TEXTS = ["", None, " \n\t", "abc", "Abcd efg", "é" * 9, "a\x0bb\x0cc\rd e f g h i j k", "one two three four five six seven eight nine ten", "no_blank_in_this_one_at_all" * 9,
         "word " * 5000, "tail blank                      ", "nb\xa0sp 　wide word word", "x y z " * 40 + "end", "😀 😀 abc 😀" * 5]


def test_edited_hashes():
    for a in TEXTS:
        for b in TEXTS:
            a_, b_ = a or "", b or ""
            hashes, text = M._edited_hashes(a_, M.word_hashes([M.words(a_)])[0], b_)
            assert text == M.edited(a_, b_) and hashes.tolist() == M.word_hashes([M.words(text)])[0].tolist()


def slow_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        a, b = a or "", b or ""
        cut = len(a) // 4
        text = a[: len(a) - cut] + b[:cut]
        prints = signed(a, text, b)
        near = [float(M.likeness(prints[:1], prints[k : k + 1])[0]) for k in (1, 2)]
        out.append((i, len(a), hashlib.sha256(text.encode()).hexdigest(), prints[0].tobytes().hex(), prints[1].tobytes().hex(), *near))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, len(TEXTS)])
def test_successors(spark, n, tmp_path):
    rows = [(i * 7 % 101, t) for i, t in enumerate(TEXTS[:n])] + [(None, "nameless here")] * (n > 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("signature", F.lit("clash")).repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op11_fingerprints"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(slow_edits(rows), key=repr)


def test_ties_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "same"), ("b", "same"), ("b", "other words"), ("a", "first of all here")], "doc_id string, text string")
    found = M.with_edits(docs).collect()
    assert sorted(r["doc_id"] for r in found) == ["a", "b", "b", "b"] and len({bytes(r["signature"]) for r in found if r["n_chars"] == 4}) == 1


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op11_fingerprints"](spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(slow_edits(rows))
    assert np.mean([r["near_edited"] for r in found]) > 0.5 > 0.05 > np.mean([r["near_next"] for r in found])


def crowd(rng):
    """Copies, near copies, a chain, and texts that share much of one template but aren't near."""
    texts = [None, "", " \n", "one", "ONE", "one two three four five six"] + ["copied text of seven words or so"] * 50
    chain = [f"c{i}" for i in range(200)]
    for _ in range(40):
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 2)
    template = [f"t{i}" for i in range(150)]
    for _ in range(80):
        texts.append(" ".join(template + [f"own{rng.randrange(10**9)}" for _ in range(60)]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("part", [M.PART, 7])
def test_classes_against_brute_force(spark, monkeypatch, part):
    """With parts of seven, the bands of the template's texts are compared part against part."""
    monkeypatch.setattr(M, "PART", part)
    texts = crowd(random.Random(6))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", F.lit("clash"))
    found = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(docs).collect()}
    assert sorted(found) == list(range(len(texts))) and sorted(set(found.values())) == firsts(texts)
    firsts_of = {c: texts[c] for c in set(found.values())}
    assert all(firsts_of[c] is not None or not (texts[i] or "").split() for i, c in found.items())
    assert M.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.links(docs, docs, threshold=0.5)


def test_parts_of_a_band():
    """Members of crowded bands are numbered across batches; bands of one member go."""
    import pyarrow as pa

    bands = np.repeat([1, 2, 3, 4, 5], [1, 2 * M.PART + 3, 1, 2, 1])
    batches = [pa.RecordBatch.from_arrays([pa.array(b), pa.array(k)], names=["band", "fp"]) for b, k in zip(np.array_split(bands, 1000), np.array_split(np.arange(len(bands)), 1000))]
    out = pa.Table.from_batches(M._meeting(iter(batches))).to_pydict()
    assert out["fp"] == np.flatnonzero((bands == 2) | (bands == 4)).tolist()
    assert [out["part"].count(p) for p in (0, 1, 2)] == [M.PART + 2, M.PART, 3]


def test_many_unlike_sets_of_one_band(spark, tmp_path):
    """20,000 sets that share no link in one band: blocks of bounded size, compared by fingerprints."""
    n, size = 20_000, 20
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 2**64, (n, size), dtype=np.uint64), axis=1)
    hashes[-1, 1:] = hashes[0, 1:]
    hashes[-1].sort()
    prints = M.fingerprints(hashes.ravel(), np.full(n, size))
    with open(tmp_path / "1.sets", "wb") as file:
        for p, h in zip(prints, hashes):
            file.write(p.tobytes() + h.tobytes())
    buckets = spark.range(n).select(F.lit(9).cast("long").alias("band"), F.col("id").alias("fp"), (F.col("id") / M.PART).cast("int").alias("part"))
    places = spark.range(n).select(F.col("id").alias("fp"), F.lit(1).cast("long").alias("file"), (F.col("id") * (size + M.PERMUTATIONS // 8)).alias("start"), F.lit(size).cast("long").alias("size"))
    blocks = M._blocks(buckets)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 2 * M.PART
    near = blocks.join(places, "fp").repartition("band", "block").sortWithinPartitions("band", "block", "fp")
    found = near.mapInArrow(M._verify(str(tmp_path), 0.8), "a long, b long").distinct().collect()
    assert [tuple(r) for r in found] == [(0, n - 1)]


def test_workers_hold_the_words_of_a_part_of_a_batch(tmp_path):
    """Signing texts, and writing their sets, takes no more for a batch of many texts than for a part of it."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(500)) for _ in range(2000)] + [None, "", "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text_key", "text"])
    size = sum(len(t or "") for t in texts)
    made = {}
    for name, run in (("signed", M._sign(M.SHINGLE)), ("written", M._write_sets(str(tmp_path), M.SHINGLE))):
        tracemalloc.start()
        made[name] = [row for out in run(iter([batch])) for row in (out.select(["fp"]) if name == "signed" else out).to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert size > 6 * M.TEXT_BYTES and peak < 4 * size
    assert [r["fp"] for r in made["signed"]] == [r["fp"] for r in made["written"]]
    files = {r["file"] for r in made["written"]}
    found = np.fromfile(tmp_path / f"{files.pop()}.sets", "<u8")
    assert not files and found.size == sum(r["size"] + M.PERMUTATIONS // 8 for r in made["written"])
    prints = signed(*texts)
    for i in (0, 1, 777, 1999, 2000, 2001, 2002):
        row = made["written"][i]
        at = row["start"] + M.PERMUTATIONS // 8
        assert (found[row["start"] : at].view(np.uint8) == prints[i]).all()
        assert found[at : at + row["size"]].tolist() == M.sets(*M.shingles_of([texts[i]]))[0].tolist()
