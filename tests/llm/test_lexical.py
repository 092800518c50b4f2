"""Ranked lexical search against scores of every item and document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, top=10):
    """(item row, rank, doc_id, score), by arithmetic on whole numbers."""
    bags = [(i, Counter(slow_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc_id, bag, n in bags:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in slow_terms(text) if t in bag)
            if score > 0:
                scores.append((doc_id, score))
        scores.sort(key=lambda s: (-s[1], s[0] is None, s[0] or 0))
        out += [(item, rank, *s) for rank, s in enumerate(scores[:top], 1)]
    return sorted(out, key=repr)


def test_terms():
    for text in (None, "", "A-B_c9é|Ünï code\x7fz\x00y [x] `q` {k} @A@ Zz09:;", "\n \t", "ß2ẞ中文、字", "ABCXYZ"):
        assert [t.decode() for t in L.terms(text) if t] == slow_terms(text)


def test_bounds_hold():
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(400)]
    docs = [" ".join(rng.choices(pool[: rng.choice([20, 400])], k=rng.choice([1, 30, 300, 3000]))) for _ in range(40)] + ["many " * 5000]
    items = L.Batch(list(range(30)), [" ".join(rng.choices(pool + ["absent", "many"], k=12)) for _ in range(30)])
    items.weigh({i: rng.randint(1, 41) for i in range(len(items.hashes))}, 41, sum(len(d.split()) for d in docs))
    tight = 0
    for text in docs:
        hashes, counts = np.unique(L.term_hashes(text), return_counts=True)
        sketch, m = L.sketch(hashes, counts), items.factor(len(text.split()))
        assert 2 * len(sketch) >= L.SLOTS * len(hashes)
        bounds = items.bounds(sketch, m)
        scores = np.array([items.score(i, hashes, counts, m) for i in range(30)])
        assert (bounds >= scores).all()
        tight += int((bounds == scores).sum())
    assert tight > 200


@pytest.mark.parametrize("cells,several", [(L.CELLS, L.ITEMS), (90, 4)])
def test_ranks_against_brute_force(spark, monkeypatch, cells, several):
    """Also with items in several passes and bounds in small portions."""
    monkeypatch.setattr(L, "CELLS", cells)
    monkeypatch.setattr(L, "ITEMS", several)
    rng = random.Random(7)
    pool = [f"Word{i}" for i in range(300)] + ["the"] * 300
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 80)))) for i in range(150)]
    docs += [(200 + i, "the same text with the rare zebra") for i in range(25)]  # ties beyond the tenth place
    docs += [(500, None), (501, ""), (502, " .,;! "), (None, "nameless zebra"), (None, None), (503, "zebra " * 20000 + "tail"), (504, "é中文 zebra"), (0, "an id used twice zebra")]
    items = [(1, "the zebra"), (2, None), (3, ""), (4, "Word1 word2 WORD3 word1"), (5, "nowhere to be found qqq"), (6, "é中文"), (7, docs[3][1]), (7, docs[4][1]), (8, "the"), (9, "tail"), (None, "no id zebra")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1)).repartition(5)
    wanted = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(4))
    found = L.search(L.index(frame), wanted).collect()
    assert sorted(map(tuple, found), key=repr) == slow(docs, items)
    assert L.search(L.index(frame), wanted, top=3).where("item_id = 8").count() == 3
    indexed = L.index(frame)
    for some, none in ((indexed, wanted.limit(0)), (indexed.limit(0), wanted), (indexed.where("n = 0"), wanted)):
        assert L.search(some, none).count() == 0


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "zebra"), ("a", "zebra"), (None, "zebra")], "doc_id string, text string")
    found = L.search(L.index(docs), spark.createDataFrame([("q", "zebra")], "item_id string, text string")).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in found] == [(1, "a"), (2, "b"), (3, None)]


def test_few_documents_are_scored(spark, sf_dir, tmp_path):
    """The bounds leave most pairs of items and documents unscored."""
    docs = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items = L.Batch(list(range(len(texts))), texts)
    bags = [np.unique(L.term_hashes(t), return_counts=True) for t in docs]
    held = Counter(int(h) for b, _ in bags for h in b)
    n = [int(c.sum()) for _, c in bags]
    items.weigh({i: held[int(h)] for i, h in enumerate(items.hashes) if held[int(h)]}, sum(x > 0 for x in n), sum(n))
    pairs = scored = 0
    bounds = np.array([items.bounds(L.sketch(*b), items.factor(x)) for b, x in zip(bags, n)])
    for item in range(len(texts)):
        exact = np.array([items.score(item, *b, items.factor(x)) for b, x in zip(bags, n)])
        pairs += len(docs)
        scored += int((bounds[:, item] >= max(1, np.sort(exact)[-10])).sum())
    assert scored < 0.35 * pairs
