"""Benchmark items in documents against plain set containment."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import decontaminate as D


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(words, width):
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def share(item, text):
    """Of an item's shingles, five words each or all of a shorter item, those in the text."""
    width = min(5, len(words_of(item)))
    own = shingles(words_of(item), width) if width else set()
    return len(own & shingles(words_of(text), width)) / len(own) if own else 0


def brute(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            if (held := share(item, text)) >= 0.8 - 1e-12:
                out[d, i] = max(out.get((d, i), 0), held)
    return sorted(((d, i, c) for (d, i), c in out.items()), key=repr)


@pytest.mark.parametrize("rows", [10**6, 3])
def test_against_brute_force(spark, monkeypatch, rows):
    """Also with tables that are too large to broadcast."""
    from ledgerlight.llm import shared

    monkeypatch.setattr(shared.small, "__defaults__", (rows,))
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(400)]
    some = lambda n: " ".join(rng.choices(pool, k=n))
    items = [(i, some(rng.choice([1, 2, 4, 5, 6, 9, 17, 33, 60]))) for i in range(40)] + [(90, None), (91, ""), (92, "?!"), (None, some(12)), (3, some(8)), (50, "a b a b a b a b a b")]
    docs = [(i, some(rng.randint(0, 60))) for i in range(60)]
    for n in range(120):
        words = rng.choice(items)[1]
        words = (words or "x").split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(pool)
        docs.append((100 + n, f"{some(rng.randint(0, 30))}\n{'  '.join(words).title()}. {some(rng.randint(0, 300))}"))
    docs += [(None, items[8][1]), (500, None), (501, ""), (502, items[1][1]), (503, items[20][1]), (503, items[20][1]), (503, "other"), (504, "a b " * 2000)]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("text_key", F.lit("clash")).withColumn("row", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item_key", F.lit("clash"))
    found = sorted((tuple(r) for r in D.contaminations(left, bench).collect()), key=repr)
    assert found == brute(docs, items) and len(found) > 25
    clean = D.without_contaminated(left, bench)
    hit = {t for d, t in docs for i, x in items if share(x, t) >= 0.8 - 1e-12}
    assert clean.columns == left.columns
    assert sorted((r["doc_id"], r["text"]) for r in clean.where("doc_id IS NOT NULL AND text IS NOT NULL").collect()) == sorted(d for d in docs if d[0] is not None and d[1] is not None and d[1] not in hit)
    assert clean.where("text IS NULL").count() == 1


def test_sketches_hold_a_value_of_every_large_enough_part(spark):
    words = " ".join(f"v{i}" for i in range(37))
    item = spark.createDataFrame([("k", words.split())], "item_key string, words array<string>").withColumn("n", F.lit(33)).withColumn("width", F.lit(5))
    sketch = {r["hash"] for r in D.sketches(item, 5, 0.8).collect()}
    assert len(sketch) == 64 - 52 + 1  # for the largest item of the partition


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminations(docs.where("doc_id > 1"), items).count() == 0
    assert D.contaminations(docs, items.where("item_id > 1")).count() == 0
    assert D.without_contaminated(docs, items).count() == 0


def test_short_items_inside_long_texts(spark):
    docs = [(1, "the capital of France is well known to all of us"), (2, "Capital, of FRANCE"), (3, "capital France of"), (4, "of France"), (5, "a zebra")]
    items = [(1, "capital of France"), (2, "zebra"), (3, "is well known to all of us all"), (4, "of France is well")]
    left, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in D.contaminations(left, bench).collect())
    assert found == [(1, 1), (1, 4), (2, 1), (5, 2)] == [(d, i) for d, i, _ in brute(docs, items)]
