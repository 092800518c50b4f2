"""Top-k products against all products."""

import math

import numpy as np
import pytest

from ledgerlight.llm import retrieval


def brute(rows, top):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        own = min(v for i, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:top], 1)]
    return out


@pytest.mark.parametrize("size", [16, 4096])
def test_against_brute_force(spark, monkeypatch, size):
    rng = np.random.default_rng(11)
    rows = [(int(i), (rng.normal(size=8) * rng.choice([0.01, 0.5, 1, 3])).astype(np.float32).tolist()) for i in range(500)]
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows += [(int(i), same) for i in range(1000, 1300)]  # one hot vector, ties, and queries among them
    rows += [(2000, None), (2100, [1.0, None] + [0.0] * 6), (2200, [math.inf] + [0.0] * 7), (2300, [math.nan] * 8), (None, same), (2400, [0.0] * 8), (2500, []), (2600, [-1.0, 2.0])]
    rows += [rows[100]]
    monkeypatch.setattr(retrieval, "BLOCK", size)
    monkeypatch.setattr(retrieval, "QUERIES", max(2, size // 16))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = retrieval.top_products(df.where("vec_id % 100 = 0"), df)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 10)


def test_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert retrieval.top_products(empty, empty).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert retrieval.top_products(one, one).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in retrieval.top_products(two.where("vec_id = 0"), two).collect()] == [(0, 1, 1, -1024 * 1024)]


def test_pruning_keeps_every_reaching_row():
    rng = np.random.default_rng(2)
    vectors = np.floor(rng.normal(size=(300, 5)) * 400).astype(np.int64)
    vectors = vectors[np.argsort(-(vectors * vectors).sum(axis=1))]
    bucket = retrieval.Bucket(np.arange(300), vectors)
    pruned = 0
    for query in np.floor(rng.normal(size=(40, 5)) * 400).astype(np.int64):
        scores = vectors @ query
        for least in np.sort(scores)[[-1, -3, -10, -60]]:
            rows = bucket.candidates(query.astype(float), float(np.sqrt((query * query).sum())), float(least))
            assert set(np.flatnonzero(scores >= least)) <= set(rows)
            pruned += len(rows) < 300
    assert pruned > 50
