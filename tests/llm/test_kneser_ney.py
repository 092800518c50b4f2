"""The n-gram model against a model of dicts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerlight.llm import kneser_ney as K

TEXTS = [
    "the cat sat on the mat", "The dog sat on\tthe log", "", None, " \n ", "a", "the the the the", "naïve café ümlaut café",
    "x" * 5000 + " tail", "the cat sat on the mat", "on a log the cat sat", "one\x0btwo\x0cthree\rfour",
]


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute(train):
    unigrams, pairs, contexts = Counter(), Counter(), Counter()
    for text in train:
        before = "begin"
        for token in tokens(text):
            unigrams[token] += 1
            pairs[before, token] += 1
            contexts[before] += 1
            before = token
    follows = Counter(w for _, w in pairs)
    ends = {b: [0, 0, 0, 0] for b in contexts}
    for (b, _), c in pairs.items():
        ends[b][min(c, 3)] += 1
    d = K.discounts_of([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    e = K.discounts_of([sum(c == k for c in follows.values()) for k in (1, 2, 3, 4)])
    n, v, kinds = sum(unigrams.values()), len(unigrams), len(pairs)
    left = sum(e[min(c, 3)] for c in follows.values()) / kinds if kinds else 1

    def lower(w):
        return (max(follows[w] - e[min(follows[w], 3)], 0) / kinds if kinds else 0) + left / (v + 1)

    def probability(b, w):
        if not contexts[b]:
            return lower(w)
        c = pairs[b, w]
        return max(c - d[min(c, 3)], 0) / contexts[b] + sum(d[k] * ends[b][k] for k in (1, 2, 3)) / contexts[b] * lower(w)

    def score(text):
        total = base = known = 0
        before = "begin"
        for token in tokens(text):
            total += math.log10(probability(before, token))
            base += math.log10((unigrams[token] + 0.1) / (n + 0.1 * (v + 1)))
            known += unigrams[token] > 0
            before = token
        return len(tokens(text)), known, base, total

    return score, probability, unigrams


def scored(spark, train, every):
    model = K.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    return model, {r["doc_id"]: r for r in K.score(docs, model).collect()}


def test_against_brute_force(spark):
    random.seed(5)
    pool = [f"w{i}" for i in range(60)]
    train = TEXTS + [" ".join(random.choices(pool, weights=[1 / (i + 1) for i in range(60)], k=random.randint(0, 40))) for _ in range(300)]
    every = train[:40] + ["unseen words the cat w0 w1", "THE CAT", "zzz"]
    score, probability, unigrams = brute(train)
    model, found = scored(spark, train, every)
    assert (model.tokens, model.words) == (sum(unigrams.values()), len(unigrams))
    for i, text in enumerate(every):
        n, known, base, total = score(text)
        row = found[i]
        assert (row["n_tokens"], row["n_known"]) == (n, known)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9) and math.isclose(row["score"], total, rel_tol=1e-9)
    for before in ("begin", b"the", b"w0", b"never"):
        assert math.isclose(sum(probability(before, w) for w in [*unigrams, b"unseen"]), 1.0, rel_tol=1e-9)


def test_no_training_text(spark):
    model, found = scored(spark, [], ["some words", None])
    assert model.words == 0 and found[1]["n_tokens"] == 1
    assert found[0]["score"] == 0 and found[0]["n_known"] == 0


def test_long_texts_are_cut_at_blanks(monkeypatch):
    texts = pa.array(["ab cd  ef " * 50, "x" * 300, None, "gh ij", "", "k l m"])
    whole = [(h.tolist(), w.tolist()) for _, h, w in K.token_groups(texts)]
    monkeypatch.setattr(K, "PIECE", 16)
    parts = [(h.tolist(), w.tolist()) for _, h, w in K.token_groups(texts)]
    assert sum((h for h, _ in whole), []) == sum((h for h, _ in parts), [])
    assert sum((w for _, w in whole), []) == sum((w for _, w in parts), []) == [150, 1, 0, 2, 0, 3]


def test_runs_round_trip():
    keys = np.sort(np.random.default_rng(3).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (K.unmix(K.mix(keys)) == keys).all()
    a, b = K.unpack(K.pack(keys, np.arange(1000, dtype=np.int32)))
    assert (a == keys).all() and (b == np.arange(1000)).all()
    counter = K.Counter(3)
    rows = list(counter.add(np.concatenate((keys, keys[:10])))) + list(counter.flush())
    total = [K.merged([r]) for r in rows[0].column("run").to_pylist()]
    assert sum(c.sum() for _, c in total) == 1010 and (np.concatenate([k for k, _ in total]) == keys).all()


def test_query(spark, sf_dir):
    from ledgerlight.llm.queries import QUERIES

    rows = QUERIES["op3_kneser_ney"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    score, _, unigrams = brute([d["text"] for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 10])
    by_id = {r["doc_id"]: r for r in rows}
    for d in docs:
        n, known, base, total = score(d["text"])
        r = by_id[d["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, sum(unigrams.values()))
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], total, rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
