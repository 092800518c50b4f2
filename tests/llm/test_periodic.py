"""Runs of words against a search over all lags."""

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import periodic as P
from ledgerlight.llm.queries import QUERIES


def slow_runs(words, least=6, times=4):
    """All stretches of every lag; of one stretch the smallest lag."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(least, times * q):
                found.setdefault((start, i - start), q)
    return sorted((s, l, q) for (s, l), q in found.items())


def slow_row(doc_id, text):
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    dropped = {i for s, l, q in runs for i in range(s + q, s + l)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(best[:1] + best[1:] if best else (None, None, None)), best[1] * 1000 // best[2] if best else None,
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


def test_runs_of_all_short_texts():
    """Every text of up to 14 words of two kinds and of up to 9 of three, and random ones with planted runs."""
    for kinds, longest in ((2, 14), (3, 9)):
        for n in range(longest + 1):
            for k in range(kinds**n):
                words = [k // kinds**i % kinds for i in range(n)]
                for least, times in ((6, 4), (4, 4), (2, 5)):
                    assert P.runs(words, least, times) == slow_runs(words, least, times), words
    rng = random.Random(4)
    for _ in range(1500):
        kinds, words = rng.choice([1, 2, 3, 8, 50]), []
        while len(words) < rng.randint(0, 300):
            part = rng.choices(range(kinds), k=rng.randint(1, 12))
            words += part * rng.choice([1, 1, 2, 4, 6, 7]) + part[: rng.randint(0, len(part))]
        for least, times in ((6, 4), (4, 4), (9, 5)):
            assert P.runs(words, least, times) == slow_runs(words, least, times), words
    with pytest.raises(ValueError):
        P.runs([1, 2], 2, 3)


def test_long_texts_stay_fast():
    start = time.time()
    assert P.runs([1] * 200_000) == [(0, 200_000, 1)]
    assert P.runs([1, 2] * 100_000 + [3]) == [(0, 200_000, 2)]
    rng = random.Random(1)
    common = [0 if rng.random() < 0.3 else rng.randrange(5000) for _ in range(100_000)]
    assert all(l >= max(6, 4 * q) for _, l, q in P.runs([0] * 50_000 + [7, 8] + common))
    whole = list(range(20_000)) * 5
    assert P.runs(whole) == [(0, 100_000, 20_000)]
    assert time.time() - start < 60


def test_collapsed():
    assert P.collapsed(list("abcabcabcabcx"), [(0, 12, 3)]) == list("abcx")
    words = list("xaaaaaaay")
    assert P.collapsed(words, P.runs(words)) == list("xay") and P.collapsed([], []) == []


ROWS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "go " * 6), (4, "go " * 5), (5, "a b\n" * 8 + "c"), (6, "Go go " * 4), (7, "one two three four five"), (8, "x y z " * 3 + "x y z q"),
    (None, "no id no id no id no id"), (None, None), (9, "same id"), (9, "same same same same same same same"), (10, "nb\xa0sp nb\xa0sp " * 5), (11, "éé 😀 " * 4),
]


def test_rows_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = ROWS + [(i, " ".join(rng.choices("abcdefghijklmnop", k=rng.randint(0, 120)))) for i in range(20, 220)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op13_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((slow_row(*r) for r in rows), key=repr)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)
    whole = {r["doc_id"]: r for r in P.detect(docs.where("doc_id IN (5, 3)")).collect()}
    assert whole[5]["collapsed"] == "a b c" and [tuple(r) for r in whole[5]["runs"]] == [(0, 16, 2)] and whole[3]["collapsed"] == "go"
    assert P.detect(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op13_runs"](spark, sf_dir).collect()
    want = sorted(slow_row(*r) for r in rows)
    assert sorted(map(tuple, found)) == want and sum(r[1] > 0 for r in want) > 10
