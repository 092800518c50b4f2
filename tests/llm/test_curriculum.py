"""Targets, shares and the order of the mixture."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import curriculum as C


def targets(sizes, share=1.5, cap=2.0):
    """Shares by weight; what is above a cap goes to the others, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        out = capped | {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = {s: cap * sizes[s] for s in rest if out[s] > cap * sizes[s]}
        if not above:
            return out
        capped |= above


ROWS = [(i, s, n) for i, (s, n) in enumerate(
    [("a", 10)] * 40 + [("B", 7)] * 3 + [(None, 50)] * 5 + [("ä", 1)] * 9 + [("c", 0)] * 4 + [("d", 3000)] + [("z", 25)] * 30)] + [(None, "a", 6), (None, None, 2), (5, "a", 10), (5, "a", 10)]


def planned(spark, rows=ROWS, block=C.BLOCK_DIGITS):
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
    return C.plan(docs, F.col("size"), C.hash_key(F.col("doc_id")))


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_targets_and_words(spark, monkeypatch, digits):
    monkeypatch.setattr(C, "BLOCK_DIGITS", digits)
    rows = planned(spark).collect()
    sizes = {}
    for _, s, n in ROWS:
        sizes[s] = sizes.get(s, 0) + n
    want, taken = targets(sizes), {}
    for r in rows:
        assert math.isclose(r["_target"], want[r["source"]], rel_tol=1e-12) and r["_source_size"] == sizes[r["source"]]
        own = sum(c["taken"] for c in r["_copies"])
        assert own <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + own
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = planned(spark).collect()
    key = lambda r: (repr(r["doc_id"]), r["source"] or "", r["size"], repr(r["_copies"]))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_training_order(spark):
    ordered = C.in_training_order(planned(spark)).collect()
    positions = [r["_copy"]["position"] for r in ordered]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] < 1
    early = {s: 0 for s in ("a", "z")}
    for r in ordered:
        if r["source"] in early and r["_copy"]["position"] < 0.5:
            early[r["source"]] += r["_copy"]["taken"]
    total = {s: next(r["_target"] for r in ordered if r["source"] == s) for s in early}
    rank = sorted({s for _, s, _ in ROWS if s is not None}, key=lambda s: s.encode())
    for s in early:  # the share of a source used by half time follows the integral of its schedule
        schedule = C.SCHEDULES[rank.index(s) % 3]
        half = sum((min(t1, 0.5) - t0) * (w0 + w0 + (w1 - w0) * (min(t1, 0.5) - t0) / (t1 - t0)) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]) if t0 < 0.5)
        assert abs(early[s] / total[s] - half / C.integral(schedule)) < 0.06


def test_inverse_of_the_integral(spark):
    for schedule in (*C.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.0))):
        rows = spark.range(101).select((F.col("id") / 100).alias("q")).select("q", C.time_of(F.col("q"), schedule).alias("t")).collect()
        for r in rows:
            used = sum((min(t1, r["t"]) - t0) * (2 * w0 + (w1 - w0) * (min(t1, r["t"]) - t0) / (t1 - t0)) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]) if t0 < r["t"])
            assert math.isclose(used / C.integral(schedule), r["q"], abs_tol=1e-9)


def test_empty_and_wordless(spark):
    assert planned(spark, []).count() == 0
    rows = planned(spark, [(1, "a", 0), (2, None, 0)]).collect()
    assert [(r["_target"], len(r["_copies"])) for r in rows] == [(0.0, 0)] * 2
