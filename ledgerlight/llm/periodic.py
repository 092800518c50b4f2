"""Periodic runs of words, found online along the diagonals of a text's match matrix.

Word i lies on diagonal (lag) d if word i - d is the same. While words come in, every active lag's matched
length grows; a lag whose next word differs ends, and if its stretch is long enough the run is emitted at
once. What keeps this sparse:

- A run of period q and length 4q or more matches on its diagonal for 3q words, so at three successive word
  numbers that q divides. A lag is taken up only there: at word i, the lags looked at are i's divisors, and the
  word must have occurred at i - q, i - 2q and i - 3q. The stretch's first words are then found by walking back.
- While lag q is active, its multiples that stay inside its stretch say nothing new: they match as long as it
  does and end with it.
"""

from __future__ import annotations

import hashlib
import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ledgerlight.llm.shared import text_parts, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A run has at least so many words and so many periods.
LEAST, TIMES = 6, 4


#: Divisors of numbers below this are kept by a worker.
KEPT = 1 << 15


def divisors(number: int) -> list[int]:
    """The divisors of a positive number that go into it three times or more, in no order."""
    if number < KEPT:
        kept = worker_cache("divisors").setdefault("lists", [])
        if not kept:
            kept += [[] for _ in range(KEPT)]
            for d in range(1, KEPT // 3 + 1):
                for multiple in range(3 * d, KEPT, d):
                    kept[multiple].append(d)
        return kept[number]
    low = np.arange(1, math.isqrt(number) + 1)
    low = low[number % low == 0]
    return [d for d in {*low.tolist(), *(number // low).tolist()} if 3 * d <= number]


def runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    A run is a stretch with smallest period q and a length of at least max(least, times * q) that no
    neighbouring word extends keeping period q. `times` has to be 4 or more.
    """
    if times < 4:
        raise ValueError("a run has to hold its period four times")
    n, found = len(words), []
    seen: dict = {}  # word -> how often it came so far
    active: dict[int, int] = {}  # lag -> first word of its stretch

    def end(lags: list[int], stop: int) -> None:
        """Lags whose stretches end before `stop`; of those over one stretch the smallest is its period."""
        done = {}
        for lag in lags:
            start = active.pop(lag)
            if stop - start >= max(least, times * lag):
                done[start] = min(lag, done.get(start, lag))
        found.extend((start, stop - start, lag) for start, lag in done.items())

    for i, word in enumerate(words):
        if active:
            ended = [lag for lag in active if words[i - lag] != word]
            if ended:
                end(ended, i)
        before = seen.get(word, 0)
        seen[word] = before + 1
        if before < 3:
            continue
        for lag in divisors(i):
            if words[i - lag] != word or words[i - 2 * lag] != word or words[i - 3 * lag] != word or lag in active:
                continue
            if any(lag % shorter == 0 and i - lag >= start for shorter, start in active.items()):
                continue
            first = i
            while first > lag and words[first - 1] == words[first - 1 - lag]:
                first -= 1
            if i - first >= 2 * lag:
                active[lag] = first - lag
    end(list(active), n)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(change[:-1]).tolist()) if not inside]


def planted(words: list[bytes], key: str) -> list[bytes]:
    """The words of one document in ten with a periodic end; which, from where and how long depends on its key alone."""
    h = zlib.crc32(key.encode("utf-8", "surrogatepass"))
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FIELDS = [
    ("n_runs", "long", pa.int64()), ("start", "long", pa.int64()), ("length", "long", pa.int64()), ("period", "long", pa.int64()),
    ("runs_sha256", "string", pa.string()), ("collapsed_sha256", "string", pa.string()),
]
WHOLE = [("runs", "array<struct<start: long, length: long, period: long>>", pa.list_(RUN)), ("collapsed", "string", pa.string())]


def _detect(least: int, times: int, plant: bool, whole: bool):
    fields = FIELDS + WHOLE * whole

    def row(key, text: str | None) -> tuple:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if plant:
            words = planted(words, "" if key is None else str(key))
        numbers: dict = {}
        found = runs([numbers.setdefault(w, len(numbers)) for w in words], least, times)
        longest = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        kept = b" ".join(collapsed(words, found))
        values = {
            "n_runs": len(found), "start": longest[0], "length": longest[1], "period": longest[2],
            "runs_sha256": hashlib.sha256("".join(f"{s},{l},{p}\n" for s, l, p in found).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(kept).hexdigest(),
        }
        if whole:
            values |= {"runs": [dict(zip(("start", "length", "period"), r)) for r in found], "collapsed": kept.decode("utf-8", "surrogatepass")}
        return tuple(values[name] for name, _, _ in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                rows = [row(k, t) for k, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())]
                columns = list(zip(*rows)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, (_, _, t) in zip(columns, fields)]], names=["doc_id", *[f[0] for f in fields]])

    return run


def detect(docs: DataFrame, least: int = LEAST, times: int = TIMES, plant: bool = False, whole: bool = True) -> DataFrame:
    """Periodic runs per row of `docs` (doc_id, text; other columns are ignored): no shuffle, one pass.

    Returns doc_id, n_runs, the longest run's start, length and period (ties: the smallest start, then period;
    NULL without a run), runs_sha256, collapsed_sha256 and, if `whole`, all runs and the collapsed text: the words
    that no run holds after its first period, joined by one blank. Words are blank-separated and compared as
    they are. NULL, empty and blank texts have no words. Every row is taken for itself, so repeated and NULL
    ids change nothing. `plant` first gives one document in ten a periodic end, by a hash of its id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{name} {t}" for name, t, _ in FIELDS + WHOLE * whole]])
    return docs.select("doc_id", "text").mapInArrow(_detect(least, times, plant, whole), schema)
