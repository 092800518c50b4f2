"""Toxicity: a learned lexicon as a trie under Levenshtein automata, and context windows around its hits."""

from __future__ import annotations

import bisect
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.shared import scratch_table, ship, unship

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows that the lexicon and the weights are learned from, at most; a hash of the id picks them.
SAMPLE = 60_000
#: Lengths of word beginnings that can become stems of the lexicon.
STEMS = range(4, 9)
#: Expected number of terms that chance alone may bring into the lexicon, and the share of toxic documents a term needs.
CHANCE, PRECISION = 0.1, 0.8
#: Length from which a term is also found with one, and with two, wrong, missing or extra letters.
ONE_EDIT, TWO_EDITS = 5, 9
#: Words on either side of a hit that tell how it is meant.
WINDOW = 6
QUOTES = "\"“”„«»‹›"
#: Words that report what somebody said, and words that address somebody, in the languages at hand.
REPORTING = frozenset("said says say called calls calling wrote writes quoted quote word words term insult insults dit appelé mot sagte nannte wort dijo llamó palabra".split())
ADDRESSING = frozenset("you your you're du dich dir ihr euch tu te toi vous usted ustedes vos".split())
#: What a hit counts: quoted, reported, addressed to somebody, and per wrong letter.
QUOTED, REPORTED, ADDRESSED, PER_EDIT = 0.2, 0.5, 1.25, 0.85
#: Starting point of the weights, for a bias, the log of abuse and the log of quoted mass; learning moves them.
PRIOR, STRENGTH = np.array([-3.0, 5.0, -0.5]), 1.0
SCHEMA = "score double, abuse double, quoted double"


def plain_words(text: str) -> set[str]:
    """Runs of letters, lower case."""
    return set(re.findall(r"[^\W\d_]+", text.lower()))


class Lexicon:
    """Terms in a trie, read by one automaton that allows each term its number of edits.

    The automaton runs over a word's letters; its states are sets of (trie node, edits so far), the product of
    all the terms' Levenshtein automata with the trie, and are made when first met. Most words leave the
    automaton within a few letters. A stem is found in every word that begins with it.
    """

    def __init__(self, words: list[str], stems: list[str], innocent: frozenset[str] = frozenset()):
        self.words, self.stems, self.innocent = sorted(words), sorted(stems), innocent
        self.children: list[dict[str, int]] = [{}]
        self.allowed, self.is_stem, self.deepest = [-1], [False], [0]
        for term, stem in [(w, False) for w in self.words] + [(s, True) for s in self.stems]:
            edits = 0 if len(term) < ONE_EDIT + 2 * stem else 1 if len(term) < TWO_EDITS or stem else 2
            node = 0
            self.deepest[0] = max(self.deepest[0], edits)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.allowed.append(-1)
                    self.is_stem.append(False)
                    self.deepest.append(0)
                node = self.children[node][letter]
                self.deepest[node] = max(self.deepest[node], edits)
            self.allowed[node], self.is_stem[node] = edits, self.is_stem[node] or stem
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[dict[int, int]] = []
        self.ends: list[int] = []
        self.begun: list[int] = []
        self.start = self._state(self._closed({0: 0}))

    def __getstate__(self):
        return self.words, self.stems, self.innocent

    def __setstate__(self, state):
        self.__init__(*state)

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes that skipping letters of a term leads to."""
        queue = list(nodes.items())
        while queue:
            node, edits = queue.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.deepest[child] and edits + 1 < nodes.get(child, 99):
                    nodes[child] = edits + 1
                    queue.append((child, edits + 1))
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            fits = [(e, n) for n, e in nodes.items() if e <= self.allowed[n]]
            self.ends.append(min((e for e, _ in fits), default=99))
            self.begun.append(min((e for e, n in fits if self.is_stem[n]), default=99))
        return self.states[key]

    def _move(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}
        for node, edits in self.sets[state].items():
            if edits + 1 <= self.deepest[node]:
                after[node] = min(after.get(node, 99), edits + 1)
            for own, child in self.children[node].items():
                cost = edits + (own != letter)
                if cost <= self.deepest[child]:
                    after[child] = min(after.get(child, 99), cost)
        to = self._state(self._closed(after)) if after else -1
        self.moves[state][letter] = to
        return to

    def edits(self, word: str) -> int | None:
        """Fewest edits that make `word` a term or a beginning of it a stem; None if none may."""
        state, begun = self.start, 99
        moves = self.moves
        for letter in word:
            to = moves[state].get(letter)
            state = self._move(state, letter) if to is None else to
            if state < 0:
                return begun if begun < 99 else None
            if self.begun[state] < begun:
                begun = self.begun[state]
        found = min(begun, self.ends[state])
        return None if found == 99 or found and word in self.innocent else found


def _bare(token: str) -> str:
    return re.sub(r"^[^\w]+|[^\w]+$", "", token.lower()).split("'")[0]


class Scorer:
    """Hits and their context in whole texts."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights
        self.cache: dict[str, int | None] = {}

    def hit(self, token: str) -> int | None:
        """Edits of the best term in a blank-separated token."""
        if token in self.cache:
            return self.cache[token]
        word = _bare(token)
        parts = [word] if word.isalnum() else re.findall(r"[^\W_]+", word)
        found = [e for e in map(self.lexicon.edits, parts) if e is not None]
        if len(self.cache) > 500_000:
            self.cache.clear()
        self.cache[token] = out = min(found) if found else None
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """(abuse, quoted): what the hits count as meant, and as somebody's words."""
        tokens = (text or "").split()
        hits = {t for t in set(tokens) if self.hit(t) is not None}
        abuse = quoted = 0.0
        if not hits:
            return abuse, quoted
        for i, token in enumerate(tokens):
            if token not in hits:
                continue
            before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
            near = {_bare(t) for t in before} | {_bare(t) for t in after}
            mass = PER_EDIT ** self.hit(token)
            bare = token.rstrip(".,;:!?")
            opened = sum(t.count(q) for t in before for q in QUOTES) % 2 == 1 or token[0] in QUOTES
            closed = bare[-1:] in QUOTES or any(q in t for t in after for q in QUOTES)
            if opened and closed:
                quoted += mass
                abuse += QUOTED * mass
            elif near & REPORTING:
                quoted += mass * (1 - REPORTED)
                abuse += REPORTED * mass
            else:
                abuse += mass * (ADDRESSED if near & ADDRESSING else 1.0)
        return abuse, quoted

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(features) @ self.weights, -30, 30)))


def _design(features: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(features)), np.log1p(features)))


def fit_weights(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression drawn to the prior weights, by Newton steps."""
    x, w = _design(features), PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + STRENGTH * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + STRENGTH * np.eye(x.shape[1]), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.maximum(w, [-30, 0.5, -30])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            found = plain_words(text or "")
            stems = {f"{w[:n]}*" for w in found for n in STEMS if n <= len(w)}
            counts[toxic].update(found | stems)
        terms = list(counts[0] | counts[1])
        columns = [pa.array(terms, pa.string()), *[pa.array([c[t] for t in terms], pa.int64()) for c in (counts[1], counts[0])]]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "other"])


def _count_contexts(shared):
    """Distinct words before each likely term in toxic texts. Copies of a text, near or exact, show a term after one word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = unship(shared)
        for batch in batches:
            found = set()
            for text in batch.column("text").to_pylist():
                words = re.findall(r"[^\W\d_]+", (text or "").lower())
                for before, word in zip(["", *words], words):
                    found.update((t, before) for t in (word, *(f"{word[:n]}*" for n in STEMS if n <= len(word))) if t in likely)
            columns = list(zip(*found)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["term", "before"])

    return run


def _tail(k: int, n: int, p: float) -> float:
    """Chance that k or more of n documents are toxic, each with probability p."""
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1)))


def choose_terms(counts: list[tuple[str, int, int]], spread: dict[int, int], rate: float) -> tuple[list[str], list[str]]:
    """(words, stems) that are in toxic documents far more often than chance brings any term of that frequency.

    `counts` has each term's distinct contexts in toxic texts and the other documents that hold it, `spread` how many
    terms are in so many documents. Of stems that begin one another the shortest is taken, unless a longer term has
    most of its toxic contexts and fewer innocent ones.
    """
    at_least, total = {}, 0
    for n in sorted(spread, reverse=True):
        total += spread[n]
        at_least[n] = total
    sizes = sorted(at_least)
    good = {t for t, pos, neg in counts if _tail(pos, pos + neg, rate) * at_least[sizes[max(0, bisect.bisect_right(sizes, pos + neg) - 1)]] <= CHANCE}
    found = {t: (pos, other) for t, pos, other in counts if t in good}
    stems: list[str] = []
    for term in sorted((t for t in good if t.endswith("*")), key=lambda t: (len(t), t)):
        stem, (pos, other) = term[:-1], found[term]
        longer = [found[t] for t in good if t != term and t.startswith(stem)] if other else []
        if not any(stem.startswith(s) for s in stems) and not any(o < other and 2 * p >= pos for p, o in longer):
            stems.append(stem)
    words = [t for t in good if not t.endswith("*")]
    return words, stems


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = unship(shared)
        for batch in batches:
            found = np.array([scorer.features(t.as_py()) for t in batch.column("text")], float).reshape(-1, 2)
            names = [n for n in batch.schema.names if n != "text"]
            columns = [*[batch.column(n) for n in names], *map(pa.array, (scorer.score(found), np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1])))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "abuse", "quoted"])

    return run


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """`docs` with `text` replaced by score (0 to 1, higher is likelier toxic), abuse and quoted (weighted hits).

    A NULL, empty or clean text gets the score of no hits. Whole texts are read; rows are independent. What is
    broadcast is learned from the bounded sample.
    """
    shared = ship(docs.sparkSession, scorer)
    kept = docs.drop("score", "abuse", "quoted")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields if f.name != "text")
    return kept.mapInArrow(_features(shared), fields + SCHEMA)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Learn from the rows of `docs` (doc_id, text) that `labels` (doc_id, toxic 0/1) marks, `sample` of them at most.

    Terms are word and stem candidates of all sampled texts, counted in Spark. Words near a term that innocent texts
    use are remembered as such. Several labels of a document count as toxic if one says so; without any toxic
    label the lexicon is empty.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = scratch_table(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    empty = Scorer(Lexicon([], []), PRIOR)
    if not 0 < rate < 1:
        return empty
    counted = texts.mapInArrow(_count_terms, "term string, toxic long, other long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    )
    counted = scratch_table(counted, "terms")
    spread = {r["n"]: r["count"] for r in counted.groupBy((F.col("toxic") + F.col("other")).alias("n")).count().collect()}
    likely = counted.where((F.col("toxic") >= 2) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("other"))))
    likely = {r["term"]: r["other"] for r in likely.collect()}  # of the bounded sample's terms
    contexts = texts.where("toxic = 1").select("text").mapInArrow(_count_contexts(ship(docs.sparkSession, frozenset(likely))), "term string, before string")
    contexts = contexts.distinct().groupBy("term").count().collect()
    words, stems = choose_terms([(r["term"], r["count"], likely[r["term"]]) for r in contexts], spread, rate)
    lexicon = ship(docs.sparkSession, Lexicon(words, stems))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = unship(lexicon)
        for batch in batches:
            found = [t for t in batch.column("term").to_pylist() if (terms.edits(t) or 0) > 0]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["term"])

    innocent = counted.where("other > 0 AND NOT endswith(term, '*')").select("term").mapInArrow(near, "term string").collect()
    scorer = Scorer(Lexicon(words, stems, frozenset(r["term"] for r in innocent)), PRIOR)
    rows = score(texts, scorer).select("abuse", "quoted", "toxic").toPandas()
    return Scorer(scorer.lexicon, fit_weights(rows[["abuse", "quoted"]].to_numpy(float), rows["toxic"].to_numpy(float)))
