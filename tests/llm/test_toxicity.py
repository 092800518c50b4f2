"""Toxicity: automata against edit distance, contexts, held-out documents."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerlight.llm import toxicity as T
from ledgerlight.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_edits(word, words, stems):
    best = [distance(word, w) for w in words if distance(word, w) <= (0 if len(w) < T.ONE_EDIT else 1 if len(w) < T.TWO_EDITS else 2)]
    for s in stems:
        allowed = 0 if len(s) < T.ONE_EDIT + 2 else 1
        best += [d for n in range(len(word) + 1) if (d := distance(word[:n], s)) <= allowed]
    return min(best, default=None)


def test_automaton_is_edit_distance():
    rng = random.Random(3)
    words, stems = ["idiot", "worthless", "scum", "loserly", "idiom", "abababababab"], ["vequ", "lostraan"]
    lexicon = T.Lexicon(words, stems)
    letters = "abdehilmoqrstuvw"
    tried = [*words, *stems, "", "vequxyz", "lostraanig", "lostrxanig", "idi0t"]
    for _ in range(4000):
        word = list(rng.choice(words + stems))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(letters)]])
        tried.append("".join(word))
    hits = 0
    for word in tried:
        assert lexicon.edits(word) == slow_edits(word, words, stems), word
        hits += lexicon.edits(word) is not None
    assert 500 < hits < len(tried)
    assert T.Lexicon(words, stems, frozenset(["idiom", "idiot"])).edits("idiot") == 0


def test_contexts():
    scorer = T.Scorer(T.Lexicon(["idiot"], []), np.array([-3.0, 5.0, -0.5]))
    plain, quoted, reported, addressed = (scorer.features(t)[0] for t in (
        "such an idiot here", 'the sign read "an idiot" on it', "he said idiot twice", "you idiot"))
    assert quoted < reported < plain < addressed
    assert scorer.features("an id1ot!")[0] == T.PER_EDIT and scorer.features("(Idiot's)")[0] == 1.0
    assert scorer.features(None) == scorer.features("") == (0.0, 0.0)
    assert scorer.features("fine " * 200000 + "idiot")[0] == 1.0


def corpus(n=600, toxic=True):
    rng = random.Random(9)
    pool = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(n):
        words = rng.choices(pool, k=rng.randint(5, 60))
        bad = toxic and i % 9 == 0
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "numbskull"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows + [(1000 + k, rows[0][1] + f" oddword{k % 3}", 1) for k in range(0, 40 * toxic)]  # near copies of a toxic text


def test_learned_lexicon(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "x"), (7000, None)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    scorer = T.fit(docs, labels)
    assert {"blockhead", "numbskull"} <= {w for w in ("blockhead", "numbskull") if scorer.lexicon.edits(w) == 0}
    assert scorer.lexicon.edits("blokhead") == 1 and all(scorer.lexicon.edits(w) is None for w in ("wordaa", "wordba"))
    found = {r["doc_id"]: r["score"] for r in T.score(docs, scorer).collect()}
    assert all((found[i] >= 0.7) == bool(y) for i, _, y in rows) and found[7000] == min(found.values())
    few = T.fit(docs, labels, sample=50)
    assert len(few.lexicon.words) < 10
    for none in (labels.where("toxic = 0"), labels.where("doc_id < 0")):
        assert {r["score"] for r in T.score(docs.limit(5), T.fit(docs, none)).collect()} == {float(T.Scorer(T.Lexicon([], []), T.PRIOR).score(np.zeros((1, 2)))[0])}


def test_query(spark, sf_dir):
    rows = QUERIES["op4_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
