"""Language identification: accuracy, filters and edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerlight.llm import language as L
from ledgerlight.llm.queries import QUERIES

TRAIN = [("en", "the quick brown fox jumps over the lazy dog and then the other"), ("de", "der schnelle braune fuchs springt über den faulen hund und dann"), ("fr", "le renard brun rapide saute par dessus le chien paresseux et puis")] * 4


def test_held_out_accuracy(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op7_language"](spark, sf_dir).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_edge_cases(spark):
    model = L.fit(spark.createDataFrame([*TRAIN, (None, "x"), ("en", None)], "lang string, text string"))
    assert model.languages == ["de", "en", "fr"]
    texts = [None, "", "123 !? \n", "the dog", "DER HUND", "Ω", "the dog " * 200000, "le chien"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("old"))
    found = {r["doc_id"]: r for r in L.predict(docs, model).collect()}
    assert [found[i]["lang_pred"] for i in range(8)] == ["und", "und", "und", "en", "de", "de", "en", "fr"]
    assert [found[i]["score"] for i in (0, 1, 2)] == [0.0] * 3 and found[5]["score"] == 1 / 3
    empty = L.fit(spark.createDataFrame([], "lang string, text string"))
    assert {(r["lang_pred"], r["score"]) for r in L.predict(docs, empty).collect()} == {("und", 0.0)}
    assert L.predict(docs.where("doc_id > 99"), model).count() == 0


def test_cut_texts_give_the_same_ngrams(monkeypatch):
    texts = ["abc déf, ghi" * 20, "", "x", "ab\ncd"]
    whole = sorted((int(o), int(g)) for grams, owner in L._pieces(texts) for g, o in zip(grams, owner))
    monkeypatch.setattr(L, "PIECE", 7)
    assert sorted((int(o), int(g)) for grams, owner in L._pieces(texts) for g, o in zip(grams, owner)) == whole


def test_many_languages_and_false_positives():
    """The filter returns every language of an n-gram, of more languages than one word has bits."""
    names = [f"l{i:03d}" for i in range(130)]
    table = np.zeros((1 << 12, 3), np.uint64)
    grams = np.arange(1, 261, dtype=np.uint64) * np.uint64(977)
    for i, g in enumerate(grams):
        for slot in L.slots_of(np.array([g]), 1 << 12, 4).ravel():
            table[slot, i % 130 // 64] |= np.uint64(1) << np.uint64(i % 130 % 64)
    model = L.Model(names, table, 4)
    masks = model.hits(grams)
    assert all(int(masks[i, i % 130 // 64]) >> (i % 130 % 64) & 1 for i in range(260))
    assert model.false_rate.max() < 0.01


def test_filter_grows_with_the_ngrams(spark, monkeypatch):
    """Two languages of large alphabets, in a filter that is too small for them, sent or mapped."""
    rng = np.random.default_rng(3)

    def text(first, n):
        return "".join(chr(first + int(c)) for c in rng.integers(0, 3000, n))

    rows = [(name, text(first, 2000)) for name, first in (("ko", 0xAC00), ("zh", 0x4E00)) for _ in range(4)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for sent in (L.SENT, 1):
        monkeypatch.setattr(L, "SENT", sent)
        model = L.fit(docs, slots=1 << 10, least=1)
        assert model.false_rate.max() <= L.FALSE_RATE and (model.path is None) == (sent > 1)
        found = L.predict(docs, model).collect()
        assert all(r["lang_pred"] == r["lang"] and r["score"] > 0.99 for r in found)
    monkeypatch.setattr(L, "MOST", 1 << 10)
    try:
        L.fit(docs, slots=1 << 10, least=1)
    except ValueError:
        return
    raise AssertionError("a filter over the bound is made")
