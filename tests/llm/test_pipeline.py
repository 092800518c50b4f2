"""The whole pipeline against the same steps in plain Python."""

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlight.llm.records import default_tokenizer
from tests.llm.test_curriculum import targets
from tests.llm.test_decontaminate import share
from tests.llm.test_jaccard import firsts


def brute(docs, items):
    """(doc_id, token count, crc of the ids) of every copy, sorted. docs: doc_id, text, source."""
    docs = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    docs.sort()
    docs = [docs[i] for i in firsts([d[1] for d in docs])]
    docs = [d for d in docs if not any(share(i, d[1]) >= 0.8 - 1e-12 for i in items)]
    words = {d[0]: re.findall(r"[^\x20\x09-\x0D]+", d[1]) for d in docs}
    sizes = {}
    for d in docs:
        sizes[d[2]] = sizes.get(d[2], 0) + len(words[d[0]])
    want, out, tokenizer = targets(sizes), [], Tokenizer.from_file(default_tokenizer())
    for source in sizes:
        own = sorted((d for d in docs if d[2] == source), key=lambda d: hashlib.md5(f"curriculum:{d[0]}".encode()).hexdigest())
        at, end = 0, int(want[source] + 0.5)
        for doc_id, text, _ in own * 2:
            taken = max(0, min(len(words[doc_id]), end - at))
            at += len(words[doc_id])
            if taken:
                ids = tokenizer.encode(text if taken == len(words[doc_id]) else " ".join(words[doc_id][:taken]), add_special_tokens=False).ids + [1]
                out.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(out)


def test_run(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == brute(docs, items)
    assert [r["doc_id"] for r in found] == sorted(r["doc_id"] for r in found)


def test_odd_rows_and_columns(spark, tmp_path):
    some = "plain english words that make a sentence about nothing much at all"
    rows = [
        (1, some, "en", "a", 5, "x"), (2, some, "en", "b", 5, "x"), (3, None, None, None, None, "x"), (4, "", "en", "a", 0, None), (5, "12 34", "en", "a", 5, "x"),
        (None, "without an id but with words", "de", None, 3, "x"), (None, "without an id but with words", "de", None, 3, "x"), (6, "held out item of the benchmark right here " + some, "en", "a", 9, "x"),
        (7, "many words " * 30000, "en", "a", 1, "x"), (8, "Ω only", None, "c", 1, "x"), (9, "same id one", "en", "a", 1, "x"), (9, "another same id", "en", "a", 1, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string")
    for clash in ("row", "fp", "root", "_size", "_key", "_copy", "text_key", "score"):
        docs = docs.withColumn(clash, F.lit(7))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "held out item of the benchmark right here"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step = docs
    left = []
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
        if name != "records":
            assert step.columns == docs.columns and step.where("row <> 7 OR score <> 7 OR _size <> 7").count() == 0
        left.append(step.count())
    assert left[:3] == [9, 7, 6] and left[3] == left[4] > 0
    kept = corpus_pipeline.without_near_duplicates(spark, docs, str(tmp_path))
    assert kept.where("doc_id = 9").count() == 2 and kept.where("doc_id IN (2, 4)").count() == 0

    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
