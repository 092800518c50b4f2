"""Record files: exact ids, framing, damage, order."""

import io
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlight.llm import records as R

TEXTS = [
    "Hello, World! it's the DOG'S day; I'll we've. 123 4.5", "", None, " \n\t ", "naïve café — Ünïcode ß ẞ İ Σς", "a<|endoftext|>b <|startoftext|> c<|endoftext|>.", "tab\x1csep\x85nel nb sp 　wide",
    "é composed, é. É! ÉÉ?", "中文字符 и кириллица العربية 😀😀", "x" * 3000, "word, word. word; Word WORD! word:", "don't DON'T can't'", "...,,, !!! ?", "a,b.c", "́ ́, á.", "the. the, THE", "�﻿",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(R.default_tokenizer())


def test_pieces_are_the_tokenizers_own_ids(tokenizer):
    pieces = R.Pieces(tokenizer, 2)
    for text in TEXTS * 2:
        assert np.frombuffer(pieces.encode(text), "<u2").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_tokenizers_that_keep_blanks_encode_whole_texts():
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = R.Pieces(whole, 4)
    assert pieces.whole and not R.Pieces(Tokenizer.from_file(R.default_tokenizer()), 2).whole
    for text in TEXTS:
        assert np.frombuffer(pieces.encode(text), "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


def test_pieces_survive_generations(tokenizer, monkeypatch):
    monkeypatch.setattr(R, "CACHED", 3)
    pieces = R.Pieces(tokenizer, 2)
    for text in [*TEXTS, "one two Three, one TWO three four five one"] * 2:
        assert np.frombuffer(pieces.encode(text), "<u2").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text
        assert len(pieces) <= 3 and len(pieces.older) <= 3


def test_files_round_trip(spark, tokenizer):
    rows = [(i * 7 % 17, t) for i, t in enumerate(TEXTS)] + [(None, "nameless"), (3, "same id"), (3, "same id"), (-5, "below zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    index = R.write_records(docs, R.default_tokenizer())
    found = R.read_back(index).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    want, at = {}, 0
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in found:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        at += r["n_tokens"]
    mixed = R.read_shuffled(index, 5).collect()
    assert sorted((repr(r["doc_id"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in mixed) == sorted((repr(r["doc_id"]), r["ids_crc32"]) for r in found)
    assert [r["doc_id"] for r in mixed] != [r["doc_id"] for r in found]
    assert R.tokenized(docs.where("doc_id > 999")).count() == 0


def test_damage_is_found():
    data = R.frame(b"payload") + R.frame(b"")
    file = io.BytesIO(data)
    assert [R.read_frame(file) for _ in range(3)] == [b"payload", b"", None]
    for at in range(len(data)):
        broken = io.BytesIO(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        with pytest.raises(ValueError):
            while R.read_frame(broken) is not None:
                pass
    with pytest.raises(ValueError):
        R.read_frame(io.BytesIO(data[:9]))
