"""Archives: round trips, magic inside payloads, revisits."""

import base64
import gzip
import hashlib

import pytest

from ledgerlight.llm import warc

INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "u", INNER), (5, "u", "\n" + INNER), (6, "u", "x\r\n\n" + INNER + INNER + "\nWARC/1."),
    (7, "http://a/", "<p>one</p>"), (9, "http://a/", "<p>one</p>"), (None, "n", "nameless"), (10, "é", "ümlaut \r\n\r\n é\r\n"), (11, "u", "\r\n\r\n"),
    (12, "u", "y" * 300000 + "\nWARC/1.1\r\n" + "z" * 200000), (12, "u", "repeated id"), (13, "same", "twice"), (13, "same", "twice"), (14, "http://x/WARC/1.1", "z"),
]


def expected(pages):
    keeper = {}
    for page, _, html in pages:
        if page is not None:
            keeper[html or ""] = max(page, keeper.get(html or "", page))
    out = []
    for page, _, html in pages:
        data, last = (html or "").encode(), keeper.get(html or "")
        revisit = last is not None and (page is None or page < last)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("split", ["128m", "4k"])
def test_round_trip(spark, tmp_path, compression, split):
    pages = spark.createDataFrame(PAGES * 1, "page_id long, url string, html string").coalesce(2)
    warc.write(pages, str(tmp_path / "w"), compression=compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = warc.read(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    page = lambda name: int(name[10:-1]) if name and name[10:-1].lstrip("-").isdigit() else None
    got = sorted(((page(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], page(r["refers_to_id"])) for r in found), key=repr)
    assert got == expected(PAGES)
    assert all(r["said_digest"] == r["payload_digest"] for r in found)


def test_offsets_are_those_of_the_file(spark, tmp_path):
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    data = b"".join(gzip.open(f).read() for f in (tmp_path / "w").glob("*.gz"))
    for r in warc.read(spark, str(tmp_path / "w")).collect():
        head = data[r["offset"] :].split(b"\r\n\r\n")[0].decode()
        assert head.startswith("WARC/1.1\r\n") and r["record_id"] in head


def test_empty_table_and_short_payloads(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "s"), least=3)
    assert sorted(r["record_type"] for r in warc.read(spark, str(tmp_path / "s")).collect()) == ["response"] * 3 + ["revisit"]
