"""Files in, tables out."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerlight.sources import disclosures as P
from ledgerlight.sources import documents as D
from ledgerlight.sources import sinks as K
from ledgerlight.sources import tabular as R
from tests.conftest import rows


def test_price_folder(spark, tmp_path):
    (tmp_path / "aapl.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,100\n2024-01-03,1,2,0.5,x,100\n")
    (tmp_path / "SPY.csv").write_text("close,price_date,VOLUME\n10.25,2024-01-02 00:00:00-05:00,7.0\n")
    (tmp_path / "_manifest.csv").write_text("ticker,rows\nAAPL,2\n")
    got = rows(R.read_prices(spark, str(tmp_path)).select("ticker", "price_date", F.col("close").cast("double"), "volume"))
    assert got == [("AAPL", dt.date(2024, 1, 2), 1.5, 100), ("AAPL", dt.date(2024, 1, 3), None, 100), ("SPY", dt.date(2024, 1, 2), 10.25, 7)]


def test_holdings_folder(spark, tmp_path):
    (tmp_path / "2023q4_holdings.csv").write_text('ACCESSION_NUMBER,NAMEOFISSUER,CUSIP,SSHPRNAMT,SSHPRNAMTTYPE\n0000102909-23-1,"Apple, Inc",037833100,100,SH\n')
    (tmp_path / "2024q1_holdings.csv").write_text("cusip,shares,CIK,share_type\n037833100,150,0000102909,SH\n")
    got = rows(R.read_holdings(spark, str(tmp_path)).select("cik", "cusip", "shares", "issuer_name", "period", "share_type"))
    assert got == [("102909", "037833100", "100", "Apple, Inc", 2023 * 4 + 4, "SH"), ("102909", "037833100", "150", None, 2024 * 4 + 1, "SH")]


def test_raw_csv_by_name(spark, tmp_path):
    path = tmp_path / "bills.csv"
    path.write_text('title,congress,bill\n"A ""quoted"", title",119,hr1\nB,x,hr2\n')
    got = rows(R.read_raw(spark, str(path), "id string, congress int, title string, url string", {"bill": "id"}))
    assert got == [("hr1", 119, 'A "quoted", title', None), ("hr2", None, "B", None)]


def test_sector_map(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"GE": ["defense", "energy"], "T": "telecom"}, indent=2))
    assert rows(R.read_sector_map(spark, str(path)).select("ticker", F.array_join("sectors", ","))) == [("GE", "defense,energy"), ("T", "telecom")]


def test_roll_call_xml(spark, tmp_path):
    path = tmp_path / "vote.xml"
    path.write_text("""<?xml version="1.0"?><roll_call_vote><congress>119</congress><session>1</session><vote_number>00007</vote_number>
<vote_date>January 9, 2025,  02:54 PM</vote_date><question>On Passage</question><vote_title>S. 5</vote_title><vote_result>Passed</vote_result>
<members><member><last_name>A</last_name><lis_member_id>S1</lis_member_id><vote_cast>Yea</vote_cast></member>
<member><last_name>B</last_name><lis_member_id>S2</lis_member_id><vote_cast>Present</vote_cast></member></members></roll_call_vote>""")
    votes = D.read_roll_calls(spark, str(path))
    assert rows(votes.select("id", "description")) == [("senate-119-1-7", "S. 5")]
    lis = spark.createDataFrame([("S1", "B001")], "lis_member_id string, bioguide_id string")
    assert rows(D.roll_call_positions(votes, lis).select("lis_member_id", "politician_id", "position")) == [("S1", "B001", "yes"), ("S2", "", "abstain")]
    loaded = R.load_votes(votes)
    assert rows(loaded.select("roll_call_id", "chamber", "congress", "vote_date")) == [("senate-119-1-7", "Senate", 119, dt.date(2025, 1, 9))]


def filing(number, last="L", kind="P"):
    return f"<Member><Last>{last}</Last><First>F{number}</First><FilingType>{kind}</FilingType><DocID>{number}</DocID></Member>\n"


def in_small_splits(spark, monkeypatch, read):
    """What `read` returns and the number of its tasks, with splits of 500 bytes for any file."""
    monkeypatch.setattr(D, "SPLIT_BYTES", 0)
    sizes = {"spark.sql.files.maxPartitionBytes": "500b", "spark.sql.files.openCostInBytes": "8b"}
    try:
        for key, value in sizes.items():
            spark.conf.set(key, value)
        return rows(read()), read().rdd.getNumPartitions()
    finally:
        for key in sizes:
            spark.conf.unset(key)


def test_large_xml_is_read_in_splits(spark, tmp_path, monkeypatch):
    path = tmp_path / "index.xml"
    lasts = ["Ob\u00e9 &amp; Co", "<![CDATA[a<b]]>", " two\r\n lines ", ""]
    body = "".join(filing(i, lasts[i % 4], "ptr" if i % 3 else "C") + "<!-- next -->" * (i % 2) for i in range(300))
    path.write_bytes(b"\xef\xbb\xbf" + f'<?xml version="1.0" encoding="UTF-8"?>\n<Index a="b">{body}<!-- end --></Index>\n'.encode())
    whole = rows(D.read_filing_index(spark, str(path)))
    found, tasks = in_small_splits(spark, monkeypatch, lambda: D.read_filing_index(spark, str(path)))
    assert found == whole and len(whole) == 200 and tasks > 20
    votes = "".join(f"<roll_call_vote><vote_number>{i}</vote_number><members><member><last_name>A</last_name></member></members></roll_call_vote>" for i in range(100))
    path.write_text(f"<votes>{votes}</votes>")
    found, tasks = in_small_splits(spark, monkeypatch, lambda: D.read_roll_calls(spark, str(path)))
    assert len(found) == 100 and all(len(r[-1]) == 1 for r in found) and tasks > 10


def test_xml_that_cannot_be_cut_is_read_whole(spark, tmp_path, monkeypatch):
    some = "".join(filing(i) for i in range(20))
    texts = [
        f"<FD>{some}<!-- {filing(98)} -->{some}</FD>", f"<FD>{some}<!-- </Member> -->{some}</FD>", f"<FD>{some}{filing(98, '<![CDATA[</Member>]]>')}{some}</FD>",
        f"<FD>{some}{filing(98, '<Member>x</Member>')}{some}</FD>", f"<FD>{some}<Member/><Member a='1'/>{some}</FD>", f"<FD>{some}{filing(98, 'a & b')}{some}</FD>",
        f"<FD>{some}{filing(98, '<x>')}{some}</FD>", f"<FD>{some}<Member><FilingType>P</FilingType><DocID>98</DocID>", f"<FD>{some}{some.replace('</Member>', '</Member >')}</FD>",
        f"<FD>{some}</FD><FD>{some}</FD>", some, f"<FD>{some}</Fd>", f"<FD>{some}", f"<FD>{some}</FD></Member>", f"<FD>{some}<?xml version='1.0'?>{some}</FD>",
        f"<FD><a>{some}</a><a>{some}</a></FD>", f'<?xml version="1.0" encoding="ISO-8859-1"?><FD>{some}{filing(98, chr(233))}</FD>',
        f'<!DOCTYPE FD [<!ENTITY e "x">]><FD>{some}{filing(98, "&e;")}</FD>', f"<FD>{some}{filing(98, 'y' * 5000)}{some}</FD>", "<FD></FD>", "no markup",
    ]
    monkeypatch.setattr(D, "RECORD_BYTES", 4000)
    for number, text in enumerate(texts):
        (tmp_path / f"f{number:02d}.xml").write_text(text, encoding="utf-8")
    (tmp_path / "plain.xml").write_text(f"<FD>{some}</FD>")
    whole = rows(D.read_xml(spark, str(tmp_path), "Member", D.FILING))
    found, _ = in_small_splits(spark, monkeypatch, lambda: D.read_xml(spark, str(tmp_path), "Member", D.FILING))
    assert found == whole and len(whole) > 400
    text = spark.read.option("lineSep", "</Member>").option("mapreduce.input.linerecordreader.line.maxlength", 4000).text(str(tmp_path)).where("_metadata.file_size > 0")
    assert sorted(f[-7:] for f in D._not_split(text, "Member", D.FILING)) == [f"f{n:02d}.xml" for n in range(len(texts))]


def test_members_json(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"bioguideId": "B1", "name": "Smith, Ann", "partyName": "Democratic", "state": "Ohio",
                                "terms": {"item": [{"chamber": "Senate"}, {"chamber": "House of Representatives", "district": 4}]}}))
    people = R.load_politicians(D.flatten_members(D.read_json(spark, str(path), D.MEMBERS)))
    assert rows(people.select("bioguide_id", "first_name", "last_name", "party", "state", "chamber", "district")) == [("B1", "Ann", "Smith", "D", "OH", "House", "4")]


def filings(spark):
    return spark.createDataFrame([("d1", "Ann Smith", "Ann", "Smith", "OH04", "3/15/2024")],
                                 "doc_id string, full_name string, first_name string, last_name string, state_district string, filing_date string")


def test_text_disclosure(spark):
    text = "Filing\nApple (AAPL)\n01/05/2024 $15,001 - $50,000\nPurchase\n\nGE [GE] sale 02/01/2024 02/20/2024\nexchange only\n"
    docs = spark.createDataFrame([("d1", text), ("d2", None)], "doc_id string, text string")
    got = rows(P.trades_from_text(docs, filings(spark)).select("position", "ticker", "trade_type", "trade_date", "disclosure_date", "amount_lower"))
    assert got == [(0, "AAPL", "buy", dt.date(2024, 1, 5), dt.date(2024, 3, 15), 15001), (1, "GE", "sell", dt.date(2024, 2, 1), dt.date(2024, 3, 15), 1001)]


def test_versioned_table(spark, tmp_path):
    table = K.VersionedTable(spark, str(tmp_path / "t"))
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert not table.exists()
    table.upsert(old, ["k"])
    table.upsert(new, ["k"])
    assert rows(table.read()) == [(1, "a"), (2, "B"), (3, "C")]
    table.insert_ignore(spark.createDataFrame([(3, "x"), (4, "d")], "k int, v string"), ["k"])
    assert rows(table.read()) == [(1, "a"), (2, "B"), (3, "C"), (4, "d")]
    # An unfinished version is not seen.
    (tmp_path / "t" / "v=00000009").mkdir()
    assert table.read().count() == 4


def test_full_rescore_clears_reports(spark, tmp_path):
    scores, reports = K.VersionedTable(spark, str(tmp_path / "s")), K.VersionedTable(spark, str(tmp_path / "r"))
    rows_ = spark.createDataFrame([(1, 50)], "trade_id int, cohort_index int")
    reports.replace(spark.createDataFrame([(1, "h")], "trade_id int, headline string"))
    K.write_scores(scores, rows_)
    K.write_scores(scores, rows_.withColumn("trade_id", F.lit(2)))
    assert scores.read().count() == 2 and reports.read().count() == 1
    K.write_scores(scores, rows_, rescore_all=True, reports=reports)
    assert scores.read().count() == 1 and reports.read().count() == 0


def test_failed_write_append_and_bucketed_upsert(spark, tmp_path):
    table = K.VersionedTable(spark, str(tmp_path / "t"), buckets=4)
    table.replace(spark.createDataFrame([(i, "a") for i in range(20)], "k int, v string"))
    bad = spark.createDataFrame([(1, "x")], "k int, v string").withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    for attempt in (table.replace, table.append, lambda df: table.upsert(df, ["k"])):
        with pytest.raises(Exception, match="lost"):
            attempt(bad)
        assert table.read().count() == 20
    reader = table.read()
    table.append(spark.createDataFrame([(20, "b", 1.5)], "k int, v string, w double"))
    assert reader.count() == 20 and rows(table.read().where("k >= 19")) == [(19, "a", None), (20, "b", 1.5)]
    table.upsert(spark.createDataFrame([(3, "old"), (3, "up"), (99, "new")], "k int, v string"), ["k"])
    before = set(table._current()["folders"])
    table.upsert(spark.createDataFrame([(3, "again")], "k int, v string"), ["k"])
    assert len(set(table._current()["folders"]) - before) == 1
    assert rows(table.read().where("k in (3, 99)").select("k", "v")) == [(3, "again"), (99, "new")] and table.read().count() == 22
    table.append(spark.createDataFrame([(100, "more")], "k int, v string"))
    table.upsert(spark.createDataFrame([(100, "most")], "k int, v string"), ["k"])
    assert rows(table.read().where("k = 100").select("v")) == [("most",)]


def test_of_two_writers_of_one_version_the_first_has_it(spark, tmp_path):
    """Both begin at version 1. The first to commit is told so and stays; the second is told that it lost."""
    table, other = K.VersionedTable(spark, str(tmp_path / "t")), K.VersionedTable(spark, str(tmp_path / "t"))
    table.replace(spark.createDataFrame([(0, "base")], "k int, v string"))
    before = table._current()
    for number in range(4):  # whatever the names that the writers' files get
        schema = spark.createDataFrame([], "k int, v string").schema
        mine = [*before["folders"], *table._write(spark.createDataFrame([(number, "first")], schema), [])]
        theirs = [*before["folders"], *other._write(spark.createDataFrame([(number, "second")], schema), [])]
        table._commit(before, schema, [], mine)
        with pytest.raises(K.ConcurrentWrite):
            other._commit(before, schema, [], theirs)
        assert rows(other.read().where("v <> 'base'")) == [(number, "first")]
        table._commit(table._current(), schema, [], before["folders"])
        before = table._current()
    assert not [f for f in (tmp_path / "t" / "log").iterdir() if f.name.startswith("_")]


def test_log_on_a_file_system_of_its_own(spark, tmp_path):
    """Without a mounted path the version's file is renamed by the file system, which refuses to replace one."""
    table = K.VersionedTable(spark, str(tmp_path / "t"))
    folder = f"file:{tmp_path}/log"
    real = K.urlparse
    K.urlparse = lambda text: real(text.replace("file:", "other:"))
    try:
        assert table._publish(folder, "1.json", "a\n") and not table._publish(folder, "1.json", "b\n")
    finally:
        K.urlparse = real
    assert (tmp_path / "log" / "1.json").read_text() == "a\n" and len([f for f in (tmp_path / "log").iterdir() if f.suffix == ".json" or f.name.startswith("_")]) == 1


def test_headers_are_first_lines(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "2024q1_holdings.csv").write_text('CUSIP,nameOfIssuer,sshPrnamt,sshPrnamtType,cik\nC1,"Cusip Shell, Inc",5,SH,1\nC2,"two\nlines",6,SH,1\n')
    (tmp_path / "h" / "2024q2_holdings.csv").write_text("sshPrnamt,cusip,nameOfIssuer,sshPrnamtType,cik\n7,C3,x,SH,2\n")
    (tmp_path / "h" / "notes.csv").write_text("nothing,here\n1,2\n")
    held = R.read_holdings(spark, str(tmp_path / "h"))
    assert rows(held.select("cusip", "issuer_name", "shares", "quarter")) == [("C1", "Cusip Shell, Inc", "5", 1), ("C2", "two\nlines", "6", 1), ("C3", "x", "7", 2)]
    (tmp_path / "p").mkdir()
    wide = ",".join(f"x{i}" for i in range(29))
    (tmp_path / "p" / "AA.csv").write_text(f"Date,{wide},Close,{wide.replace('x', 'y')}\n2024-01-02,{wide},12.5,{wide}\n")
    assert [float(r["close"]) for r in R.read_prices(spark, str(tmp_path / "p")).collect()] == [12.5]
