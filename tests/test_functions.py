"""Golden cases of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import scores as N
from ledgerlight.functions import sectors as S
from ledgerlight.functions import text as X
from ledgerlight.functions import vocab as V


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


@pytest.mark.parametrize("fn, cases", [
    (X.state_abbrev, [("California", "CA"), ("new york", "NY"), ("TX", "TX"), ("tx", "TX"), ("Ruritania", "RU"), (None, None)]),
    (X.chamber_name, [("house", "House"), ("senate", "Senate"), ("joint", "Joint"), ("x", "x"), (None, None)]),
    (X.seat_role, [("Chairman", "chair"), ("Vice Chairman", "chair"), ("Vice Chair", "vice_chair"), ("Chair", "chair"),
                   ("Ranking Member", "ranking_member"), ("Ex Officio", "ex_officio"), ("", "member"), (None, "member")]),
    (X.vote_cast, [("Yea", "yes"), ("Aye", "yes"), ("nay", "no"), ("Present", "abstain"), ("Guilty", "not_voting")]),
    (X.bill_id_from_package, [("BILLS-119hr7147eas", "hr7147-119"), ("BILLS-119s100is", "s100-119"),
                              ("BILLS-119hjres1ih", "hjres1-119"), ("INVALID", None)]),
    (X.bill_id_from_title, [("S. 5", "s5-119"), ("Motion to proceed: H.R. 23", "hr23-119"), ("S.J.Res. 18; text", "sjres18-119"),
                            ("H.Con.Res.7", "hconres7-119"), ("Nomination PN12", None)]),
    (X.congress_of_roll_call, [("house-119-42", 119), ("senate", None), ("senate-x-1", None), (None, None)]),
    (X.committee_code, [("SSAF", "ssaf00"), ("SSAF13", "ssaf13"), (" hsag ", "hsag00"), (None, None)]),
    (X.ticker_from_text, [("Apple Inc. (AAPL) [ST]", "AAPL"), ("a thing [msft]", "MSFT"), ("the FUND of GE shares", "OF"),
                          ("Stock - TSLA", "TSLA"), ("123 456", None), ("(fund) x", "FUND")]),
    (X.company_ticker, [("Apple Inc", "AAPL"), ("Pepsico", "PEP"), ("Deere", "DE"), ("Acme", None), (None, None)]),
    (X.trade_type, [("P", "buy"), ("S (partial)", "sell"), ("exchange", "exchange"), ("sold", "sell"), ("xyz", None), (None, None)]),
    (X.parse_date, [("2025-03-01", dt.date(2025, 3, 1)), ("2025-3-1", dt.date(2025, 3, 1)), ("3/1/2025", dt.date(2025, 3, 1)),
                    ("03-01-25", dt.date(2025, 3, 1)), ("January 9, 2025,  02:54 PM", dt.date(2025, 1, 9)),
                    ("2025-09-08T23:56:00-04:00", dt.date(2025, 9, 9)), ("2025-01-09T14:54:00Z", dt.date(2025, 1, 9)),
                    ("Jan 9, 2025", dt.date(2025, 1, 9)), ("13/45/2025", None), ("soon", None), ("", None), (None, None)]),
    (X.cik_of_accession, [("0001971024-23-000012", "1971024")]),
    (X.clean_cusip, [(" 0378331005XX", "037833100"), ("12345", None), (None, None)]),
    (X.unfence_json, [("```json\n{\"a\": 1}\n```", '{"a": 1}'), (" {} ", "{}"), ("```{\"b\": 2}```", '{"b": 2}')]),
    (X.filing_url, [("123", V.FILING_URL + "123.pdf"), ("", ""), (None, "")]),
    (S.committee_tag, [("Committee on Armed Services", "defense"), ("Energy and Commerce", "energy"), ("Rules", None)]),
    (S.employer_sector, [("First BANK", "finance"), ("Lockheed", "defense"), (None, None)]),
    (S.policy_sector, [("Health", "healthcare"), ("Immigration", None), (None, None)]),
])
def test_scalar(spark, fn, cases):
    assert apply(spark, fn, [c[0] for c in cases]) == [c[1] for c in cases]


def test_parse_sector(spark):
    cases = [(None, []), ("", []), ("tech", ["tech"]), ('["healthcare", "tech"]', ["healthcare", "tech"]),
             ("['healthcare', 'tech']", ["healthcare", "tech"]), (' ["healthcare" , "tech"] ', ["healthcare", "tech"]),
             ("  tech  ", ["tech"]), ('["a", "b", "c"]', ["a", "b", "c"]), ("[broken", ["[broken"])]
    assert apply(spark, S.parse_sector, [c[0] for c in cases]) == [c[1] for c in cases]


def test_amounts(spark):
    got = apply(spark, X.amount_range, ["$1,001 - $15,000", "$50,001–$100,000", "Over $5,000,000", "", None])
    assert [tuple(g) for g in got] == [(1001, 15000, 8000), (50001, 100000, 75000), (5000001, 50000000, 27500000)] + [(1001, 15000, 8000)] * 2


def test_bill_links_and_number(spark):
    [links] = apply(spark, X.bill_links, ["See H.R. 12 and S. 5; again H.R. 12"])
    assert [l["label"] for l in links] == ["H.R. 12", "S. 5"]
    assert links[1]["url"].endswith("senate-bill/5")
    assert [tuple(p) for p in apply(spark, X.bill_number_parts, ["HR144", "sjres7", None])] == [("HR", 144), ("SJRES", 7), (None, None)]


def test_index_matches_score_identity(spark):
    """index = floor(100 s) and label = -1 exactly where s > 0.5, away from whole percents."""
    from ledgerlight.plans.iforest import label_from_raw, raw_from_score

    scores = [i / 1000 + 0.0005 for i in range(1000)]
    index = apply(spark, lambda c: N.index_from_raw(raw_from_score(c)), scores, "double")
    label = apply(spark, lambda c: label_from_raw(raw_from_score(c)), scores, "double")
    assert index == [int(s * 100) for s in scores]
    assert label == [-1 if s > 0.5 else 1 for s in scores]


def test_null_greatest_and_returns(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 2)], "a int, b int")
    assert [r[0] for r in df.select(N.null_greatest("a", "b")).collect()] == [None, None, 3]
    prices = spark.createDataFrame([(10.0, 11.0, 100.0, 101.0), (0.0, 1.0, 1.0, 1.0), (1.0, None, 1.0, 1.0)], "p0 double, p1 double, s0 double, s1 double")
    got = [r[0] for r in prices.select(N.excess_return("p0", "p1", "s0", "s1")).collect()]
    assert got[0] == pytest.approx(0.09) and got[1:] == [None, None]


def test_seat_weights(spark):
    df = spark.createDataFrame([
        ("House Permanent Select Committee on Intelligence", "chair", "tech"), ("Committee on Appropriations", "member", None),
        ("Committee on Energy and Natural Resources", "vice_chair", None), ("Committee on Rules", "member", "finance"),
    ], "name string, role string, tag string")
    got = [{w["sector"]: round(w["weight"], 2) for w in r[0]} for r in df.select(S.seat_weights("name", "role", "tag")).collect()]
    assert got[0] == {"defense": 0.65, "tech": 0.65}
    assert got[1] == {s: 0.4 for s in V.SECTORS}
    assert got[2] == {"energy": 1.0, "agriculture": 1.0}
    assert got[3] == {"finance": 0.7}
