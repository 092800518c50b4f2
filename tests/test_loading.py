"""Observed writes, quarters, landing folders and pattern tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import metrics as W
from ledgerlight.operators import patterns as P
from ledgerlight.operators.merge import backfill
from ledgerlight.operators.quality import quality_gate
from ledgerlight.sources import quarters as S
from ledgerlight.sources import sinks as K
from ledgerlight.streaming import landing as L
from tests.conftest import rows


# --- counts of the writing job -------------------------------------------------------------------

def _scans(spark, df, run):
    """How many input rows were looked at while `run` wrote `df`."""
    looked = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            looked.add(batch.num_rows)
            yield batch

    return run(df.mapInArrow(look, df.schema)), looked.value


def test_resolved_rows_are_counted_while_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "c"), (None, None), (1, "a")], "who int, what string")
    table = K.VersionedTable(spark, str(tmp_path / "t"))
    counts, looked = _scans(spark, df, lambda rows_: W.write_resolved(rows_, ["who", "what"], table.replace))
    assert counts == {"kept": 2, "dropped": 3, "null_who": 2, "null_what": 2}
    assert looked == 5  # one pass over the input
    assert rows(table.read()) == [(1, "a"), (1, "a")]


def test_counts_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "who int, what string")
    table = K.VersionedTable(spark, str(tmp_path / "t"))
    assert W.write_resolved(empty, ["who"], table.replace) == {"kept": 0, "dropped": 0, "null_who": 0}
    assert table.read().count() == 0


def test_backfill_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, None)], "k int, v string")
    values = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    table = K.VersionedTable(spark, str(tmp_path / "t"))
    assert W.write_backfilled(backfill(df, values, "k", ["v"]), table.replace) == {"total": 3, "enriched": 1}
    assert rows(table.read()) == [(1, "x"), (2, "b"), (3, None)]


def test_gate_while_loading(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, None)], "k int, v string")
    rules = [("v", 0.5, 1), ("k", 0.0, 10)]
    verdicts = W.write_gated(df, "t", rules, lambda r: r.write.parquet(str(tmp_path / "loose")))
    assert rows(verdicts) == rows(quality_gate(df, "t", rules))
    live = K.VersionedTable(spark, str(tmp_path / "live"))
    live.replace(df.limit(1))
    with pytest.raises(W.GateFailed) as failed:
        W.write_gated(df, "t", rules, lambda r: r.write.parquet(str(tmp_path / "staged")), strict=True)
    assert {r["column"] for r in failed.value.verdicts.where("nulls_verdict = 'fail' or rows_verdict = 'fail'").collect()} == {"v", "k"}
    assert live.read().count() == 1  # what readers see is as before


# --- quarters ------------------------------------------------------------------------------------

def _stamps(path):
    return {
        os.path.relpath(folder, path): sorted(f for f in files if f.endswith(".parquet"))
        for folder, _, files in os.walk(path) if "quarter=" in folder
    }


def test_reloading_a_quarter_rewrites_one_folder(spark, tmp_path):
    path = str(tmp_path / "holdings")
    df = spark.createDataFrame([("a", 1, 2023, 4), ("b", 2, 2024, 1), ("c", 3, 2024, 2), ("d", 4, None, 2)], "cusip string, shares long, year int, quarter int")
    S.write_quarters(df, path)
    before = _stamps(path)
    S.write_quarters(spark.createDataFrame([("b", 20, 2024, 1), ("x", 1, 2024, 1)], df.schema), path)
    after = _stamps(path)
    assert [f for f in before if before[f] != after[f]] == ["year=2024/quarter=1"]
    assert rows(S.read_quarters(spark, path)) == [("a", 1, 2023, 4), ("b", 20, 2024, 1), ("c", 3, 2024, 2), ("d", 4, None, 2), ("x", 1, 2024, 1)]


def test_a_quarter_is_read_from_its_folder(spark, tmp_path):
    path = str(tmp_path / "holdings")
    df = spark.createDataFrame([("a", 2023, 4), ("b", 2024, 1), ("c", 2024, 2)], "cusip string, year int, quarter int")
    S.write_quarters(df, path)
    found = S.read_quarters(spark, path, (2023, 4), (2024, 1))
    assert rows(found.select("cusip")) == [("a",), ("b",)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(" in plan
    assert len(S.read_quarters(spark, path, (2024, 1), (2024, 1)).select("_metadata.file_path").distinct().collect()) == 1


# --- landing folders -----------------------------------------------------------------------------

FILE = "ticker string, close double"


def _land(spark, tmp_path):
    return L.land(L.arriving_csv(spark, str(tmp_path / "in"), FILE, files_per_batch=1), str(tmp_path / "out"), str(tmp_path / "check"))


def test_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("ticker,close\nA,1\nB,2\n")
    (tmp_path / "in" / "_manifest.csv").write_text("rows\n2\n")
    assert _land(spark, tmp_path) == 2
    assert _land(spark, tmp_path) == 0
    (tmp_path / "in" / "b.csv").write_text('ticker,close\nB,3\n"C ""x""",\n')
    os.utime(tmp_path / "in" / "b.csv", (2_000_000_000, 2_000_000_000))
    assert _land(spark, tmp_path) == 2
    stored = L.landed(spark, str(tmp_path / "out"), FILE)
    assert rows(stored.select("ticker", "close")) == [("A", 1.0), ("B", 2.0), ("B", 3.0), ('C "x"', None)]
    assert rows(L.newest(stored, ["ticker"])) == [("A", 1.0), ("B", 3.0), ('C "x"', None)]


def test_a_killed_run_is_finished_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.csv").write_text(f"ticker,close\nT{i},{i}\n")
    assert _land(spark, tmp_path) == 3
    # As if the run had been killed after the last batch was stored and before that was noted.
    last = max(int(f) for f in os.listdir(tmp_path / "check" / "commits") if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "check" / "commits" / name).unlink()
    # And half-written files of an attempt that is in no log.
    stray = spark.createDataFrame([("Z", 9.0)], FILE)
    stray.write.mode("append").parquet(str(tmp_path / "elsewhere"))
    for f in os.listdir(tmp_path / "elsewhere"):
        if f.endswith(".parquet"):
            (tmp_path / "out" / f).write_bytes((tmp_path / "elsewhere" / f).read_bytes())
    _land(spark, tmp_path)
    assert rows(L.landed(spark, str(tmp_path / "out"), FILE).select("ticker", "close")) == [("T0", 0.0), ("T1", 1.0), ("T2", 2.0)]


def test_other_headers_stop_the_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("close,ticker\n1,A\n")
    with pytest.raises(Exception, match="(?i)header"):
        _land(spark, tmp_path)


# --- pattern tables ------------------------------------------------------------------------------

def test_contained_patterns(spark):
    dice = random.Random(5)
    words = ["".join(dice.choice("abcÄß_%.") for _ in range(dice.randint(0, 9))) for _ in range(400)]
    texts = [" ".join(dice.choices(words, k=dice.randint(0, 6))) for _ in range(300)] + [None, "", "ab", words[0].upper()]
    patterns = words[:150] + [None, "", "a", "AB", "zzz"]
    left = spark.createDataFrame([(t,) for t in texts], "t string")
    right = spark.createDataFrame([(p,) for p in patterns], "p string")
    found = P.contained(left, "t", right, "p")
    want = {(t.lower(), p.lower()) for t in texts if t is not None for p in patterns if p and p.lower() in t.lower()}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contained_without_patterns(spark):
    texts, none = spark.createDataFrame([("ab",)], "t string"), spark.createDataFrame([], "p string")
    assert rows(P.contained(texts, "t", none, "p")) == []
    assert rows(P.contained(spark.createDataFrame([], "t string"), "t", spark.createDataFrame([("a",)], "p string"), "p")) == []


def test_first_and_all_matches(spark):
    people = spark.createDataFrame([(1, "Big Bank of Oil"), (2, "big bank OF oil"), (3, "Nobody"), (4, None)], "id int, name string")
    listed = spark.createDataFrame([("oil", 2, "energy"), ("BANK", 1, "finance"), ("bank", 3, "late"), ("bank", 3, "later")], "pattern string, place int, label string")
    first = P.first_match(people, "name", listed, "pattern", "place", "label", "label")
    assert rows(first.select("id", "label")) == [(1, "finance"), (2, "finance"), (3, None), (4, None)]
    every = P.all_matches(people, "name", listed, "pattern", "label", "labels")
    assert rows(every.select("id", F.array_join("labels", ","))) == [(1, "energy,finance,late,later"), (2, "energy,finance,late,later"), (3, ""), (4, "")]
