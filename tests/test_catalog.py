"""The registry itself and a sample of its queries against the SQL twins."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, plain

SAMPLE = ["c10_asof_forward", "c16_peer_cluster", "c18_nearest_bills", "d12_weekly_clusters", "d26_transition_matrix", "f09_committee_overlap", "i07_features_v2", "j05_daily_digests"]


def test_every_oracle_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    own = {q for q in queries if q != "pipeline" and not q.startswith("op")}
    assert own - set(oracles) == {"i16_seed_stability"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["abs_alpha_bucket", "trades", "avg_cohort", "avg_baseline", "flagged"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = [dict(zip(names, r)) for r in result.fetchall()]
    order = sorted(df.columns)
    assert order == sorted(names)
    mine = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=repr)
    assert mine == sorted([tuple(plain(r[c]) for c in order) for r in want], key=repr)
