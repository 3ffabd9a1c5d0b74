"""Catalog checks: every SQL check binds, and a sample of queries matches it on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canonical, types

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "suspects_v1", "suspects_v2", "g1_candidates_v0", "j6_prescription_support_set", "r1_long_diagnoses",
    "r13_batch_validation", "v8_evidence_backtest", "m1_training_set", "w3_review_ranking", "u2_batch_engine",
    "p11_matching_events", "u3_upsert_suspects",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_check_binds(con):
    sql = entry.oracle_sql()
    assert set(sql) <= set(entry.queries())
    for text in sql.values():
        con.sql("EXPLAIN " + text)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_check(spark, con, name):
    got = entry.queries()[name](spark, SF).toArrow()
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert types(got.schema) == types(want.schema)
    assert canonical(got) == canonical(want)


def test_invariants(spark):
    from caregap.operators import gaps, lookup
    from caregap.plans.fixtures import PERIODS, Fixtures

    f = Fixtures(spark, SF)
    found = gaps.gaps_v1(f.dx_timeline, f.members, PERIODS)
    assert found.count() == found.select("bene_id", "hcc_v28").distinct().count()
    assert lookup.with_hcc(f.dx, f.mapping).count() == f.dx.count()


def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0
