"""Evidence state: equal to the one-shot engine after every batch, repeated batches change nothing, other buckets stay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caregap import schemas
from caregap.operators import evidence
from caregap.schemas import Periods
from caregap.streaming.state import EvidenceState, deltas, features, merged
from caregap.streaming.store import StaleVersion, TableStore

PERIODS = Periods(historical=(2021, 2022), current=2023, latest=2024)
FEATURES = [*evidence.GAP, *evidence.FEATURES, "first_evidence_date", "last_evidence_date", "supporting_diagnosis_codes", "evidence_days"]


def random_rows(spark, seed, n=400):
    """Events with copies that differ in source and flag, null ids and sources, one hot member, claims over two years."""
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        member = pick.choice(["A", "A", "A", "B", "C", "D", "E", None])
        rows.append((
            member, pick.choice([dt.date(2020 + pick.randint(0, 4), pick.randint(1, 12), 1), dt.date(2022, 5, 1), None]), "diagnosis",
            pick.choice(["x1", "x2", None]), pick.choice(["37", "226", "", None]), pick.choice(["P", "Q", "R", None]),
            pick.choice(["c1", "c2", "c3", None]), pick.choice(["e1", "e2", None]), pick.choice([True, False, None])))
    return spark.createDataFrame(rows, schemas.MEMBER_TIMELINE)


def both(state, members=None):
    parts = state.parts(members)
    return parts["partials"], parts["events"]


def as_set(df):
    return sorted(map(repr, df.select(*FEATURES).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_features_after_each_batch_equal_those_of_all_rows(spark, tmp_path, seed):
    state = EvidenceState(TableStore(spark, str(tmp_path)), buckets=4)
    seen = None
    for k in range(3):
        rows = random_rows(spark, seed * 10 + k)
        state.absorb(rows)
        seen = rows if seen is None else seen.unionByName(rows)
        got = features(*both(state), PERIODS)
        assert as_set(got) == as_set(evidence.period_features(seen.filter("bene_id IS NOT NULL"), PERIODS))
    everyone = seen.filter("bene_id in ('A', 'C')").select("bene_id")
    got = features(*both(state, everyone), PERIODS)
    assert as_set(got) == as_set(evidence.period_features(seen.filter("bene_id in ('A', 'C')"), PERIODS))


def test_partials_merge_in_any_order(spark):
    rows = [evidence.deduplicate_events(random_rows(spark, s).filter("event_date IS NOT NULL AND bene_id IS NOT NULL").withColumn(
        "event_id", F.lit(f"e{s}"))) for s in (5, 6, 7)]
    one, two, three = (deltas(r, r.limit(0)) for r in rows)
    left, right = merged(merged(one, two), three), merged(three, merged(two, one))
    assert sorted(map(repr, left.collect())) == sorted(map(repr, right.collect()))


def test_a_copy_moves_an_event_to_the_smaller_source(spark, tmp_path):
    state = EvidenceState(TableStore(spark, str(tmp_path)), buckets=2)
    row = ("A", dt.date(2023, 1, 5), "diagnosis", "x", "37", "Q", "c", "e", False)
    state.absorb(spark.createDataFrame([row], schemas.MEMBER_TIMELINE))
    state.absorb(spark.createDataFrame([(*row[:5], "P", *row[6:8], True)], schemas.MEMBER_TIMELINE))
    assert {(r.source, r.n, r.principal) for r in state.parts()["partials"].collect()} == {("Q", 0, 0), ("P", 1, 1)}
    found = features(*both(state), PERIODS).first()
    assert (found.diagnosis_count, found.distinct_sources, found.principal_diagnosis_count) == (1, 1, 1)


def test_repeated_and_empty_batches(spark, tmp_path):
    state = EvidenceState(TableStore(spark, str(tmp_path)), buckets=4)
    assert state.parts() == {}
    rows = random_rows(spark, 3)
    assert state.absorb(rows.limit(0)) == 1 and state.parts()["partials"].count() == 0
    assert state.absorb(rows) == 2
    before = sorted(map(repr, state.parts()["partials"].collect()))
    assert state.absorb(rows) == 3
    assert sorted(map(repr, state.parts()["partials"].collect())) == before
    assert state.absorb(rows.limit(0)) == 3


def test_a_batch_reads_and_writes_its_buckets_only(spark, tmp_path):
    state = EvidenceState(TableStore(spark, str(tmp_path)), buckets=32)
    day = dt.date(2022, 3, 1)
    many = spark.range(200).select(F.concat(F.lit("M"), "id").alias("bene_id"), F.lit(day).alias("event_date"), F.lit("diagnosis").alias("event_type"),
                                   F.lit("x").alias("code"), F.lit("37").alias("hcc_v28"), F.lit("P").alias("source"), F.lit("c").alias("claim_id"),
                                   F.lit("e").alias("event_id"), F.lit(True).alias("is_principal"))
    state.absorb(many)
    before = state._manifest()[1]["parts"]
    batch = many.filter("bene_id = 'M7'").withColumn("claim_id", F.lit("c2"))
    assert len(state.parts(batch)["events"].inputFiles()) < len(state.parts()["events"].inputFiles()) / 4
    state.absorb(batch)
    after = state._manifest()[1]["parts"]
    for part in ("events", "partials"):
        assert sum(before[part]["folders"][b] != f for b, f in after[part]["folders"].items()) == 1
    assert state.parts(batch)["events"].count() == 2 and state.parts()["events"].count() == 201


def test_a_lost_run_or_a_second_writer_changes_nothing(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path))
    state = EvidenceState(store, buckets=2)
    state.absorb(random_rows(spark, 4))
    before = sorted(map(repr, state.parts()["partials"].collect()))
    publish = store._commit

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_commit", lost)
    with pytest.raises(RuntimeError, match="lost"):
        state.absorb(random_rows(spark, 5))
    assert sorted(map(repr, state.parts()["partials"].collect())) == before

    def late(table, version, manifest):
        publish(table, version, manifest)
        publish(table, version, manifest)

    monkeypatch.setattr(store, "_commit", late)
    with pytest.raises(StaleVersion):
        state.absorb(random_rows(spark, 5))
    monkeypatch.setattr(store, "_commit", publish)
    assert state.absorb(random_rows(spark, 5)) == 3
