"""A batch writes what is new, whatever the state holds; a bucket with many layers becomes one."""

import datetime as dt

from pyspark.sql import functions as F

from caregap.operators import evidence
from caregap.schemas import Periods
from caregap.streaming import state as state_module
from caregap.streaming.state import EvidenceState, features
from caregap.streaming.store import TableStore

PERIODS = Periods(historical=(2021, 2022), current=2023, latest=2024)
FEATURES = [*evidence.GAP, *evidence.FEATURES, "first_evidence_date", "last_evidence_date", "supporting_diagnosis_codes", "evidence_days"]


def events(spark, days, members=60):
    """One event a day for each member."""
    start = F.lit(dt.date(2022, 12, 1))
    return spark.range(members * len(days)).select(
        F.concat(F.lit("M"), (F.col("id") % members).cast("string")).alias("bene_id"),
        F.date_add(start, F.get(F.array(*map(F.lit, days)), (F.col("id") / members).cast("int"))).alias("event_date"),
        F.lit("diagnosis").alias("event_type"), F.lit("x").alias("code"), F.lit("37").alias("hcc_v28"), F.lit("P").alias("source"),
        F.concat(F.lit("c"), "id").alias("claim_id"), F.concat(F.lit("e"), "id").alias("event_id"), F.lit(True).alias("is_principal"))


def test_a_batch_of_all_buckets_writes_its_own_rows_only(spark, tmp_path):
    state = EvidenceState(TableStore(spark, str(tmp_path)), buckets=4)
    state.absorb(events(spark, list(range(20))))
    old = state._manifest()[1]["parts"]["events"]["folders"]
    # Known events and one new day.
    batch = events(spark, list(range(20))).unionByName(events(spark, [40]).withColumn("event_id", F.concat(F.lit("n"), "event_id")))
    state.absorb(batch)
    layers = state._manifest()[1]["parts"]["events"]["folders"]
    assert len(layers) == 4 and all(layers[b][:-1] == fs for b, fs in old.items())
    assert spark.read.parquet(*[fs[-1] for fs in layers.values()]).count() == 60
    assert state.parts()["events"].count() == 60 * 21


def test_layers_become_one_and_give_the_same_features(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state_module, "LAYERS", 2)
    state = EvidenceState(TableStore(spark, str(tmp_path)), buckets=2)
    seen = None
    for k in range(4):
        # Half of each batch was in the last one, under a larger source and not as principal.
        rows = events(spark, [20 * k, 20 * k + 10], 8).unionByName(
            events(spark, [20 * k - 20, 20 * k - 10], 8).withColumn("source", F.lit("O" if k % 2 else "Q")).withColumn("is_principal", F.lit(False)))
        state.absorb(rows)
        seen = rows if seen is None else seen.unionByName(rows)
        for part in ("events", "partials"):
            assert max(map(len, state._manifest()[1]["parts"][part]["folders"].values())) <= 2
        whole = sorted(map(repr, evidence.period_features(seen, PERIODS).select(*FEATURES).collect()))
        parts = state.parts()
        assert sorted(map(repr, features(parts["partials"], parts["events"], PERIODS).select(*FEATURES).collect())) == whole
        manifest = state._manifest()[1]["parts"]
        raw = features(state._layers(manifest["partials"]), state._layers(manifest["events"]), PERIODS)
        assert sorted(map(repr, raw.select(*FEATURES).collect())) == whole
        assert sorted(map(repr, parts["events"].collect())) == sorted(map(repr, evidence.deduplicate_events(seen).collect()))
