import datetime as dt

import pytest
from pyspark.sql import functions as F

from caregap import schemas
from caregap.streaming.batches import RUN_SCHEMA, ClaimsPipeline, History
from caregap.streaming.store import TableStore

CLAIMS = "bene_id string, claim_id string, claim_date string, diagnosis_code string, source string, is_principal string"


@pytest.fixture
def pipeline(spark, tmp_path):
    day = dt.date.fromisoformat
    members = spark.createDataFrame([("A",), ("B",)], "bene_id string")
    mapping = spark.createDataFrame(
        [("E119", "Diabetes", "37", True), ("I509", "Heart failure", "226", True), ("Z00", "Visit", None, False)],
        schemas.HCC_MAPPING)
    timeline = spark.createDataFrame(
        [("A", day("2021-05-01"), "diagnosis", "E119", "37", "CARRIER", "h1", "e1", True),
         ("A", day("2022-05-01"), "diagnosis", "E119", "37", "INPATIENT", "h2", "e2", False)], schemas.MEMBER_TIMELINE)
    rx = spark.createDataFrame([("A", "PDE_1", "1", day("2023-01-20"), "N1")], schemas.EVENTS_PRESCRIPTION)
    baseline = spark.createDataFrame([("A", "37")], "bene_id string, hcc_v28 string")
    return ClaimsPipeline(spark, TableStore(spark, str(tmp_path / "store")), History(members, timeline, rx, baseline, mapping))


def batch(spark):
    return spark.createDataFrame(
        [("A", "c1", "2023-01-05", "I509", "inpatient", "Y"), ("X", "c2", "2023-01-05", "I509", "CARRIER", "no"),
         ("B", "c3", "2023-01-06", "E119", "CARRIER", "no"), ("A", "c1", "2023-01-07", "I509", "CARRIER", "no")], CLAIMS)


def test_batch_run_and_replay(spark, pipeline):
    summary = pipeline.run_batch(batch(spark), "B1", "R1")
    assert {k: summary[k] for k in ("input_rows", "valid_rows", "rejected_rows", "suspects", "evidence", "payloads")} == {
        "input_rows": 4, "valid_rows": 2, "rejected_rows": 2, "suspects": 2, "evidence": 3, "payloads": 2}
    suspects = {r.suspect_id: r for r in pipeline.store.snapshot("suspects").collect()}
    assert set(suspects) == {"SUS-A-226-EMERGING", "SUS-A-37-RECAPTURE"}
    emerging = suspects["SUS-A-226-EMERGING"]
    assert emerging.latest_context == "CONTINUED" and emerging.prescription_support_count == 1
    assert emerging.prescription_drug_codes == ["N1"] and emerging.evidence_count == 1
    assert emerging.sources == "INPATIENT" and emerging.hcc_description == "Heart failure"
    assert suspects["SUS-A-37-RECAPTURE"].latest_context == "STILL_ABSENT"
    with pytest.raises(ValueError, match="Claim batch already exists"):
        pipeline.run_batch(batch(spark), "B1", "R2")
    with pytest.raises(ValueError, match="Pipeline run already exists"):
        pipeline.run_batch(batch(spark), "B2", "R1")
    reasons = sorted(r.reason for r in pipeline.store.read_partition("ingestion_rejections", run_id="R1").collect())
    assert reasons == ["Duplicate claim_id in batch: c1", "Unknown bene_id: X"]
    payload = pipeline.store.read_partition("review_payloads", run_id="R1").filter("suspect_id = 'SUS-A-226-EMERGING'").first()
    assert '"gap_type":"EMERGING"' in payload.input_payload and "Heart failure (HCC 226)" in payload.reviewer_summary


def test_decision_survives_a_later_run(spark, pipeline):
    pipeline.run_batch(batch(spark), "B1", "R1")
    decisions = spark.createDataFrame(
        [("D1", "SUS-A-226-EMERGING", " supported ", "ok"), ("D2", "SUS-A-226-EMERGING", "maybe", ""), ("D3", "nope", "SUPPORTED", "")],
        "review_id string, suspect_id string, decision string, notes string",
    ).withColumn("reviewer_timestamp", F.lit("2024-01-01").cast("timestamp"))
    refused = sorted(r.reason for r in pipeline.decide(decisions, "D").collect())
    assert refused == ["Invalid decision: maybe", "Suspect not found: nope"]
    pipeline.run_batch(batch(spark), "B2", "R2")
    rows = {r.suspect_id: (r.status, r.run_id) for r in pipeline.store.snapshot("suspects").collect()}
    assert rows["SUS-A-226-EMERGING"] == ("REVIEWED", "R2")
    assert rows["SUS-A-37-RECAPTURE"] == ("PENDING_REVIEW", "R2")
    assert {r.run_id: r.status for r in pipeline.runs().collect()} == {"R1": "COMPLETED", "R2": "COMPLETED"}


def test_failed_run_is_logged(spark, pipeline):
    bad = batch(spark).filter("bene_id = 'X'")
    with pytest.raises(ValueError, match="no claims"):
        pipeline.run_batch(bad, "B9", "R9")
    run = pipeline.runs().first()
    assert (run.status, run.rejected_rows) == ("FAILED", 1) and "no claims" in run.error_message
    assert pipeline.store.snapshot("suspects") is None


def test_unknown_member_stops_before_any_write(spark, pipeline):
    stray = spark.createDataFrame([("Z", "37")], "bene_id string, hcc_v28 string")
    pipeline.ingest(batch(spark), "B1", "R1", "f")
    claims = pipeline.store.read_partition("claims", batch_id="B1")
    pipeline.store.write_partition(claims.withColumn("bene_id", F.lit("Z")), "claims", batch_id="B2")
    pipeline.history = History(pipeline.history.members, pipeline.history.timeline, pipeline.history.prescriptions, stray,
                               pipeline.history.mapping)
    with pytest.raises(ValueError, match="unknown bene_id: Z"):
        pipeline.score("B2", "R2")
    assert pipeline.store.snapshot("suspects") is None
    assert not pipeline.store.exists(pipeline.store.partition_path("suspect_evidence", run_id="R2"))


def test_file_stream_runs_each_batch_once(spark, pipeline, tmp_path):
    inbox, checkpoint = str(tmp_path / "inbox"), str(tmp_path / "checkpoint")
    batch(spark).coalesce(1).write.csv(inbox, header=True)
    pipeline.run_stream(inbox, checkpoint).awaitTermination(120)
    assert pipeline.store.latest_version("suspects") == 1
    pipeline.run_stream(inbox, checkpoint).awaitTermination(120)
    assert pipeline.store.latest_version("suspects") == 1
    runs = pipeline.store.read("pipeline_runs", RUN_SCHEMA)
    assert sorted(r.status for r in runs.collect()) == ["COMPLETED", "RUNNING"]


def test_a_bad_file_does_not_stop_the_stream(spark, pipeline, tmp_path):
    """A file without any known member is logged as failed, with its rejections; the good file behind it is scored."""
    import os

    inbox, rows = tmp_path / "inbox", batch(spark)
    inbox.mkdir()
    for k, part in enumerate((rows.filter("bene_id = 'X'"), rows)):
        name = inbox / f"f{k}.csv"
        name.write_text("\n".join([",".join(part.columns), *(",".join(r) for r in part.collect())]) + "\n")
        os.utime(name, (1_700_000_000 + k * 100,) * 2)
    wrong = inbox / "f2.csv"
    wrong.write_text("claim_id,bene_id,claim_date,diagnosis_code,source,is_principal\nc9,A,2023-01-05,I509,CARRIER,no\n")
    os.utime(wrong, (1_700_000_300,) * 2)
    pipeline.run_stream(str(inbox), str(tmp_path / "checkpoint")).awaitTermination(180)
    runs = {r.run_id: r for r in pipeline.runs().collect()}
    assert [runs[f"RUN-STREAM-0000000{k}"].status for k in range(3)] == ["FAILED", "COMPLETED", "FAILED"]
    refused = pipeline.store.read_partition("ingestion_rejections", run_id="RUN-STREAM-00000000").collect()
    assert [(r.row_index, r.reason) for r in refused] == [(1, "Unknown bene_id: X")]
    refused = pipeline.store.read_partition("ingestion_rejections", run_id="RUN-STREAM-00000001").collect()
    assert sorted((r.row_index, r.reason) for r in refused) == [(2, "Unknown bene_id: X"), (4, "Duplicate claim_id in batch: c1")]
    assert pipeline.store.snapshot("suspects").count() == 2
    claims = pipeline.store.read_partition("suspect_claims", run_id="RUN-STREAM-00000001").collect()
    assert ("SUS-A-226-EMERGING", "c1", 1) in [tuple(r) for r in claims]


def test_appended_fills_are_scored(spark, pipeline):
    pipeline.run_batch(batch(spark), "B1", "R1")
    day = dt.date.fromisoformat("2023-01-10")
    pipeline.add_prescriptions(spark.createDataFrame([("A", "PDE_9", "9", day, "N9")], schemas.EVENTS_PRESCRIPTION), "F1")
    pipeline.run_batch(batch(spark), "B2", "R2")
    row = pipeline.store.snapshot("suspects").filter("suspect_id = 'SUS-A-226-EMERGING'").first()
    assert row.prescription_support_count == 2 and row.prescription_drug_codes == ["N1", "N9"]


def test_upsert_with_and_without_model_columns(spark):
    from caregap.operators import review

    plain = spark.createDataFrame([("s1", 1.0, "PENDING_REVIEW"), ("s2", 2.0, "PENDING_REVIEW")], "suspect_id string, priority_score double, status string")
    scored = plain.filter("suspect_id = 's1'").withColumn("ml_priority", F.lit("HIGH")).withColumn("status", F.lit("REVIEWED"))
    got = {r.suspect_id: (r.ml_priority, r.status) for r in review.upsert_suspects(plain, scored).collect()}
    assert got == {"s1": ("HIGH", "PENDING_REVIEW"), "s2": (None, "PENDING_REVIEW")}
    got = {r.suspect_id: (r.ml_priority, r.status) for r in review.upsert_suspects(scored, plain.filter("suspect_id = 's2'")).collect()}
    assert got == {"s1": ("HIGH", "REVIEWED"), "s2": (None, "PENDING_REVIEW")}


def test_prescriptions_are_added_once(spark, pipeline):
    fills = spark.createDataFrame(
        [("A", "PDE_1", "1", None, "N1"), ("A", "PDE_2", "2", None, "N1"), ("A", "PDE_2", "2", None, "N1"), ("X", "PDE_3", "3", None, "N1")],
        schemas.EVENTS_PRESCRIPTION)
    assert pipeline.add_prescriptions(fills, "R1") == 1
    assert pipeline.add_prescriptions(fills, "R2") == 0


def test_claims_without_id_stay_apart(spark, pipeline):
    rows = spark.createDataFrame(
        [("A", None, "2023-01-05", "I509", "CARRIER", "no"), ("A", None, "2023-01-05", "I509", "CARRIER", "no")], CLAIMS)
    assert pipeline.run_batch(rows, "B1", "R1")["evidence"] == 2 + 2


def test_model_priority_and_rank_are_stored(spark, pipeline):
    from caregap.operators import evidence, ml
    from caregap.plans.fixtures import Fixtures

    f = Fixtures(spark, "/root/testdata/sf0.001")
    rows = evidence.batch_priority(f.suspects_v2)
    rows = rows.withColumn("disease_priority", F.when(F.col("recency_score") > 0.8, "HIGH").otherwise(F.col("priority")))
    pipeline.model = ml.fit_priority(rows)
    pipeline.run_batch(batch(spark), "B1", "R1")
    stored = pipeline.store.snapshot("suspects").collect()
    assert sorted(r.ml_review_rank for r in stored) == [1, 2] and all(r.ml_top_100 for r in stored)
    assert all(f"Global Reviewer Rank #{r.ml_review_rank}" in r.evidence_summary for r in stored)


def test_runs_over_a_kept_state_see_earlier_batches(spark, pipeline):
    from caregap.operators import evidence
    from caregap.operators import timeline as timeline_ops
    from caregap.streaming.state import EvidenceState

    pipeline.state = EvidenceState(pipeline.store, buckets=4)
    pipeline.state.absorb(pipeline.history.timeline)
    pipeline.run_batch(batch(spark), "B1", "R1")
    more = spark.createDataFrame([("A", "c7", "2023-02-05", "I509", "CARRIER", "no")], CLAIMS)
    pipeline.run_batch(more, "B2", "R2")
    row = pipeline.store.snapshot("suspects").filter("suspect_id = 'SUS-A-226-EMERGING'").first()
    assert (row.diagnosis_count, row.run_id) == (2, "R2")
    h = pipeline.history
    claims = None
    for b in ("B1", "B2"):
        part = pipeline.store.read_partition("claims", batch_id=b).withColumn("batch_id", F.lit(b))
        claims = part if claims is None else claims.unionByName(part)
    want = evidence.run_batch_engine(h.timeline, claims, h.prescriptions, h.baseline, h.mapping, evidence.batch_periods(claims))
    got = pipeline.state.score(claims, h.prescriptions, h.baseline, h.mapping, evidence.batch_periods(claims))
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
