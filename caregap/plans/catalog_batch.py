"""Batch runs: scoring, upsert, evidence rows and prescription append."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from caregap.operators import evidence, ingest, review
from caregap.operators import timeline as tl
from caregap.plans.fixtures import BATCH
from caregap.plans.registry import query
from caregap.session import ensure_checkpoint_dir, materialize
from caregap.streaming.batches import suspect_table
from caregap.streaming.state import EvidenceState, absorb_claims
from caregap.streaming.store import TableStore

GAP = evidence.GAP
_COUNTS = [*evidence.FEATURES, "prescription_support_count"]
_U2 = (
    "bene_id, hcc_v28, gap_type, latest_context, " + ", ".join(_COUNTS) + ", first_evidence_date, last_evidence_date, "
    "supporting_diagnosis_codes, reason_flags, evidence_summary, priority_score, priority"
)


def _references(f):
    combined = tl.with_batch(f.batch_history, f.batch_claims, f.mapping)
    return evidence.evidence_references(evidence.gap_events(combined, f.batch_suspects, BATCH))


@query("u2_batch_engine", f"SELECT {_U2} FROM batch_suspects")
def _(f):
    return f.batch_suspects.select(
        *GAP, "latest_context", *_COUNTS, "first_evidence_date", "last_evidence_date",
        F.concat_ws("|", "supporting_diagnosis_codes").alias("supporting_diagnosis_codes"),
        F.concat_ws("|", "reason_flags").alias("reason_flags"), "evidence_summary", "priority_score", "priority",
    )


@query("u2_incremental_engine", f"SELECT {_U2} FROM batch_suspects")
def _(f):
    """History, then the batch in three parts; each part reads and writes the buckets of its members only."""
    state = EvidenceState(TableStore(f.spark, f"{ensure_checkpoint_dir(f.spark)}/stores/{uuid.uuid4().hex}"))
    claims = materialize(f.batch_claims)
    state.absorb(f.batch_history)
    third = F.pmod(F.dayofmonth("claim_date"), F.lit(3))
    for number in range(3):
        absorb_claims(state, claims.filter(third == number), f.mapping)
    scored = state.score(claims.select("bene_id"), f.rx, f.batch_baseline, f.mapping, BATCH)
    return scored.select(
        *GAP, "latest_context", *_COUNTS, "first_evidence_date", "last_evidence_date",
        F.concat_ws("|", "supporting_diagnosis_codes").alias("supporting_diagnosis_codes"),
        F.concat_ws("|", "reason_flags").alias("reason_flags"), "evidence_summary", "priority_score", "priority",
    )


@query("e6_batch_priority", "SELECT bene_id, hcc_v28, gap_type, priority_score, priority FROM batch_suspects")
def _(f):
    return f.batch_suspects.select(*GAP, "priority_score", "priority")


@query(
    "e11_reviewer_payload",
    """SELECT bene_id, hcc_v28, gap_type, CAST(hcc_v28 AS INTEGER) AS hcc, latest_context, diagnosis_count, last_evidence_date,
              evidence_summary AS summary FROM batch_suspects""",
)
def _(f):
    rows = evidence.payload_rows(f.batch_suspects, _references(f)).filter("position = 0")
    parsed = F.from_json(
        "input_payload",
        "hcc_v28 int, latest_context string, summary string, evidence struct<diagnosis_count: bigint, last_evidence_date: date>",
    )
    return rows.withColumn("p", parsed).select(
        *GAP, F.col("p.hcc_v28").alias("hcc"), "p.latest_context", "p.evidence.diagnosis_count",
        "p.evidence.last_evidence_date", "p.summary",
    )


_E13 = """SELECT 'SUS-' || s.bene_id || '-' || s.hcc_v28 || '-' || s.gap_type AS suspect_id, e.event_date AS evidence_date,
       e.code AS diagnosis_code, e.claim_id, e.source, s.evidence_summary AS evidence_text, s.priority_score AS evidence_strength,
       'RUN-1' AS run_id, 'DIAGNOSIS' AS evidence_type, e.bene_id, e.event_id, e.is_principal
FROM batch_suspects s JOIN batch_events e USING (bene_id, hcc_v28, gap_type)"""


@query("e13_u4_evidence_rows", _E13)
def _(f):
    told = F.from_json("evidence_metadata", "event_id string, is_principal boolean")
    rows = evidence.evidence_rows(_references(f), f.batch_suspects, "RUN-1").withColumn("m", told)
    return rows.select(*[c for c in rows.columns if c not in ("m", "evidence_metadata")], "m.event_id", "m.is_principal")


_U3_FRESH = """SELECT 'SUS-' || bene_id || '-' || hcc_v28 || '-' || gap_type AS suspect_id, bene_id, hcc_v28, gap_type, priority, priority_score,
       diagnosis_count, first_evidence_date, last_evidence_date, supporting_diagnosis_codes, 'RUN-2' AS run_id, CAST(NULL AS VARCHAR) AS ml_priority,
       'PENDING_REVIEW' AS status FROM batch_suspects"""
_U3_STORED = """SELECT suspect_id, bene_id, hcc_v28, suspect_type AS gap_type, CAST(NULL AS VARCHAR) AS priority, priority_score,
       CAST(NULL AS BIGINT) AS diagnosis_count, first_evidence_date, last_evidence_date, supporting_diagnosis_codes, 'RUN-1' AS run_id, ml_priority,
       status FROM suspects"""
_U3_COLUMNS = (
    "bene_id", "hcc_v28", "gap_type", "priority", "priority_score", "diagnosis_count", "first_evidence_date", "last_evidence_date",
    "supporting_diagnosis_codes", "run_id", "ml_priority",
)


@query(
    "u3_upsert_suspects",
    f"""SELECT coalesce(n.suspect_id, o.suspect_id) AS suspect_id, coalesce(o.status, n.status) AS status,
               {", ".join(f"CASE WHEN n.suspect_id IS NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in _U3_COLUMNS)}
        FROM ({_U3_FRESH}) n FULL OUTER JOIN ({_U3_STORED}) o ON n.suspect_id = o.suspect_id""",
)
def _(f):
    """A run without model columns over stored suspects that have them."""
    fresh = suspect_table(f.batch_suspects, _references(f), "RUN-2")
    stored = f.suspects.withColumn("run_id", F.lit("RUN-1")).withColumn("gap_type", F.col("suspect_type"))
    return review.upsert_suspects(stored, fresh).select("suspect_id", "status", *_U3_COLUMNS)


_U3_MERGED = f"""SELECT coalesce(n.suspect_id, o.suspect_id) AS suspect_id, coalesce(o.status, n.status) AS status,
       {", ".join(f"CASE WHEN n.suspect_id IS NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in _U3_COLUMNS)}
       FROM ({_U3_FRESH}) n FULL OUTER JOIN ({_U3_STORED}) o ON n.suspect_id = o.suspect_id"""


@query(
    "u3_bucket_upsert",
    f"""SELECT * REPLACE (CASE WHEN run_id = 'RUN-2' AND gap_type = 'EMERGING' AND CAST(hcc_v28 AS INTEGER) % 5 = 0 THEN 'RUN-3' ELSE run_id END AS run_id)
        FROM ({_U3_MERGED})""",
)
def _(f):
    """Three batches into a table kept by key buckets: stored suspects, a run, and a later run of some of its gaps."""
    store = TableStore(f.spark, f"{ensure_checkpoint_dir(f.spark)}/stores/{uuid.uuid4().hex}")
    f.stored("suspects", "batch_suspects")
    fresh = materialize(suspect_table(f.batch_suspects, _references(f), "RUN-2"))
    stored = f.suspects.withColumn("run_id", F.lit("RUN-1")).withColumn("gap_type", F.col("suspect_type"))
    schema = T.StructType([*fresh.schema, *(c for c in stored.schema if c.name not in fresh.columns)])
    later = fresh.filter((F.col("gap_type") == "EMERGING") & (F.col("hcc_v28").cast("int") % 5 == 0))
    for batch in (stored, fresh, later.withColumn("run_id", F.lit("RUN-3"))):
        store.upsert(review.aligned(batch, schema), "suspects", "suspect_id", review.upsert_suspects)
    return store.snapshot("suspects").select("suspect_id", "status", *_U3_COLUMNS)


@query(
    "u4_payload_records",
    """SELECT 'SUS-' || bene_id || '-' || hcc_v28 || '-' || gap_type AS suspect_id, 'COMPLETED' AS status, '1.0' AS prompt_version,
              evidence_summary AS summary FROM batch_suspects""",
)
def _(f):
    from caregap.streaming.batches import review_payloads

    return review_payloads(f.batch_suspects, _references(f)).select(
        "suspect_id", "status", "prompt_version", F.get_json_object("input_payload", "$.summary").alias("summary")
    )


@query(
    "u10_prescription_append",
    """SELECT DISTINCT bene_id, event_id, event_date, drug_code FROM rx
       WHERE event_date >= DATE '2000-01-01' AND event_id NOT IN (SELECT event_id FROM rx WHERE event_date < DATE '2001-01-01')""",
)
def _(f):
    day = F.col("event_date")
    new = f.rx.filter(day >= F.lit("2000-01-01").cast("date"))
    stored = f.rx.filter(day < F.lit("2001-01-01").cast("date"))
    return ingest.insert_prescriptions(new, stored, f.members).select("bene_id", "event_id", "event_date", "drug_code")


@query(
    "j16_unknown_members",
    "SELECT row_idx, bene_id FROM validated WHERE reason LIKE 'Unknown bene_id%'",
)
def _(f):
    return f.validated.filter(F.col("reason").startswith("Unknown bene_id")).select("row_idx", "bene_id")


@query(
    "u1_accepted_claims",
    """SELECT row_idx, bene_id, claim_id, CAST(try_strptime(raw_date, '%Y-%m-%d') AS DATE) AS claim_date, diagnosis_code, source,
              is_principal FROM validated WHERE reason IS NULL""",
)
def _(f):
    from caregap.functions import clean

    return f.validated.filter(F.col("reason").isNull()).select(
        "row_idx", "bene_id", "claim_id", "claim_date", "diagnosis_code", "source",
        clean.parse_bool(F.col("is_principal"), accept_y=True).alias("is_principal"),
    )
