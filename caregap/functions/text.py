"""Reason flags, evidence sentences and the deterministic reviewer narrative."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from caregap.functions.clean import fixed_decimals

# --- fixed values: wording of the review texts, which readers and stored records rely on ---

NO_EVIDENCE = "No current evidence; review data completeness before acting"
REVIEW_INSTRUCTION = (
    "Review the associated medical record and encounter documentation. "
    "This is not an automated diagnosis or submission decision."
)
ENVELOPE = {
    "schema_version": "1.0",
    "purpose": "Evidence-grounded reviewer explanation input",
    "instructions": (
        "Summarize only the supplied evidence. Do not invent diagnoses, evidence, or clinical "
        "conclusions. Recommend human record review."
    ),
}
SUMMARY_PARTS = {
    "diagnosis_count": "{n} supporting diagnosis event(s)",
    "distinct_sources": "{n} source type(s)",
    "distinct_evidence_months": "evidence across {n} month(s)",
    "unique_claim_count": "{n} claim(s)",
    "principal_diagnosis_count": "includes principal diagnosis evidence",
    "prescription_support_count": "{n} prescription event(s) within +/-30 days",
}
SUMMARY_LATEST = "latest diagnosis evidence {day}"
DEFAULT_SOURCES = "Carrier / Outpatient Claims"
DEFAULT_CODES = "ICD-10 clinical diagnosis"
LABEL = "{description} (HCC {hcc})"
TITLE = "{gap_type} Gap: {label}"
EMERGING_TEXT = (
    "Beneficiary {bene_id} presents with an Emerging Documentation Gap for {label}. "
    "This condition was not documented in the historical 2-year baseline profile and has newly emerged in current claims."
)
RECAPTURE_TEXT = (
    "Beneficiary {bene_id} has a documented historical baseline for {label} that requires annual recapture. "
    "Current claims evidence shows active persistence supporting continued risk adjustment documentation."
)
RANK_TEXT = " (Global Reviewer Rank #{rank})"
NARRATIVE = (
    "{explanation} Evaluated with {priority} priority (Score: {score}){rank}. Atomic evidence includes {diagnoses} "
    "diagnosis event(s) (ICD-10: {codes}) from {first} to {last} via {sources}.{fills}"
)
FILLS_TEXT = " Part D therapy is actively aligned with {fills} fill(s)."
POINT_DIAGNOSES = (
    "Documented across {diagnoses} diagnosis event(s) across {claims} unique claim(s) between {first} and {last}."
)
POINT_SOURCES = "Encounters identified across clinical care settings: {sources}."
POINT_PRINCIPAL = (
    "Recorded as Principal Inpatient Diagnosis in {principal} encounter(s), indicating high clinical acuity."
)
POINT_FILLS = "Supported by {fills} matching Part D pharmacy fill(s) demonstrating active medical management."
POINT_NO_FILLS = "No concurrent Part D pharmacy fills detected for direct disease management."
CHECKLIST = (
    "Verify clinical encounter notes signed by a qualified provider for ICD-10 code(s): {codes}.",
    "Confirm active management, evaluation, assessment, or treatment (MEAT criteria) during encounters dated "
    "{first} to {last}.",
    "Check face-to-face provider documentation status for CMS-HCC V28 risk adjustment compliance.",
)
RECOMMENDATION = (
    "Review associated medical record documentation to confirm MEAT compliance before risk adjustment submission."
)

# --- end of fixed values -----------------------------------------------------------------------


def fill(template: str, **values: Column) -> Column:
    """Template with ``{name}`` places as one concatenated column; null if any used value is null."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(values[name].cast("string"))
    return F.concat(*pieces)


def latest_context(gap_type: Column, seen_latest: Column) -> Column:
    return (
        F.when((gap_type == "RECAPTURE") & seen_latest, "REAPPEARED")
        .when(gap_type == "RECAPTURE", "STILL_ABSENT")
        .when(seen_latest, "CONTINUED")
        .otherwise("NOT_SEEN_LATEST")
    )


def reason_flags() -> Column:
    """Flags in fixed order, the latest context last."""
    rules = {
        "RECENT_EVIDENCE": F.col("recency_score") >= 0.75,
        "FREQUENT_EVIDENCE": F.col("frequency_score") >= 0.75,
        "PERSISTENT_EVIDENCE": F.col("persistence_score") >= 0.75,
        "MULTIPLE_SOURCE_TYPES": F.col("source_diversity_score") >= 1.0,
        "PRINCIPAL_DIAGNOSIS_PRESENT": F.col("principal_diagnosis_count") > 0,
        "PRESCRIPTION_SUPPORTED": F.col("prescription_support_count") > 0,
    }
    flags = [F.when(rule, flag) for flag, rule in rules.items()]
    return F.array_compact(F.array(*flags, F.col("latest_context")))


def evidence_summary() -> Column:
    parts = [F.when(F.col(c) > 0, fill(t, n=F.col(c))) for c, t in SUMMARY_PARTS.items()]
    sentence = F.concat_ws("; ", *parts, fill(SUMMARY_LATEST, day=F.col("last_evidence_date")))
    return F.when(sentence == "", NO_EVIDENCE).otherwise(sentence)


def _or_default(c: Column, default: str | Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default) if isinstance(default, str) else default)


def narrative_columns() -> dict[str, Column]:
    """Title, narrative, evidence points and checklist for a scored candidate row.

    Expects ``gap_type, bene_id, hcc_v28, hcc_description, priority, priority_score, review_rank,
    diagnosis_count, unique_claim_count, principal_diagnosis_count, prescription_support_count,
    first_evidence_date, last_evidence_date, sources, diagnosis_codes`` (codes as an array).
    """
    hcc, gap_type = F.col("hcc_v28"), F.col("gap_type")
    label = fill(LABEL, description=_or_default(F.col("hcc_description"), fill("HCC {hcc}", hcc=hcc)), hcc=hcc)
    values = {
        "bene_id": F.col("bene_id"),
        "gap_type": gap_type,
        "label": label,
        "priority": F.col("priority"),
        "score": fixed_decimals(F.col("priority_score"), 2),
        "diagnoses": F.col("diagnosis_count"),
        "claims": F.col("unique_claim_count"),
        "principal": F.col("principal_diagnosis_count"),
        "first": _or_default(F.col("first_evidence_date"), "N/A"),
        "last": _or_default(F.col("last_evidence_date"), "N/A"),
        "codes": _or_default(F.concat_ws(", ", "diagnosis_codes"), DEFAULT_CODES),
        "sources": _or_default(F.col("sources"), DEFAULT_SOURCES),
    }
    n_fills, n_rank = F.col("prescription_support_count"), F.col("review_rank")
    narrative = fill(
        NARRATIVE,
        **values,
        explanation=F.when(gap_type == "EMERGING", fill(EMERGING_TEXT, **values)).otherwise(
            fill(RECAPTURE_TEXT, **values)
        ),
        rank=F.when(n_rank > 0, fill(RANK_TEXT, rank=n_rank)).otherwise(""),
        fills=F.when(n_fills > 0, fill(FILLS_TEXT, fills=n_fills)).otherwise(""),
    )
    points = F.array_compact(
        F.array(
            fill(POINT_DIAGNOSES, **values),
            fill(POINT_SOURCES, **values),
            F.when(F.col("principal_diagnosis_count") > 0, fill(POINT_PRINCIPAL, **values)),
            F.when(n_fills > 0, fill(POINT_FILLS, fills=n_fills)).otherwise(POINT_NO_FILLS),
        )
    )
    return {
        "summary_title": fill(TITLE, **values),
        "clinical_narrative": narrative,
        "evidence_breakdown": points,
        "verification_checklist": F.array(*[fill(item, **values) for item in CHECKLIST]),
        "recommendation": F.lit(RECOMMENDATION),
        "ml_assessment": F.struct(
            F.col("priority").alias("priority"), F.round("priority_score", 4).alias("priority_score"),
            n_rank.alias("review_rank"),
        ),
    }
