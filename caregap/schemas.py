"""Table schemas, enumerations and period windows of the claims model."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import types as T

EMERGING, RECAPTURE = "EMERGING", "RECAPTURE"
PENDING, REVIEWED = "PENDING_REVIEW", "REVIEWED"
DECISIONS = ("SUPPORTED", "NOT_SUPPORTED", "INSUFFICIENT_EVIDENCE")
TIERS = ("HIGH", "MEDIUM", "LOW")
PRIORITY_LABELS = ("LOW", "MEDIUM", "HIGH")

# Diagnosis slots per claim source (fixed by the claim layouts).
SOURCE_SLOTS = {"INPATIENT": 25, "OUTPATIENT": 25, "CARRIER": 12}
SOURCE_FILES = {"inpatient.csv": "INPATIENT", "outpatient.csv": "OUTPATIENT", "carrier.csv": "CARRIER"}
PRESCRIPTION_FILE = "pde.csv"


_TYPES = {
    "string": T.StringType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
    "array<string>": T.ArrayType(T.StringType()),
}


def struct_of(spec: str) -> T.StructType:
    """Schema from ``name type`` pairs; works without a session, unlike DDL parsing."""
    pairs = (column.split(" ") for column in spec.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


MEMBERS = struct_of(
    "bene_id string, birth_date date, sex string, race string, state string, county string, "
    "zip string, esrd_indicator string, death_date date, enrollment_years string"
)
HCC_MAPPING = struct_of("diagnosis_code string, description string, hcc_v28 string, payment_2026 boolean")
EVENTS_DIAGNOSIS = struct_of(
    "bene_id string, event_id string, claim_id string, event_date date, source string, "
    "diagnosis_code string, is_principal boolean"
)
EVENTS_PRESCRIPTION = struct_of("bene_id string, event_id string, pde_id string, event_date date, drug_code string")
MEMBER_TIMELINE = struct_of(
    "bene_id string, event_date date, event_type string, code string, hcc_v28 string, source string, "
    "claim_id string, event_id string, is_principal boolean"
)
MEMBER_HCC_BASELINE = struct_of(
    "bene_id string, hcc_v28 string, hcc_description string, baseline_diagnosis_codes string, "
    "baseline_claim_count bigint, first_baseline_date date, last_baseline_date date, sources string"
)
CLAIMS_BATCH = struct_of(
    "bene_id string, claim_id string, claim_date string, diagnosis_code string, source string, "
    "is_principal string, extra map<string,string>"
)
CLAIMS = struct_of(
    "batch_id string, claim_id string, bene_id string, claim_date date, diagnosis_code string, "
    "source string, is_principal boolean, raw_payload string"
)
REJECTIONS = struct_of("source_file string, row_index bigint, raw_data string, reason string")
REVIEW_DECISIONS = struct_of(
    "review_id string, suspect_id string, bene_id string, hcc_v28 string, suspect_type string, "
    "priority_score double, decision string, notes string, reviewer_timestamp timestamp"
)

TIMELINE_COLUMNS = MEMBER_TIMELINE.fieldNames()


@dataclass(frozen=True)
class Periods:
    """Year windows of a gap run; every gap function takes one instead of globals."""

    historical: tuple[int, ...]
    current: int
    latest: int | None = None

    @property
    def reference_date(self) -> dt.date:
        return dt.date(self.current, 12, 31)

    @property
    def loaded_years(self) -> tuple[int, ...]:
        extra = () if self.latest is None else (self.latest,)
        return tuple(sorted({*self.historical, self.current, *extra}))

    @classmethod
    def two_years_before(cls, current: int, latest: int | None = None) -> "Periods":
        return cls(historical=(current - 2, current - 1), current=current, latest=latest)

# Stored suspects. Model columns are null where no model scored the run.
SUSPECTS = struct_of(
    "suspect_id string, bene_id string, hcc_v28 string, hcc_description string, suspect_type string, gap_type string, "
    "latest_context string, priority string, status string, first_evidence_date date, last_evidence_date date, sources string, "
    "diagnosis_count bigint, unique_claim_count bigint, unique_event_count bigint, distinct_evidence_dates bigint, "
    "distinct_evidence_months bigint, distinct_sources bigint, principal_diagnosis_count bigint, "
    "prescription_support_count bigint, frequency_score double, recency_score double, persistence_score double, "
    "repeated_claim_score double, repeated_date_score double, source_diversity_score double, principal_score double, "
    "prescription_score double, priority_score double, reason_flags array<string>, evidence_summary string, "
    "prescription_drug_codes array<string>, ml_priority string, ml_priority_score double, ml_low_probability double, "
    "ml_medium_probability double, ml_high_probability double, ml_model_version string, ml_review_rank bigint, "
    "ml_top_100 boolean, evidence_count bigint, diversity_score double, priority_level string, "
    "supporting_diagnosis_codes string, has_prescription_support boolean, run_id string"
)
