"""Member timeline: diagnoses with category plus prescriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap import schemas
from caregap.functions import clean
from caregap.operators import lookup


def normalized(timeline: DataFrame) -> DataFrame:
    """Timeline text as the engines expect it: trimmed ids, lower-case types, upper-case sources, integer categories."""
    def text(c: str):
        return clean.blank_to_null(F.col(c))

    hcc = clean.to_number(text("hcc_v28")).cast("bigint").cast("string")
    return timeline.select(
        text("bene_id").alias("bene_id"),
        clean.iso_date(F.col("event_date")).alias("event_date"),
        F.lower(text("event_type")).alias("event_type"),
        text("code").alias("code"),
        hcc.alias("hcc_v28"),
        F.upper(text("source")).alias("source"),
        text("claim_id").alias("claim_id"),
        text("event_id").alias("event_id"),
        clean.parse_bool(F.col("is_principal"), accept_y=True).alias("is_principal"),
    )


def diagnosis_rows(events: DataFrame, mapping: DataFrame) -> DataFrame:
    coded = events.withColumn("code", F.upper(clean.strip(F.col("diagnosis_code"))))
    return lookup.with_hcc(coded, mapping, "code").select(
        "bene_id", "event_date", F.lit("diagnosis").alias("event_type"), "code", "hcc_v28", "source", "claim_id",
        "event_id", "is_principal", "in_crosswalk",
    )


def prescription_rows(prescriptions: DataFrame) -> DataFrame:
    null_text = F.lit(None).cast("string")
    return prescriptions.select(
        "bene_id", "event_date", F.lit("prescription").alias("event_type"), F.col("drug_code").alias("code"),
        null_text.alias("hcc_v28"), F.lit("PDE").alias("source"), F.col("pde_id").alias("claim_id"), "event_id",
        F.lit(None).cast("boolean").alias("is_principal"),
    )


def build_timeline(events: DataFrame, prescriptions: DataFrame, mapping: DataFrame) -> DataFrame:
    return (
        diagnosis_rows(events, mapping).select(*schemas.TIMELINE_COLUMNS)
        .unionByName(prescription_rows(prescriptions))
    )


def claim_rows(claims: DataFrame, mapping: DataFrame) -> DataFrame:
    """Batch claims as timeline rows, mapped on the fly; the event id carries the batch and the claim or row."""
    own_id = F.col("claim_id")
    if "row_idx" in claims.columns:
        own_id = F.coalesce(own_id, F.col("row_idx").cast("string"))
    coded = claims.withColumn("code", clean.strip(F.col("diagnosis_code")))
    return lookup.with_hcc(coded, mapping, "code").select(
        "bene_id",
        F.col("claim_date").alias("event_date"),
        F.lit("diagnosis").alias("event_type"),
        "code",
        "hcc_v28",
        F.upper("source").alias("source"),
        "claim_id",
        F.concat_ws(":", F.col("batch_id"), own_id).alias("event_id"),
        F.coalesce("is_principal", F.lit(False)).alias("is_principal"),
    )


def with_batch(timeline: DataFrame, claims: DataFrame, mapping: DataFrame) -> DataFrame:
    """Stored timeline plus a new batch: dated diagnoses with a category only."""
    both = timeline.select(*schemas.TIMELINE_COLUMNS).unionByName(claim_rows(claims, mapping))
    return both.filter(
        (F.lower(F.col("event_type")) == "diagnosis") & F.col("event_date").isNotNull() & F.col("hcc_v28").isNotNull()
    )


def coverage(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Diagnosis rows mapped to a category, in the crosswalk without one, and outside it."""
    found, hcc = F.col("in_crosswalk"), F.col("hcc_v28")
    return diagnosis_rows(events, mapping).agg(
        F.count("*").alias("total_diagnoses"),
        F.count_if(hcc.isNotNull()).alias("mapped"),
        F.count_if(found & hcc.isNull()).alias("in_crosswalk_no_hcc"),
        F.count_if(~found).alias("not_in_crosswalk"),
    )
