"""Wide claims to long events, prescriptions, members and cohort numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregap import schemas
from caregap.functions import clean
from caregap.operators.ranking import global_rank


def _slot_codes(df: DataFrame, slots: int, cleaner, principal: Column) -> Column:
    def slot(name: str) -> Column:
        return cleaner(F.col(name)) if name in df.columns else F.lit(None).cast("string")

    return F.array(principal, *[slot(f"ICD_DGNS_CD{i}") for i in range(1, slots + 1)])


def _explode_slots(df: DataFrame, keep) -> DataFrame:
    """One row per kept (slot, code). Works inside each claim row, so nothing is shuffled."""
    numbered = F.transform(
        F.col("_codes"), lambda code, i: F.struct(i.alias("slot"), code.alias("diagnosis_code"))
    )
    kept = F.filter(numbered, lambda s: s["diagnosis_code"].isNotNull() & keep(s))
    return df.select("*", F.inline(kept)).drop("_codes")


def service_date(claims: DataFrame) -> Column:
    """From-date of a claim, else its through-date."""
    raw = F.col("CLM_FROM_DT")
    if "CLM_THRU_DT" in claims.columns:
        raw = F.coalesce(clean.blank_to_null(raw), F.col("CLM_THRU_DT"))
    return clean.claim_date(raw)


def claim_rows(claims: DataFrame, claim_type: Column | str) -> DataFrame:
    """One row per claim: member, claim, type and service date."""
    return claims.select(
        clean.strip(F.col("BENE_ID")).alias("member_id"),
        clean.strip(F.col("CLM_ID")).alias("claim_id"),
        (F.lit(claim_type) if isinstance(claim_type, str) else claim_type).alias("claim_type"),
        service_date(claims).alias("service_date"),
    )


def long_diagnoses(claims: DataFrame, source: Column | str, slots: int, null_tokens=clean.NULL_CODES) -> DataFrame:
    """Principal plus ``slots`` secondary codes to one row per distinct code of a claim, lowest slot kept."""
    source = F.lit(source) if isinstance(source, str) else source

    def cleaner(c: Column) -> Column:
        return clean.clean_code(c, null_tokens)

    wide = claims.filter(clean.strip(F.col("BENE_ID")) != "").withColumn(
        "_codes", _slot_codes(claims, slots, cleaner, cleaner(F.col("PRNCPAL_DGNS_CD")))
    )
    rows = _explode_slots(
        wide, lambda s: F.array_position(F.col("_codes"), s["diagnosis_code"]) == s["slot"] + 1
    )
    claim_id = clean.strip(F.col("CLM_ID"))
    return rows.select(
        clean.strip(F.col("BENE_ID")).alias("bene_id"),
        clean.slot_event_id(source, claim_id, F.col("slot")).alias("event_id"),
        claim_id.alias("claim_id"),
        service_date(claims).alias("event_date"),
        source.alias("source"),
        "diagnosis_code",
        (F.col("slot") == 0).alias("is_principal"),
    )


def long_diagnoses_keep_repeats(claims: DataFrame, slots: int) -> DataFrame:
    """Variant that drops a secondary code only where it equals the principal; repeats among secondaries stay."""
    principal = clean.clean_code_keep_dots(F.col("PRNCPAL_DGNS_CD"))
    if "ADMTG_DGNS_CD" in claims.columns:
        principal = F.coalesce(principal, clean.clean_code_keep_dots(F.col("ADMTG_DGNS_CD")))
    wide = claims.withColumn("_codes", _slot_codes(claims, slots, clean.clean_code_keep_dots, principal))
    first = F.get(F.col("_codes"), F.lit(0))
    rows = _explode_slots(
        wide, lambda s: (s["slot"] == 0) | first.isNull() | (s["diagnosis_code"] != first)
    )
    return rows.select(
        clean.strip(F.col("BENE_ID")).alias("bene_id"),
        clean.strip(F.col("CLM_ID")).alias("claim_id"),
        "slot",
        "diagnosis_code",
        service_date(claims).alias("diagnosis_date"),
        (F.col("slot") == 0).alias("is_principal"),
    )


def upload_claim_rows(claims: DataFrame, source: str) -> DataFrame:
    """Upload form: the claim id carries the slot, so it is unique inside a batch."""
    return long_diagnoses(claims, source, schemas.SOURCE_SLOTS[source], clean.NULL_CODES_UPLOAD).select(
        "bene_id",
        F.when(F.col("claim_id") != "", F.col("event_id")).alias("claim_id"),
        F.col("event_date").alias("claim_date"),
        "diagnosis_code",
        "source",
        "is_principal",
    )


def prescriptions(pde: DataFrame) -> DataFrame:
    """Pharmacy fills to events; a missing fill id gets one derived from the row, stable under replay."""
    bene, pde_id = clean.strip(F.col("BENE_ID")), clean.blank_to_null(F.col("PDE_ID"))
    row_hash = F.substring(
        F.sha2(
            F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("BENE_ID", "SRVC_DT", "PROD_SRVC_ID")]), 256
        ),
        1,
        12,
    )
    return pde.filter(bene != "").select(
        bene.alias("bene_id"),
        F.coalesce(F.concat(F.lit("PDE_"), pde_id), F.concat(F.lit("PDE_AUTO_"), row_hash)).alias("event_id"),
        pde_id.alias("pde_id"),
        clean.claim_date(F.col("SRVC_DT")).alias("event_date"),
        clean.blank_to_null(F.col("PROD_SRVC_ID")).alias("drug_code"),
    )


def consolidate_members(yearly: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per member: attributes of the first row by ``row_idx``, enrollment years as a sorted list."""
    first = F.min_by(F.struct(*attributes), "row_idx").alias("_first")
    years = F.concat_ws("|", F.array_sort(F.collect_set(F.col("year").cast("string")))).alias("enrollment_years")
    grouped = yearly.filter(clean.strip(F.col("bene_id")) != "").groupBy("bene_id").agg(first, years)
    return grouped.select("bene_id", *[F.col(f"_first.{a}").alias(a) for a in attributes], "enrollment_years")


def yearly_files(frames: dict[int, DataFrame]) -> DataFrame:
    """Union of per-year files with the year as a constant column."""
    return reduce(
        DataFrame.unionByName, [df.withColumn("year", F.lit(year)) for year, df in sorted(frames.items())]
    )


def cohort(members: DataFrame, order: str, size: int) -> DataFrame:
    """First ``size`` members by ``order``, numbered from 1."""
    return (
        members.orderBy(order)
        .limit(size)
        .transform(lambda d: global_rank(d, [F.col(order)], "member_no"))
        .withColumn("member_id", clean.numbered_id("BENE_", F.col("member_no"), 5))
    )


def assign_round_robin(rows: DataFrame, row_no: str, cohort_size: int, prefix: str, width: int = 7) -> DataFrame:
    """Row ``n`` (from 1) goes to cohort member ``(n - 1) % size + 1``; both ids come from the row number."""
    member_no = F.pmod(F.col(row_no) - 1, F.lit(cohort_size)) + 1
    return rows.withColumn("member_id", clean.numbered_id("BENE_", member_no, 5)).withColumn(
        "synthetic_claim_id", clean.numbered_id(prefix, F.col(row_no), width)
    )
