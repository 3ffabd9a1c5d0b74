"""Crosswalk lookups and membership filters.

No broadcast is forced: the crosswalk is read from one scan, so Spark sees its
size and broadcasts it below ``spark.sql.autoBroadcastJoinThreshold``; beyond
that it becomes a shuffled join that AQE can split on a hot code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.functions import clean


def one_per_key(df: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``. Pre-aggregates, so a hot key stays cheap."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c != key]
    kept = df.groupBy(key).agg(pick(F.struct(*rest), F.col(order)).alias("_row"))
    return kept.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def crosswalk(raw: DataFrame, last_wins: bool = False) -> DataFrame:
    """Code → category table with one row per code; blank categories become null."""
    rows = raw.filter(clean.strip(F.col("diagnosis_code")) != "")
    return one_per_key(rows, "diagnosis_code", "row_idx", last=last_wins).withColumn(
        "hcc_v28", clean.blank_to_null(F.col("hcc_v28"))
    ).drop("row_idx")


def with_hcc(df: DataFrame, mapping: DataFrame, code: str = "diagnosis_code", extra: tuple[str, ...] = ()) -> DataFrame:
    """Left outer code lookup, one row in, one row out."""
    side = mapping.select(F.col("diagnosis_code").alias(code), "hcc_v28", F.lit(True).alias("in_crosswalk"), *extra)
    return df.join(side, code, "left").withColumn("in_crosswalk", F.coalesce("in_crosswalk", F.lit(False)))


def hcc_descriptions(mapping: DataFrame) -> DataFrame:
    """First non-null description per category, by lowest diagnosis code."""
    return (
        mapping.filter(F.col("hcc_v28").isNotNull() & F.col("description").isNotNull())
        .groupBy("hcc_v28")
        .agg(F.min_by("description", "diagnosis_code").alias("hcc_description"))
    )


def with_description(df: DataFrame, mapping: DataFrame) -> DataFrame:
    return df.join(hcc_descriptions(mapping), "hcc_v28", "left").withColumn(
        "hcc_description", F.coalesce("hcc_description", F.lit("Unknown"))
    )


def of_members(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of known members."""
    return df.join(members.select("bene_id"), "bene_id", "left_semi")


def orphans(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows without a member."""
    return df.join(members.select("bene_id"), "bene_id", "left_anti")


def severity_contract(reference: DataFrame) -> DataFrame:
    """Checked severity table; raises when a column is missing, a level is no number or a category repeats."""
    missing = sorted({"hcc_v28", "severity_level"} - set(reference.columns))
    if missing:
        raise ValueError(f"Severity reference is missing columns: {missing}")
    ref = reference.select(
        clean.strip(F.col("hcc_v28")).alias("hcc_v28"),
        clean.to_number(F.col("severity_level")).alias("severity_level"),
    )
    bad = ref.agg(
        F.count_if(F.col("severity_level").isNull()).alias("not_numeric"),
        (F.count("hcc_v28") - F.count_distinct("hcc_v28")).alias("repeated"),
    ).first()
    if bad["not_numeric"]:
        raise ValueError("severity_level must be numeric for every HCC reference row")
    if bad["repeated"]:
        raise ValueError("Severity reference must contain one row per HCC V28")
    return ref
