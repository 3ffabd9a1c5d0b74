"""Reference tables: the code → category crosswalk and the severity levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caregap.functions import clean
from caregap.operators import lookup

# Positions of the crosswalk sheet: code, description, category, payment flag.
SHEET_POSITIONS = {"code": 0, "description": 1, "v28": 5, "payment": 10}


def crosswalk_sheet(sheet: DataFrame) -> DataFrame:
    """Cleaned code, description, category as integer text (or ``''``) and payment flag; blank codes dropped."""
    hcc = clean.to_number(F.col("v28")).cast("bigint").cast("string")
    rows = sheet.select(
        clean.clean_code_keep_dots(F.col("code")).alias("diagnosis_code"),
        F.coalesce(clean.strip(F.col("description")), F.lit("")).alias("description"),
        F.coalesce(hcc, F.lit("")).alias("hcc_v28"),
        F.coalesce(clean.strip(F.col("payment")) == "Yes", F.lit(False)).alias("payment_2026"),
    )
    return rows.filter(F.col("diagnosis_code").isNotNull())


def read_crosswalk_sheet(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited export of the crosswalk sheet; columns are taken by position."""
    raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"')
    return crosswalk_sheet(
        raw.select(*[F.col(f"`{raw.columns[i]}`").alias(name) for name, i in SHEET_POSITIONS.items()])
    )


def read_mapping(spark: SparkSession, path: str, last_wins: bool = False) -> DataFrame:
    """Stored crosswalk with one row per code; file order decides between repeated codes."""
    raw = spark.read.csv(path, header=True, schema="diagnosis_code string, description string, hcc_v28 string, payment_2026 string", enforceSchema=False)
    numbered = raw.withColumn("row_idx", F.monotonically_increasing_id()).withColumn(
        "payment_2026", clean.parse_bool(F.col("payment_2026"))
    ).withColumn("diagnosis_code", clean.strip(F.col("diagnosis_code")))
    return lookup.crosswalk(numbered, last_wins)


def read_severity(spark: SparkSession, path: str) -> DataFrame:
    return lookup.severity_contract(spark.read.csv(path, header=True))
