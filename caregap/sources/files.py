"""Delimited claims files: all-string scans with tolerant columns, and input discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caregap import schemas
from caregap.operators import reshape

CLAIM_COLUMNS = ("BENE_ID", "CLM_ID", "CLM_FROM_DT", "CLM_THRU_DT", "PRNCPAL_DGNS_CD")
PDE_COLUMNS = ("BENE_ID", "PDE_ID", "SRVC_DT", "PROD_SRVC_ID")
MEMBER_COLUMNS = (
    "BENE_ID", "BENE_BIRTH_DT", "SEX_IDENT_CD", "BENE_RACE_CD", "STATE_CODE", "COUNTY_CD", "ZIP_CD", "ESRD_IND",
    "BENE_DEATH_DT",
)


def read_delimited(spark: SparkSession, path: str, sep: str = "|", required: tuple[str, ...] = ()) -> DataFrame:
    """All-string scan by header name. A byte-order mark is dropped and absent columns are added as nulls."""
    raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', encoding="UTF-8")
    clean_names = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    missing = {c: F.lit(None).cast("string") for c in required if c not in clean_names.columns}
    return clean_names.withColumns(missing) if missing else clean_names


def read_claims(spark: SparkSession, path: str, source: str) -> DataFrame:
    slots = tuple(f"ICD_DGNS_CD{i}" for i in range(1, schemas.SOURCE_SLOTS[source] + 1))
    return read_delimited(spark, path, required=(*CLAIM_COLUMNS, *slots))


def read_batch_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma-delimited claims batch, possibly with a byte-order mark."""
    required = tuple(c for c in schemas.CLAIMS_BATCH.fieldNames() if c != "extra")
    return read_delimited(spark, path, sep=",", required=required)


def read_csv_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """Comma table by column name with a declared schema; nothing is inferred."""
    raw = read_delimited(spark, path, sep=",", required=tuple(schema.fieldNames()))
    return raw.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema])


def read_yearly_members(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """One file per year, united with the year as a column and a stable row order for first-wins rules."""
    frames = {}
    for year, path in paths.items():
        raw = read_delimited(spark, path, required=MEMBER_COLUMNS)
        frames[year] = raw.select(*MEMBER_COLUMNS).withColumn(
            "row_idx", F.struct(F.lit(year).alias("year"), F.monotonically_increasing_id().alias("row"))
        )
    return reshape.yearly_files(frames)


def members_from_files(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Registry of members over all yearly files."""
    from caregap.functions import clean

    text = {"sex": "SEX_IDENT_CD", "race": "BENE_RACE_CD", "state": "STATE_CODE", "county": "COUNTY_CD", "zip": "ZIP_CD",
            "esrd_indicator": "ESRD_IND"}
    rows = read_yearly_members(spark, paths).select(
        clean.strip(F.col("BENE_ID")).alias("bene_id"), "row_idx", "year",
        clean.claim_date(F.col("BENE_BIRTH_DT")).alias("birth_date"),
        clean.claim_date(F.col("BENE_DEATH_DT")).alias("death_date"),
        *[clean.strip(F.col(c)).alias(n) for n, c in text.items()],
    )
    attributes = [c for c in schemas.MEMBERS.fieldNames() if c not in ("bene_id", "enrollment_years")]
    return reshape.consolidate_members(rows, attributes).select(*schemas.MEMBERS.fieldNames())


def list_files(spark: SparkSession, directory: str) -> dict[str, str]:
    """Lower-case base name → path for every file below a directory, on any Hadoop file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(path, True)
    found = {}
    while files.hasNext():
        status = files.next()
        found[status.getPath().getName().lower()] = status.getPath().toString()
    return found


def read_claims_directory(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claim rows, prescriptions, per-source statistics) of an upload directory.

    File names match in any case. At least one of the three claims files is
    needed; the pharmacy file is optional.
    """
    from caregap.operators import ingest

    files = list_files(spark, directory)
    sources = {name: source for name, source in schemas.SOURCE_FILES.items() if name in files}
    if not sources:
        raise ValueError(
            f"Directory must contain at least one of: {', '.join(schemas.SOURCE_FILES)}. Found: {sorted(files) or '(empty)'}"
        )
    rows = stats = None
    for name, source in sources.items():
        wide = read_claims(spark, files[name], source).withColumn("source", F.lit(source))
        part = reshape.upload_claim_rows(wide, source)
        part_stats = ingest.source_stats(wide, part)
        rows = part if rows is None else rows.unionByName(part)
        stats = part_stats if stats is None else stats.unionByName(part_stats)
    if schemas.PRESCRIPTION_FILE in files:
        fills = reshape.prescriptions(
            read_delimited(spark, files[schemas.PRESCRIPTION_FILE], required=PDE_COLUMNS)
        )
    else:
        fills = spark.createDataFrame([], schemas.EVENTS_PRESCRIPTION).select(
            "bene_id", "event_id", "pde_id", "event_date", "drug_code"
        )
    return rows, fills, stats
