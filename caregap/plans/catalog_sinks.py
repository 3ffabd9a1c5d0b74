"""Round trips: tables written by the sinks and read back, batches through the file stream, the run log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregap import schemas
from caregap.functions import clean
from caregap.operators import evidence, ingest, lookup
from caregap.plans.registry import query
from caregap.session import ensure_checkpoint_dir, materialize
from caregap.sources import files, reference, sinks
from caregap.streaming.batches import ClaimsPipeline, History
from caregap.streaming.store import TableStore

# Least claims of one file of the stream, and most files: each file is a run of its own with a fixed cost, so files grow with the table.
FILE_ROWS = 5_000
FILES = 20


def _file_rows(first: int, last: int) -> int:
    """Row numbers of one file; a multiple of 50, so that both rows of a repeated claim id lie in one file."""
    share = -(-(last // 50 - first // 50 + 1) // FILES)
    return max(FILE_ROWS, 50 * share)


def _folder(f) -> str:
    return f"{ensure_checkpoint_dir(f.spark)}/stores/{uuid.uuid4().hex}"


def _pipeline(f, scoring: bool = True) -> ClaimsPipeline:
    history = History(f.members, f.batch_history, f.rx, f.batch_baseline, f.mapping)
    return ClaimsPipeline(f.spark, TableStore(f.spark, _folder(f)), history, scoring=scoring)


# --- sinks and sources ---------------------------------------------------------------


@query("s2_yearly_files", "SELECT bene_id, CAST(year AS INTEGER) AS year, state, sex FROM yearly_members")
def _(f):
    """One file set per year, the year taken from the path."""
    root = _folder(f)
    shown = {"BENE_ID": "bene_id", "STATE_CODE": "state", "SEX_IDENT_CD": "sex"}
    rows = f.yearly_members.select("year", *[F.col(c).alias(n) for n, c in shown.items()])
    rows.hint("rebalance", "year").write.partitionBy("year").csv(root, header=True, sep="|")
    years = sorted(r.year for r in rows.select("year").distinct().collect())  # at most one per calendar year
    read = files.read_yearly_members(f.spark, {y: f"{root}/year={y}" for y in years})
    return read.select(*[F.col(n).alias(c) for n, c in shown.items()], "year")


_STORED = "suspect_id, bene_id, hcc_v28, suspect_type, priority_score, status"


@query("s12_append_by_run", f"SELECT {_STORED}, r.run_id FROM suspects, (VALUES ('RUN-1'), ('RUN-2')) r(run_id)")
def _(f):
    path, rows = _folder(f), materialize(f.suspects.select(*_STORED.split(", ")))
    for run in ("RUN-1", "RUN-2"):
        sinks.append_partitioned(rows.withColumn("run_id", F.lit(run)), path)
    return f.spark.read.parquet(path)


@query("s14_full_reload", f"SELECT {_STORED} FROM suspects WHERE status = 'REVIEWED'")
def _(f):
    """A reload replaces the table, and a repeated one leaves it as it is."""
    path, rows = _folder(f), materialize(f.suspects.select(*_STORED.split(", ")))
    for part in (rows, *[rows.filter("status = 'REVIEWED'")] * 2):
        sinks.reload_table(part, path)
    return f.spark.read.parquet(path)


@query(
    "s16_review_export",
    """SELECT review_id AS "Review ID", bene_id AS "Bene ID", hcc_v28 AS "HCC Code", decision AS "Decision",
              strftime(reviewer_timestamp, '%Y-%m-%d %H:%M:%S') AS "Timestamp", notes || ', "seen"' || chr(10) || 'twice' AS "Notes"
       FROM reviews""",
)
def _(f):
    """Notes with separators, quotes and line ends survive the export."""
    path = _folder(f)
    noted = f.reviews.withColumn("notes", F.concat("notes", F.lit(', "seen"\ntwice')))
    sinks.export_reviews(noted, path)
    return f.spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


@query("s17_append_decisions", f"SELECT {', '.join(sinks.DECISION_COLUMNS)} FROM reviews")
def _(f):
    """Decisions appended in two parts."""
    path, rows = _folder(f), materialize(f.reviews)
    for decided in ("decision = 'SUPPORTED'", "decision <> 'SUPPORTED'"):
        sinks.append_decisions(rows.filter(decided), path)
    return f.spark.read.parquet(path).withColumn("reviewer_timestamp", F.col("reviewer_timestamp").cast("timestamp_ntz"))


@query(
    "s18_batch_csv_with_mark",
    """SELECT nullif(trim(bene_id), '') AS bene_id, claim_id, nullif(claim_date, '') AS claim_date, diagnosis_code, source, is_principal
       FROM batch_rows""",
)
def _(f):
    """A batch file whose first header name carries a byte-order mark."""
    path = _folder(f)
    f.batch_rows.drop("row_idx").withColumnRenamed("bene_id", "﻿bene_id").write.csv(path, header=True)
    rows = files.read_batch_csv(f.spark, path)
    return rows.select(*[clean.blank_to_null(F.col(c)).alias(c) for c in schemas.CLAIMS_BATCH.fieldNames() if c != "extra"])


@query(
    "r21_extra_in_payload",
    """SELECT row_idx, bene_id, CASE WHEN row_idx % 3 = 0 THEN 'override' ELSE source END AS source,
              CASE WHEN row_idx % 3 = 0 THEN CAST(row_idx AS VARCHAR) END AS note
       FROM batch_rows""",
)
def _(f):
    """Fields of an extra map join the payload and win over columns of the same name."""
    extra = F.when(F.col("row_idx") % 3 == 0, F.create_map(F.lit("source"), F.lit("override"), F.lit("note"), F.col("row_idx").cast("string")))
    rows = ingest.with_payload(f.batch_rows.select("row_idx", "bene_id", "source").withColumn("extra", extra))
    told = {c: F.get_json_object("raw_payload", f"$.{c}").alias(c) for c in ("bene_id", "source", "note")}
    return rows.select("row_idx", *told.values())


@query("j11_candidates_with_payloads", "SELECT bene_id, hcc_v28, gap_type, priority_score, evidence_summary AS summary FROM batch_suspects")
def _(f):
    """Stored payloads meet their candidates by the three-part key."""
    scored = materialize(f.batch_suspects)
    payloads = scored.select(*evidence.GAP, F.to_json(evidence.payload()).alias("input_payload"))
    return scored.select(*evidence.GAP, "priority_score").join(payloads, evidence.GAP).select(
        *evidence.GAP, "priority_score", F.get_json_object("input_payload", "$.summary").alias("summary")
    )


@query("q8_severity_file", "SELECT hcc_v28, severity_level FROM severity")
def _(f):
    path = _folder(f)
    f.severity.withColumn("severity_level", F.concat(F.lit(" "), "severity_level")).write.csv(path, header=True)
    return reference.read_severity(f.spark, path)


@query(
    "q8_contract_messages",
    """SELECT 'missing' AS defect, 'Severity reference is missing columns: [''severity_level'']' AS message
       UNION ALL SELECT 'text', 'severity_level must be numeric for every HCC reference row'
       UNION ALL SELECT 'repeated', 'Severity reference must contain one row per HCC V28'""",
)
def _(f):
    """Three defects of the reference table and the refusal each gets."""
    ref = materialize(f.severity)
    smallest = ref.agg(F.min("hcc_v28").alias("hcc_v28"))
    defects = {
        "missing": ref.drop("severity_level"),
        "text": ref.join(smallest.withColumn("hit", F.lit("high")), "hcc_v28", "left").select(
            "hcc_v28", F.coalesce("hit", F.col("severity_level").cast("string")).alias("severity_level")),
        "repeated": ref.unionByName(ref.join(smallest, "hcc_v28")),
    }
    return f.spark.createDataFrame([(n, _refusal(t)) for n, t in defects.items()], "defect string, message string")


def _refusal(table: DataFrame) -> str | None:
    try:
        lookup.severity_contract(table)
    except ValueError as error:
        return str(error)
    return None


# --- file stream -------------------------------------------------------------------------


def _delete(f, path: str) -> None:
    hadoop_path = f.spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(f.spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@query(
    "u1_file_stream",
    """SELECT bene_id, claim_id, reason, CASE WHEN reason IS NULL THEN CAST(try_strptime(raw_date, '%Y-%m-%d') AS DATE) END AS claim_date,
              CASE WHEN reason IS NULL THEN diagnosis_code END AS diagnosis_code, CASE WHEN reason IS NULL THEN source END AS source,
              CASE WHEN reason IS NULL THEN is_principal END AS is_principal
       FROM validated""",
)
def _(f):
    """All events as batch files through the file stream, with two replays of the last micro-batch.

    Its commit is taken out of the stream's log, so Spark hands it over again under
    the same number: first as a finished one (skipped), then as one that was lost
    half-way, without its end mark and its accepted claims (done again).
    """
    inbox, checkpoint = _folder(f), _folder(f)
    first, last = f.batch_rows.agg(F.min("row_idx"), F.max("row_idx")).first()
    part = F.floor(F.col("row_idx") / _file_rows(first or 0, last or 0)).alias("part")
    rows = f.batch_rows.select("*", part).repartition("part").sortWithinPartitions("part", "row_idx").drop("row_idx")
    rows.write.partitionBy("part").csv(inbox, header=True)
    pipeline = _pipeline(f, scoring=False)
    store = pipeline.store

    def run() -> int:
        pipeline.run_stream(f"{inbox}/*", checkpoint).awaitTermination()
        return max(int(n) for n in store._children(f"{checkpoint}/commits") if n.isdigit())

    last = run()
    _delete(f, f"{checkpoint}/commits/{last}")
    run()
    _delete(f, f"{checkpoint}/commits/{last}")
    _delete(f, store.partition_path("pipeline_runs", run_id=f"RUN-STREAM-{last:08d}", status="COMPLETED"))
    _delete(f, store.partition_path("claims", batch_id=f"STREAM-{last:08d}"))
    run()
    return _ingested(store)


def _ingested(store: TableStore) -> DataFrame:
    """Accepted and refused rows of all batches."""
    accepted = store.spark.read.parquet(f"{store.root}/claims")
    refused = store.spark.read.parquet(f"{store.root}/ingestion_rejections")

    def told(c: str) -> Column:
        return clean.blank_to_null(F.get_json_object("raw_data", f"$.{c}")).alias(c)

    columns = ["bene_id", "claim_id", "claim_date", "diagnosis_code", "source", "is_principal"]
    return accepted.select(*columns, F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select(told("bene_id"), told("claim_id"), "reason"), allowMissingColumns=True
    )


def _as_batch(claims: DataFrame) -> DataFrame:
    return claims.select(*[F.col(c).cast("string").alias(c) for c in schemas.CLAIMS_BATCH.fieldNames() if c != "extra"])


@query(
    "u6_run_log",
    """SELECT 'R1' AS run_id, 'COMPLETED' AS status, count(*) AS input_rows, count(DISTINCT claim_id) AS valid_rows,
              count(*) - count(DISTINCT claim_id) AS rejected_rows, CAST(NULL AS VARCHAR) AS error_message FROM batch_claims
       UNION ALL SELECT 'R2', 'FAILED', count(*), 0, count(*), 'Claim batch contains no claims: B2' FROM batch_claims""",
)
def _(f):
    """A run that ends well, and one whose members are all unknown."""
    pipeline, claims = _pipeline(f), materialize(_as_batch(f.batch_claims))
    pipeline.run_batch(claims, "B1", "R1")
    _refused(lambda: pipeline.run_batch(claims.withColumn("bene_id", F.concat(F.lit("?"), "bene_id")), "B2", "R2"))
    return pipeline.runs().select("run_id", "status", "input_rows", "valid_rows", "rejected_rows", "error_message")


def _refused(run) -> None:
    """Run what must be refused; the run log holds why."""
    try:
        run()
    except ValueError:
        return
    raise AssertionError("the run was not refused")


@query(
    "u5_unknown_member_fails",
    """SELECT 'R1' AS run_id, 'FAILED' AS status, 'Engine output references unknown bene_id' AS error, false AS has_suspects,
              count(DISTINCT claim_id) AS valid_rows FROM batch_claims""",
)
def _(f):
    """Members that leave the registry between ingest and scoring fail the run before any suspect is stored."""
    pipeline = _pipeline(f)
    validate = pipeline.ingest

    def ingest_then_lose_members(*args):
        counters = validate(*args)
        h = pipeline.history
        gone = F.pmod(F.xxhash64("bene_id"), F.lit(2)) == 0
        pipeline.history = History(h.members.filter(~gone), h.timeline, h.prescriptions, h.baseline, h.mapping)
        return counters

    pipeline.ingest = ingest_then_lose_members
    _refused(lambda: pipeline.run_batch(_as_batch(f.batch_claims), "B1", "R1"))
    return pipeline.runs().select(
        "run_id", "status", F.substring_index("error_message", ":", 1).alias("error"),
        F.lit(pipeline.store.snapshot("suspects") is not None).alias("has_suspects"), "valid_rows",
    )
