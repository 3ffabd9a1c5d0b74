"""Incremental claims batches: validate, score, upsert suspects, append evidence and payloads."""

from __future__ import annotations

import datetime as dt
import logging
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from caregap import schemas
from caregap.functions import clean
from caregap.operators import evidence, ingest, intervals, lookup, ml, ranking, review
from caregap.operators import timeline as timeline_ops
from caregap.session import materialize
from caregap.streaming.state import EvidenceState, absorb_claims
from caregap.streaming.store import TableStore

RUNNING, COMPLETED, FAILED = "RUNNING", "COMPLETED", "FAILED"
PROMPT_VERSION = "1.0"
logger = logging.getLogger(__name__)
RUN_SCHEMA = schemas.struct_of(
    "run_id string, status string, batch_id string, source_file string, input_rows bigint, valid_rows bigint, "
    "rejected_rows bigint, inserted_rows bigint, suspects bigint, evidence bigint, payloads bigint, "
    "error_message string, logged_at timestamp"
)


@dataclass(frozen=True)
class History:
    """Stored tables a run reads."""

    members: DataFrame
    timeline: DataFrame
    prescriptions: DataFrame
    baseline: DataFrame
    mapping: DataFrame


def suspect_table(scored: DataFrame, references: DataFrame, run_id: str) -> DataFrame:
    """Stored suspect rows of a run under their natural key, in the declared layout."""
    rows = scored.join(evidence.gap_sources(references), evidence.GAP, "left").withColumns(
        {
            "suspect_id": clean.suspect_key(F.col("bene_id"), F.col("hcc_v28"), F.col("gap_type")),
            "evidence_count": F.col("diagnosis_count"),
            "diversity_score": F.col("source_diversity_score"),
            "priority_level": F.col("priority"),
            "supporting_diagnosis_codes": F.concat_ws("|", "supporting_diagnosis_codes"),
            "has_prescription_support": F.col("prescription_support_count") > 0,
            "run_id": F.lit(run_id),
        }
    )
    return review.aligned(rows, schemas.SUSPECTS)


def suspect_claims(references: DataFrame) -> DataFrame:
    """All claim ids of a run's suspects: suspect_id, claim_id and position."""
    key = clean.suspect_key(F.col("bene_id"), F.col("hcc_v28"), F.col("gap_type")).alias("suspect_id")
    return evidence.gap_claims(references).select(key, "claim_id", "position")


def review_payloads(scored: DataFrame, references: DataFrame) -> DataFrame:
    """Reviewer records of a run, one per suspect: JSON input, deterministic narrative and its structured output.

    The references of a suspect are the rows of ``suspect_evidence``.
    """
    narrated = evidence.narratives(scored.join(evidence.gap_sources(references), evidence.GAP, "left"))
    output = F.to_json(
        F.struct("summary_title", "clinical_narrative", "evidence_breakdown", "verification_checklist", "ml_assessment",
                 "recommendation")
    )
    texts = narrated.select(*evidence.GAP, F.col("clinical_narrative").alias("reviewer_summary"), output.alias("output_payload"))
    records = scored.select(*evidence.GAP, F.to_json(evidence.payload()).alias("input_payload"))
    return records.join(texts, evidence.GAP).select(
        clean.suspect_key(F.col("bene_id"), F.col("hcc_v28"), F.col("gap_type")).alias("suspect_id"),
        F.lit(COMPLETED).alias("status"), F.lit(PROMPT_VERSION).alias("prompt_version"), "input_payload",
        "output_payload", "reviewer_summary",
    )


class ClaimsPipeline:
    """Runs claims batches against a table store."""

    def __init__(
        self, spark: SparkSession, store: TableStore, history: History, model: PipelineModel | None = None,
        state: EvidenceState | None = None, scoring: bool = True,
    ):
        """With a ``state`` (which holds the history), a run scores over all batches absorbed so far; without, over history and its batch.

        ``scoring=False`` gives a pipeline that validates and stores batches only.
        """
        self.spark, self.store, self.history, self.model, self.state = spark, store, history, model, state
        self.scoring = scoring

    # --- run log ----------------------------------------------------------------

    def _log(self, run_id: str, status: str, **values) -> None:
        row = {f.name: None for f in RUN_SCHEMA.fields} | values
        row |= {"run_id": run_id, "status": status, "logged_at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)}
        frame = self.spark.createDataFrame([tuple(row[n] for n in RUN_SCHEMA.fieldNames())], RUN_SCHEMA)
        self.store.write_partition(frame.coalesce(1), "pipeline_runs", run_id=run_id, status=status)

    def runs(self) -> DataFrame:
        """Newest status per run."""
        return review.latest_per_key(self.store.read("pipeline_runs", RUN_SCHEMA), "run_id", "logged_at")

    # --- one batch -------------------------------------------------------------------

    def refuse_known(self, batch_id: str, run_id: str) -> None:
        if self.store.exists(self.store.partition_path("pipeline_runs", run_id=run_id)):
            raise ValueError(f"Pipeline run already exists: {run_id}")
        if self.store.exists(self.store.partition_path("claim_batches", batch_id=batch_id)):
            raise ValueError(f"Claim batch already exists: {batch_id}")

    def ingest(
        self, rows: DataFrame, batch_id: str, run_id: str, source_file: str, source_system: str = "CLAIMS"
    ) -> dict[str, int]:
        """Validate and store one batch; accepted and rejected rows get the run's provenance."""
        # The staged copy fixes row numbers before they decide which duplicate comes first.
        serial = ingest.with_payload(rows)
        if "row_idx" not in rows.columns:
            serial = serial.withColumn("_serial", F.monotonically_increasing_id())
        self.store.write_partition(serial, "staged_claims", run_id=run_id)
        staged = self.store.read_partition("staged_claims", run_id=run_id)
        if "_serial" in staged.columns:
            staged = ingest.file_row_numbers(staged, "_serial")
        checked = materialize(ingest.validate_batch(staged, self.history.members))
        accepted = checked.filter(F.col("reason").isNull()).select(
            "row_idx", "claim_id", "bene_id", "claim_date", clean.blank_to_null(F.col("diagnosis_code")).alias("diagnosis_code"),
            clean.blank_to_null(F.col("source")).alias("source"),
            clean.parse_bool(F.col("is_principal"), accept_y=True).alias("is_principal"), "raw_payload",
        )
        rejected = checked.filter(F.col("reason").isNotNull()).select(
            F.lit(source_file).alias("source_file"), F.col("row_idx").alias("row_index"),
            F.col("raw_payload").alias("raw_data"), "reason",
        )
        self.store.write_partition(accepted, "claims", batch_id=batch_id)
        self.store.write_partition(rejected, "ingestion_rejections", run_id=run_id)
        counters = ingest.batch_counters(checked).first().asDict()
        received = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        batch = self.spark.createDataFrame(
            [(run_id, source_system, source_file, received, counters["inserted_rows"], "PROCESSED")],
            schemas.struct_of(
                "run_id string, source_system string, source_file string, received_at timestamp, row_count bigint, status string"
            ),
        )
        self.store.write_partition(batch.coalesce(1), "claim_batches", batch_id=batch_id)
        return counters

    def score(self, batch_id: str, run_id: str, current_year: int | None = None) -> dict[str, int]:
        """Score the stored batch and write suspects, evidence and reviewer records of the run."""
        h = self.history
        claims = self.store.read_partition("claims", batch_id=batch_id).withColumn("batch_id", F.lit(batch_id))
        if claims.isEmpty():
            raise ValueError(f"Claim batch contains no claims: {batch_id}")
        periods = evidence.batch_periods(claims, current_year)
        # Fills appended by earlier runs count like those of the history.
        appended = self.store.read("events_prescription", schemas.EVENTS_PRESCRIPTION)
        fills = h.prescriptions.unionByName(appended.select(*h.prescriptions.columns))
        members = claims.select("bene_id").distinct()
        if self.state is None:
            scored = evidence.run_batch_engine(h.timeline, claims, fills, h.baseline, h.mapping, periods)
            combined = timeline_ops.with_batch(h.timeline.join(members, "bene_id", "left_semi"), claims, h.mapping)
        else:
            absorb_claims(self.state, claims, h.mapping)
            scored = self.state.score(members, fills, h.baseline, h.mapping, periods)
            combined = self.state.events(members)
        if self.model is not None:
            # Ranks are positions inside this batch; the model never adds or removes gaps.
            scored = ranking.rank_by_expected_priority(ml.score_priority(scored, self.model))
        scored = materialize(scored)
        unknown = lookup.orphans(scored.select("bene_id"), h.members).first()
        if unknown is not None:
            raise ValueError(f"Engine output references unknown bene_id: {unknown['bene_id']}")
        references = materialize(evidence.evidence_references(evidence.gap_events(combined, scored, periods)))
        payloads = materialize(review_payloads(scored, references))
        evidence_days = references.select(*evidence.GAP, F.col("evidence_date").alias("event_date")).distinct()
        drugs = intervals.prescription_drugs(evidence_days, fills, evidence.GAP)
        keyed = scored.join(drugs, evidence.GAP, "left").withColumn("suspect_id", clean.suspect_key(F.col("bene_id"), F.col("hcc_v28"), F.col("gap_type")))
        summaries = payloads.select("suspect_id", "reviewer_summary")
        told = keyed.join(summaries, "suspect_id", "left")
        self.store.write_partition(evidence.evidence_rows(references, told, run_id), "suspect_evidence", run_id=run_id)
        self.store.write_partition(payloads, "review_payloads", run_id=run_id)
        self.store.write_partition(suspect_claims(references), "suspect_claims", run_id=run_id)
        fresh = suspect_table(
            told.withColumn("evidence_summary", F.coalesce("reviewer_summary", "evidence_summary")), references, run_id
        )
        self.store.upsert(
            fresh, "suspects", "suspect_id", lambda stored, rows: review.upsert_suspects(stored, rows, schemas.SUSPECTS)
        )
        return {
            "suspects": scored.count(),
            "evidence": references.count(),
            "payloads": payloads.count(),
        }

    def _run(self, rows: DataFrame, batch_id: str, run_id: str, source_file: str, current_year: int | None) -> dict:
        about = {"batch_id": batch_id, "source_file": source_file}
        self._log(run_id, RUNNING, **about)
        counters: dict[str, int] = {}
        try:
            counters |= self.ingest(rows, batch_id, run_id, source_file)
            if self.scoring:
                counters |= self.score(batch_id, run_id, current_year)
        except Exception as error:
            self._log(run_id, FAILED, **about, **counters, error_message=str(error))
            raise
        self._log(run_id, COMPLETED, **about, **counters)
        return {"run_id": run_id, "batch_id": batch_id, "status": COMPLETED, **counters}

    def run_batch(
        self, rows: DataFrame, batch_id: str, run_id: str, source_file: str = "claims_batch", current_year: int | None = None
    ) -> dict:
        """One explicit batch; a batch or run id that is already known is refused."""
        self.refuse_known(batch_id, run_id)
        return self._run(rows, batch_id, run_id, source_file, current_year)

    # --- file stream -----------------------------------------------------------------------

    def run_stream(self, directory: str, checkpoint: str, prefix: str = "STREAM", current_year: int | None = None) -> StreamingQuery:
        """Process every new batch file of a directory, then stop.

        Each file is a batch of its own. Ids come from the micro-batch number, so a
        retried micro-batch rewrites its own partitions, and one that had completed
        is skipped. A file whose claims are all rejected, or that fails for another
        reason of its content, is logged as FAILED with its rejections kept, and the
        stream goes on to the next file.
        """
        columns = [f for f in schemas.CLAIMS_BATCH.fields if f.name != "extra"]
        # Header names are checked against the schema, so files with another column order fail instead of shifting.
        stream = (
            self.spark.readStream.schema(T.StructType(columns))
            .option("maxFilesPerTrigger", 1)
            .csv(directory, header=True, enforceSchema=False)
        )

        def process(rows: DataFrame, number: int) -> None:
            batch_id, run_id = f"{prefix}-{number:08d}", f"RUN-{prefix}-{number:08d}"
            if not self.store.has_partition("pipeline_runs", run_id=run_id, status=COMPLETED):
                try:
                    self._run(rows, batch_id, run_id, directory, current_year)
                except ValueError as error:
                    logger.warning("batch %s failed: %s", batch_id, error)
                except (PySparkException, Py4JJavaError) as error:
                    if "CSV header does not conform" not in str(error):
                        raise  # not the file's fault: try again at the next start
                    logger.warning("batch %s failed: %s", batch_id, error)

        return (
            stream.writeStream.foreachBatch(process)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    # --- side inputs and decisions --------------------------------------------------------------

    def add_prescriptions(self, fills: DataFrame, run_id: str) -> int:
        """Append fills of known members that are not stored yet."""
        added = self.store.read("events_prescription", schemas.EVENTS_PRESCRIPTION)
        stored = self.history.prescriptions.select("event_id").unionByName(added.select("event_id"))
        fresh = ingest.insert_prescriptions(fills, stored, self.history.members)
        self.store.write_partition(fresh, "events_prescription", run_id=run_id)
        return self.store.read_partition("events_prescription", run_id=run_id).count()

    def decide(self, decisions: DataFrame, run_id: str) -> DataFrame:
        """Record valid decisions, mark their suspects reviewed, and return the refused ones with reasons."""
        suspects = self.store.snapshot("suspects")
        checked = materialize(review.check_decisions(decisions, suspects))
        accepted = checked.filter(F.col("reason").isNull()).drop("reason")
        self.store.write_partition(accepted, "review_decisions", run_id=run_id)
        # Accepted decisions name stored suspects; only the buckets of these are rewritten.
        self.store.upsert(checked.filter(F.col("reason").isNull()), "suspects", "suspect_id", review.apply_decisions)
        return checked.filter(F.col("reason").isNotNull())
