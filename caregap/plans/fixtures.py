"""The supplied test tables seen as a claims model.

``Fixtures`` builds each table as a DataFrame; ``oracle_tables`` states the same
tables as SQL, so queries and their checks share one definition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caregap.functions import clean, scores
from caregap.operators import evidence, gaps, lookup, profile
from caregap.operators import ingest as ingest_ops
from caregap.operators import timeline as timeline_ops
from caregap.schemas import Periods
from caregap.session import materialize

PERIODS = Periods(historical=(1998, 1999), current=2000, latest=2001)
RETROSPECTIVE = Periods(historical=(1997, 1998), current=1999, latest=2000)
BATCH = Periods.two_years_before(2001)
BATCH_ID = "B200101"
COHORT = 5000
WIDE_SLOTS = 25


# Schemas already read from file footers, by path.
_SCHEMAS: dict = {}


def member_id(key: Column) -> Column:
    return clean.numbered_id("B", key, 8)


def code_id(key: Column) -> Column:
    return clean.numbered_id("D", key, 6)


def source_of(status: Column) -> Column:
    return F.when(status == "F", "INPATIENT").when(status == "O", "OUTPATIENT").otherwise("CARRIER")


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    @cached_property
    def members(self) -> DataFrame:
        rows = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        key = F.col("c_custkey")
        return rows.select(
            member_id(key).alias("bene_id"),
            F.date_add(F.lit("1925-01-01").cast("date"), (key % 20000).cast("int")).alias("birth_date"),
            F.when(key % 2 == 0, "2").otherwise("1").alias("sex"),
            F.col("c_mktsegment").alias("race"),
            F.col("n_name").alias("state"),
        )

    @cached_property
    def raw_mapping(self) -> DataFrame:
        size = F.col("p_size")
        return self.table("part").select(
            F.col("p_partkey").alias("row_idx"),
            code_id(F.col("p_partkey")).alias("diagnosis_code"),
            F.col("p_name").alias("description"),
            F.when(size <= 30, size.cast("string")).otherwise("").alias("hcc_v28"),
            (size % 2 == 0).alias("payment_2026"),
        )

    @cached_property
    def mapping(self) -> DataFrame:
        """One row per code; part keys are unique, so no deduplication is needed here."""
        return self.raw_mapping.withColumn("hcc_v28", clean.blank_to_null(F.col("hcc_v28"))).drop("row_idx")

    @cached_property
    def repeated_mapping(self) -> DataFrame:
        """Crosswalk rows whose codes repeat, for the first-wins and last-wins loads."""
        return self.raw_mapping.withColumn(
            "diagnosis_code", code_id(F.floor(F.col("row_idx") / 3).cast("bigint"))
        )

    @cached_property
    def dx(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        source = source_of(F.col("o_orderstatus"))
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            member_id(F.col("o_custkey")).alias("bene_id"),
            F.concat_ws("_", source, F.col("l_orderkey"), F.col("l_linenumber")).alias("event_id"),
            F.col("l_orderkey").cast("string").alias("claim_id"),
            F.col("o_orderdate").cast("date").alias("event_date"),
            source.alias("source"),
            code_id(F.col("l_partkey")).alias("diagnosis_code"),
            (F.col("l_linenumber") == 1).alias("is_principal"),
        )

    @cached_property
    def rx(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        lines = self.table("lineitem").filter(F.col("l_returnflag") == "R")
        pde = F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey")
        # The event id follows from the fill id; it is added behind the shuffle.
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                member_id(F.col("o_custkey")).alias("bene_id"),
                pde.alias("pde_id"),
                F.col("l_shipdate").cast("date").alias("event_date"),
                F.col("l_suppkey").cast("string").alias("drug_code"),
            )
            .distinct()
            .select("bene_id", F.concat(F.lit("PDE_"), "pde_id").alias("event_id"), "pde_id", "event_date", "drug_code")
        )

    @cached_property
    def dx_timeline(self) -> DataFrame:
        """Diagnosis part of the timeline; most operators need no prescriptions in it."""
        return timeline_ops.diagnosis_rows(self.dx, self.mapping).drop("in_crosswalk")

    @cached_property
    def timeline(self) -> DataFrame:
        return timeline_ops.build_timeline(self.dx, self.rx, self.mapping)

    @cached_property
    def profile_rows(self) -> DataFrame:
        return profile.member_diagnoses(self.dx, self.mapping)

    @cached_property
    def baseline(self) -> DataFrame:
        return gaps.baseline_pairs(self.dx_timeline, PERIODS)

    @cached_property
    def suspects_v1(self) -> DataFrame:
        return evidence.suspects_v1(self.dx_timeline, self.rx, self.members, self.mapping, PERIODS)

    @cached_property
    def gaps_v2(self) -> DataFrame:
        return gaps.gaps_v2(self.dx_timeline, None, PERIODS)

    @cached_property
    def gap_events(self) -> DataFrame:
        return evidence.gap_events(self.dx_timeline, self.gaps_v2, PERIODS)

    @cached_property
    def suspects_v2(self) -> DataFrame:
        return evidence.suspects_v2(self.dx_timeline, self.rx, None, self.mapping, PERIODS)

    def stored(self, *names: str) -> Fixtures:
        """Store derived tables that a query uses more than once, so that each is computed once."""
        for name in names:
            self.__dict__[name] = materialize(getattr(self, name))
        return self

    def stored_timeline(self) -> Fixtures:
        """Store the timeline once; its diagnosis part is read from the same table."""
        self.__dict__["timeline"] = materialize(self.timeline)
        self.__dict__["dx_timeline"] = self.timeline.filter(F.col("event_type") == "diagnosis")
        return self

    # --- review workspace -----------------------------------------------------

    @cached_property
    def suspects(self) -> DataFrame:
        """Stored suspects: v1 rows under the natural key, a few of them already reviewed."""
        rows = self.suspects_v1
        hcc = F.col("hcc_v28").cast("int")
        return rows.select(
            clean.suspect_key(F.col("bene_id"), F.col("hcc_v28"), F.col("suspect_type")).alias("suspect_id"),
            "bene_id", "hcc_v28", "hcc_description", "suspect_type", "supporting_diagnosis_codes", "evidence_count",
            "first_evidence_date", "last_evidence_date", "priority_score",
            scores.tier(F.col("priority_score")).alias("ml_priority"),
            F.when(hcc % 7 == 0, "REVIEWED").otherwise("PENDING_REVIEW").alias("status"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        """Reviewer input: every category divisible by 5, one value in four invalid."""
        hcc = F.col("hcc_v28").cast("int")
        number = F.substring("bene_id", 2, 20).cast("bigint")
        pick = (number + hcc) % 4
        decision = (
            F.when(pick == 0, " supported ").when(pick == 1, "NOT_SUPPORTED").when(pick == 2, "INSUFFICIENT_EVIDENCE")
            .otherwise("MAYBE")
        )
        return self.suspects.filter(hcc % 5 == 0).select(
            F.concat(F.lit("R-"), "suspect_id").alias("review_id"),
            "suspect_id",
            decision.alias("decision"),
            F.concat(F.lit("Chart "), number.cast("string"), F.lit(" of HCC "), F.col("hcc_v28")).alias("notes"),
            F.timestamp_seconds(F.lit(978307200) + (number % 1000) * 3600 + hcc).alias("reviewer_timestamp"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        """Accepted decisions with the suspect snapshot."""
        from caregap.operators import review

        return review.check_decisions(self.decisions, self.suspects).filter(F.col("reason").isNull()).drop("reason")

    @cached_property
    def severity(self) -> DataFrame:
        """Severity reference over the categories of the crosswalk."""
        hcc = F.col("hcc_v28")
        return self.mapping.filter(hcc.isNotNull()).select(hcc).distinct().withColumn(
            "severity_level", (hcc.cast("int") % 5 + 1).cast("double")
        )

    # --- raw claims and batches --------------------------------------------------

    @cached_property
    def wide_claims(self) -> DataFrame:
        """One raw claim per order with dirty codes, month-name dates, blank ids and missing from-dates."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        code = code_id(F.col("l_partkey"))
        # Every line of an order takes the next slot; an order has few lines.
        codes = F.array_sort(F.collect_list(F.struct("l_linenumber", code.alias("code"))))["code"]
        per_order = self.table("lineitem").groupBy("l_orderkey").agg(codes.alias("codes")).select(
            "l_orderkey", *[F.get("codes", F.lit(i)).alias(f"c{i}") for i in range(WIDE_SLOTS + 1)]
        )
        key = F.col("o_orderkey")

        def dirty(name: str) -> Column:
            c = F.col(name)
            return F.coalesce(
                F.concat(F.lit(" "), F.lower(F.substring(c, 1, 4)), F.lit("."), F.substring(c, 5, 20), F.lit(" ")),
                F.lit("NULL"),
            )

        return per_order.join(orders, F.col("l_orderkey") == key).select(
            key.alias("row_idx"),
            F.when(key % 97 == 0, " ").otherwise(member_id(F.col("o_custkey"))).alias("BENE_ID"),
            key.cast("string").alias("CLM_ID"),
            F.when(key % 10 == 0, "").otherwise(F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy"))).alias("CLM_FROM_DT"),
            F.date_format("o_orderdate", "dd-MMM-yyyy").alias("CLM_THRU_DT"),
            dirty("c0").alias("PRNCPAL_DGNS_CD"),
            F.col("c1").alias("ADMTG_DGNS_CD"),
            *[dirty(f"c{i}").alias(f"ICD_DGNS_CD{i}") for i in range(1, WIDE_SLOTS + 1)],
            source_of(F.col("o_orderstatus")).alias("source"),
        )

    @cached_property
    def pde(self) -> DataFrame:
        """Raw fills from returned lines; some without a fill id, some without a member id."""
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        lines = self.table("lineitem").filter(F.col("l_returnflag") == "R")
        key = F.col("l_orderkey")
        return lines.join(orders, key == F.col("o_orderkey")).select(
            F.when(key % 97 == 0, " ").otherwise(member_id(F.col("o_custkey"))).alias("BENE_ID"),
            F.when(key % 5 == 0, "").otherwise(F.concat_ws("_", key, "l_linenumber", "l_partkey")).alias("PDE_ID"),
            F.date_format("l_shipdate", "dd-MMM-yy").alias("SRVC_DT"),
            F.concat(F.lit(" "), F.col("l_suppkey").cast("string")).alias("PROD_SRVC_ID"),
        )

    @cached_property
    def yearly_members(self) -> DataFrame:
        """Beneficiary rows per year: one per order, so members repeat within and across years."""
        year = F.year("o_orderdate")
        return (
            self.table("orders")
            .filter(clean.in_years(F.col("o_orderdate").cast("date"), PERIODS.historical + (PERIODS.current,)))
            .select(
                F.col("o_orderkey").alias("row_idx"), member_id(F.col("o_custkey")).alias("bene_id"),
                year.alias("year"), F.col("o_orderpriority").alias("state"), F.col("o_orderstatus").alias("sex"),
            )
        )

    @cached_property
    def batch_rows(self) -> DataFrame:
        """Ingest batch from the event stream with each kind of defect mixed in."""
        key, user = F.col("event_id"), F.col("user_id")
        defect = key % 50
        return self.table("events").select(
            key.alias("row_idx"),
            F.when(defect == 7, " ").when(defect == 17, F.concat(F.lit("X"), user.cast("string")))
            .otherwise(member_id(user)).alias("bene_id"),
            F.when(defect == 11, key - 1).when(defect == 23, F.lit(None)).otherwise(key).cast("string").alias("claim_id"),
            F.when(defect == 13, "2024-13-45").when(defect == 29, "").otherwise(F.date_format("ts", "yyyy-MM-dd"))
            .alias("claim_date"),
            code_id(F.regexp_extract("props", r'"k": (\d+)', 1).cast("bigint")).alias("diagnosis_code"),
            F.col("event_type").alias("source"),
            F.when(key % 3 == 0, "Y").otherwise("no").alias("is_principal"),
        )

    @cached_property
    def validated(self) -> DataFrame:
        return ingest_ops.validate_batch(self.batch_rows, self.members)

    @cached_property
    def batch_claims(self) -> DataFrame:
        """Scoring batch: diagnoses of January 2001."""
        day = F.col("event_date")
        return self.dx.filter(day.between(F.lit("2001-01-01").cast("date"), F.lit("2001-01-31").cast("date"))).select(
            F.lit(BATCH_ID).alias("batch_id"), "claim_id", "bene_id", day.alias("claim_date"), "diagnosis_code",
            "source", "is_principal",
        )

    @cached_property
    def batch_history(self) -> DataFrame:
        return self.dx_timeline.filter(F.col("event_date") < F.lit("2001-01-01").cast("date"))

    @cached_property
    def batch_baseline(self) -> DataFrame:
        return (
            gaps.diagnoses(self.batch_history)
            .filter(clean.in_years(F.col("event_date"), BATCH.historical))
            .select(*gaps.PAIR)
            .distinct()
        )

    @cached_property
    def batch_suspects(self) -> DataFrame:
        return evidence.run_batch_engine(
            self.batch_history, self.batch_claims, self.rx, self.batch_baseline, self.mapping, BATCH
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Fixed class probabilities per v1 suspect, from its component scores."""
        raw = [0.5 + F.col("recency_score"), 1.0 + F.col("frequency_score"), 0.25 + F.col("persistence_score")]
        total = raw[0] + raw[1] + raw[2]
        actual = scores.tier(F.col("priority_score"))
        return self.suspects_v1.select(
            "bene_id", "hcc_v28", F.col("suspect_type").alias("gap_type"), actual.alias("actual"),
            F.array(*[r / total for r in raw]).alias("probability"),
        )

    @cached_property
    def descriptions(self) -> DataFrame:
        return lookup.hcc_descriptions(self.mapping)
