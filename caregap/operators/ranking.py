"""Global positions, top-k and the review ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caregap import schemas
from caregap.functions import clean, scores
from caregap.session import checkpointed, materialize

QUEUE_SIZE = 100


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Dense position 1..n in a total order, without moving all rows into one task.

    Range-partition and sort, checkpoint (so both uses below read the same
    partitions even after an executor is lost), then add each partition's start
    offset to the row's place inside it. The offset table has one row per
    partition, so the broadcast does not grow with the data. ``order`` must end
    in a unique key.
    """
    placed = (
        checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_place") + 1)
        .drop("_part", "_place", "_start")
    )


def running_totals(df: DataFrame, order: list[Column], values: dict[str, str]) -> DataFrame:
    """Sum of each column up to and including the row, in a total order, without one task for all rows.

    ``values`` maps new names to columns. Range-partitioned and stored, summed
    inside each partition, and shifted by the totals of the earlier partitions.
    """
    placed = checkpointed(df.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in values.items()])
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in values])
    return (
        placed.withColumns({n: F.sum(c).over(inside) for n, c in values.items()})
        .join(F.broadcast(starts), "_part")  # one row per partition
        .withColumns({n: F.col(n) + F.col(f"_{n}") for n in values})
        .drop("_part", *[f"_{n}" for n in values])
    )


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows: each task keeps its own ``k``, then they are merged."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "position") -> DataFrame:
    """``row_number <= k`` per group; Spark cuts each group to ``k`` before the shuffle, so hot groups stay small."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).filter(
        F.col(name) <= k
    )


def at_positions(df: DataFrame, order: list[Column], positions: list[int]) -> DataFrame:
    """Rows at 0-based positions of a total order."""
    return global_rank(df, order, "_no").filter(F.col("_no").isin([p + 1 for p in positions])).withColumn(
        "sample_position", F.col("_no") - 1
    ).drop("_no")


def evenly_spaced(df: DataFrame, order: list[Column], count: int = 10) -> DataFrame:
    """``count`` rows at positions ``int(i * (n - 1) / (count - 1))``."""
    n = df.count()
    return at_positions(df, order, [int(i * (n - 1) / (count - 1)) for i in range(count)]) if n else df


def sequence_suspects(suspects: DataFrame) -> DataFrame:
    """``SUSP_0000001``-style ids in (member, emerging before recapture, category) order."""
    order = [
        F.col("bene_id"),
        F.when(F.col("suspect_type") == schemas.EMERGING, 0).otherwise(1),
        clean.hcc_order(F.col("hcc_v28")),
        F.col("hcc_v28"),
    ]
    return global_rank(suspects, order, "_no").withColumn(
        "suspect_id", clean.numbered_id("SUSP_", F.col("_no"), 7)
    ).drop("_no")


def review_scores(candidates: DataFrame, severity: DataFrame | None = None, use_severity: bool = False) -> DataFrame:
    """Evidence strength, urgency and blended review score.

    A severity reference is inert by default (weight 0, every row marked as
    missing), which is what the established ranking does; ``use_severity=True``
    gives the intended 0.65 / 0.15 / 0.20 blend.
    """
    parts = {
        c: scores.unit_clip(F.col(c).cast("double")) if c in candidates.columns else F.lit(0.0)
        for c in scores.EVIDENCE_WEIGHTS
    }
    ranked = candidates.withColumns(parts)
    ranked = ranked.withColumn(
        "evidence_strength_score", scores.round_scaled(scores.weighted_sum({c: F.col(c) for c in parts}), 4)
    ).withColumn("gap_urgency_score", scores.gap_urgency(F.col("gap_type"), F.col("latest_context")))
    severity_weight, evidence_weight = F.lit(0.0), F.lit(0.78)
    if severity is None:
        ranked = ranked.withColumn("severity_score", F.lit(0.0)).withColumn(
            "severity_reference_status", F.lit("NOT_AVAILABLE")
        )
    elif not use_severity:
        ranked = ranked.withColumn("severity_score", F.lit(0.0)).withColumn(
            "severity_reference_status", F.lit("MISSING_HCC_REFERENCE")
        )
    else:
        levels = severity.select("hcc_v28", "severity_level")
        joined = ranked.join(levels, "hcc_v28", "left")
        # Scalar subquery: the largest level that occurs among the candidates.
        occurring = levels.join(candidates.select("hcc_v28"), "hcc_v28", "left_semi")
        largest = occurring.agg(F.max("severity_level")).scalar()
        ranked = (
            joined.withColumn("_largest", largest)
            .withColumn(
                "severity_score",
                F.when(F.col("_largest") > 0, scores.unit_clip(F.col("severity_level") / F.col("_largest"))).otherwise(
                    F.coalesce(F.col("severity_level"), F.lit(0.0))
                ),
            )
            .withColumn(
                "severity_reference_status",
                F.when(F.col("severity_score") > 0, "AVAILABLE").otherwise("MISSING_HCC_REFERENCE"),
            )
        )
        severity_weight = F.when(F.col("_largest") > 0, 0.20).otherwise(0.0)
        evidence_weight = F.when(F.col("_largest") > 0, 0.65).otherwise(0.78)
    urgency_weight = F.lit(1.0) - evidence_weight - severity_weight
    ranked = ranked.withColumn(
        "review_priority_score",
        scores.round_scaled(
            evidence_weight * F.col("evidence_strength_score")
            + urgency_weight * F.col("gap_urgency_score")
            + severity_weight * F.col("severity_score"),
            4,
        ),
    ).withColumn("ranking_model", F.lit("evidence_urgency_severity_v1"))
    return ranked.drop("_largest", "severity_level")


REVIEW_ORDER = ("review_priority_score", "evidence_strength_score", "diagnosis_count")


def review_order() -> list[Column]:
    """Three descending keys, then (member, category, type) so that ties have one order."""
    return [F.desc(c) for c in REVIEW_ORDER] + [
        F.col("bene_id"),
        clean.hcc_order(F.col("hcc_v28").cast("string")),
        F.col("gap_type"),
    ]


def rank_candidates(candidates: DataFrame, severity: DataFrame | None = None, use_severity: bool = False) -> DataFrame:
    # Stored first: the range sample and the sort would each compute the candidates again.
    scored = materialize(review_scores(candidates, severity, use_severity))
    return global_rank(scored, review_order(), "review_rank").withColumn(
        "review_queue", F.col("review_rank") <= QUEUE_SIZE
    )


def rank_by_expected_priority(scored: DataFrame) -> DataFrame:
    """Position by expected priority, P(HIGH), then member, category and type."""
    order = [
        F.desc("ml_priority_score"),
        F.desc("ml_high_probability"),
        F.col("bene_id"),
        clean.hcc_order(F.col("hcc_v28").cast("string")),
        F.col("gap_type"),
    ]
    return global_rank(scored, order, "ml_review_rank").withColumn(
        "ml_top_100", F.col("ml_review_rank") <= QUEUE_SIZE
    )
