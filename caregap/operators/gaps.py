"""Gap detection: which (member, category) pairs appear in one period and not in another.

All rules start from ``pair_presence``: one aggregation that yields a row per
pair with a flag per period. A member has at most one row per category there,
so nothing after it can be skewed, and no anti joins are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caregap import schemas
from caregap.functions import clean, text
from caregap.schemas import Periods

PAIR = ["bene_id", "hcc_v28"]


def diagnoses(timeline: DataFrame) -> DataFrame:
    """Dated diagnosis events with a category."""
    return timeline.filter(
        (F.lower(F.col("event_type")) == "diagnosis")
        & F.col("event_date").isNotNull()
        & F.col("hcc_v28").isNotNull()
        & (F.col("hcc_v28") != "")
    )


def pair_presence(timeline: DataFrame, periods: Periods) -> DataFrame:
    """Per pair: seen in the historical, current and latest window."""
    latest = [] if periods.latest is None else [periods.latest]
    events = diagnoses(timeline).filter(clean.in_years(F.col("event_date"), periods.loaded_years))
    day = F.col("event_date")
    return events.groupBy(*PAIR).agg(
        F.max(clean.in_years(day, periods.historical)).alias("in_historical"),
        F.max(clean.in_years(day, [periods.current])).alias("in_current"),
        F.max(clean.in_years(day, latest)).alias("in_latest"),
    )


def baseline_pairs(timeline: DataFrame, periods: Periods) -> DataFrame:
    return pair_presence(timeline, periods).filter("in_historical").select(*PAIR)


def emerging_v0(timeline: DataFrame, periods: Periods) -> DataFrame:
    """Current minus historical over every member that has diagnoses."""
    return pair_presence(timeline, periods).filter("in_current AND NOT in_historical").select(*PAIR)


def gaps_v1(timeline: DataFrame, members: DataFrame, periods: Periods) -> DataFrame:
    """Both gap directions over registered members; a baseline is not required."""
    presence = pair_presence(timeline, periods).filter("in_current <> in_historical")
    return presence.join(members.select("bene_id"), "bene_id", "left_semi").select(
        *PAIR, F.when(F.col("in_current"), schemas.EMERGING).otherwise(schemas.RECAPTURE).alias("gap_type")
    )


def gaps_v2(
    timeline: DataFrame, baseline: DataFrame | None, periods: Periods, latest_is_current: bool = False
) -> DataFrame:
    """Both directions against a baseline, only for members that have a baseline row.

    Without a baseline table the historical pairs of the timeline are the baseline.
    ``latest_is_current`` is the batch-run rule, where no later year exists yet.
    """
    return gaps_from_presence(pair_presence(timeline, periods), baseline, latest_is_current)


def gaps_from_presence(presence: DataFrame, baseline: DataFrame | None, latest_is_current: bool = False) -> DataFrame:
    flags = ("in_base", "in_current", "in_latest")
    if baseline is None:
        pairs = presence.withColumnRenamed("in_historical", "in_base").select(*PAIR, *flags)
    else:
        off, on = F.lit(False), F.lit(True)
        base = baseline.filter(F.col("bene_id").isNotNull() & F.col("hcc_v28").isNotNull())
        pairs = (
            presence.select(*PAIR, off.alias("in_base"), "in_current", "in_latest")
            .unionByName(base.select(*PAIR, on.alias("in_base"), off.alias("in_current"), off.alias("in_latest")))
            .groupBy(*PAIR)
            .agg(*[F.max(c).alias(c) for c in flags])
        )
    # One row per category here, so a member's window stays small whatever its event count.
    has_base = F.max("in_base").over(Window.partitionBy("bene_id"))
    gap_type = F.when(F.col("in_current"), schemas.EMERGING).otherwise(schemas.RECAPTURE)
    seen_latest = F.col("in_current") if latest_is_current else F.col("in_latest")
    return (
        pairs.withColumn("_has_base", has_base)
        .filter("_has_base AND in_base <> in_current")
        .select(
            *PAIR,
            gap_type.alias("gap_type"),
            F.lit(schemas.PENDING).alias("status"),
            text.latest_context(gap_type, seen_latest).alias("latest_context"),
        )
    )


def members_without_hcc(members: DataFrame, timeline: DataFrame) -> DataFrame:
    return members.select("bene_id").join(diagnoses(timeline).select("bene_id"), "bene_id", "left_anti")


def members_in_any_period(timeline: DataFrame, periods: Periods) -> DataFrame:
    return pair_presence(timeline, periods).select("bene_id").distinct()
