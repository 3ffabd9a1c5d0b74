"""Date-window joins between evidence days and prescription fills.

Both sides are reduced to days before they meet, so the join grows with days
per member and not with events: a member with a third of all fills still has at
most one row per day (and per set of equal fill dates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregap.session import materialize

WINDOW_DAYS = 30


def interval_join(
    left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, days: int = WINDOW_DAYS
) -> DataFrame:
    """Inner join on ``key`` with ``|left_date - right_date| <= days``; every match appears once.

    The right side gets the bucket its date falls in, the left side is repeated
    for the one or two buckets its window touches, and the join runs on (key,
    bucket). That also spreads the days of one hot key over many tasks.
    """
    width = F.lit(4 * days)

    def bucket(day):
        return F.floor(day / width)

    left_day, right_day = F.unix_date(F.col(left_date)), F.unix_date(F.col(right_date))
    spread = left.withColumn(
        "_bucket", F.explode(F.sequence(bucket(left_day - days), bucket(left_day + days)))
    )
    placed = right.withColumn("_bucket", bucket(right_day))
    return (
        spread.join(placed, [key, "_bucket"])
        .filter(F.abs(F.datediff(F.col(left_date), F.col(right_date))) <= days)
        .drop("_bucket")
    )


def _fill_days(prescriptions: DataFrame) -> DataFrame:
    return prescriptions.filter(F.col("event_date").isNotNull()).select(
        "bene_id", "event_id", F.col("event_date").alias("rx_date"), "drug_code"
    )


def pairs_with_prescription(evidence_days: DataFrame, prescriptions: DataFrame, keys=("bene_id", "hcc_v28")) -> DataFrame:
    """Distinct pairs with any fill inside the window of any evidence day."""
    fills = _fill_days(prescriptions).select("bene_id", "rx_date").distinct()
    return interval_join(evidence_days, fills, "bene_id", "event_date", "rx_date").select(*keys).distinct()


def prescription_row_counts(evidence_days: DataFrame, prescriptions: DataFrame, keys=("bene_id", "hcc_v28")) -> DataFrame:
    """Number of fill rows (not deduplicated) inside the window of any evidence day."""
    per_day = _fill_days(prescriptions).groupBy("bene_id", "rx_date").agg(F.count("*").alias("_rows"))
    hits = interval_join(evidence_days, per_day, "bene_id", "event_date", "rx_date")
    return (
        hits.select(*keys, "rx_date", "_rows")
        .distinct()
        .groupBy(*keys)
        .agg(F.sum("_rows").alias("rx_support_count"))
    )


def _fill_groups(prescriptions: DataFrame) -> DataFrame:
    """Fill ids counted per member and sorted set of dates they occur on.

    An id normally has one date; grouping by the date set keeps ids that were
    recorded on several dates countable exactly once.
    """
    per_id = (
        _fill_days(prescriptions)
        .groupBy("bene_id", "event_id")
        .agg(F.array_sort(F.collect_set("rx_date")).alias("rx_dates"))
    )
    return per_id.groupBy("bene_id", "rx_dates").agg(F.count("*").alias("_ids"))


def prescription_hits(evidence_days: DataFrame, prescriptions: DataFrame, keys=("bene_id", "hcc_v28")) -> DataFrame:
    """Distinct (pair, date set) matches with the number of distinct fill ids behind each."""
    days = _fill_groups(prescriptions).withColumn("rx_date", F.explode("rx_dates"))
    return (
        interval_join(evidence_days, days, "bene_id", "event_date", "rx_date")
        .select(*keys, "rx_dates", "_ids")
        .distinct()
    )


def prescription_support(evidence_days: DataFrame, prescriptions: DataFrame, keys=("bene_id", "hcc_v28")) -> DataFrame:
    """Distinct fill ids inside the window of any evidence day, per pair."""
    return (
        prescription_hits(evidence_days, prescriptions, keys)
        .groupBy(*keys)
        .agg(F.sum("_ids").alias("prescription_support_count"))
    )


def support_and_drugs(evidence_days: DataFrame, prescriptions: DataFrame, keys=("bene_id", "hcc_v28")) -> DataFrame:
    """Support count and drug codes of each pair from one interval join: its matched days are stored and read twice."""
    fills = _fill_days(prescriptions)
    on_days = interval_join(evidence_days, fills.select("bene_id", "rx_date").distinct(), "bene_id", "event_date", "rx_date")
    days = materialize(on_days.select(*keys, "rx_date").distinct())
    groups = _fill_groups(prescriptions).withColumn("rx_date", F.explode("rx_dates"))
    counts = (
        days.join(groups, ["bene_id", "rx_date"]).select(*keys, "rx_dates", "_ids").distinct()
        .groupBy(*keys).agg(F.sum("_ids").alias("prescription_support_count"))
    )
    drugs = days.join(fills.select("bene_id", "rx_date", "drug_code").distinct(), ["bene_id", "rx_date"]).groupBy(*keys).agg(
        F.array_sort(F.collect_set("drug_code")).alias("prescription_drug_codes")
    )
    return counts.join(drugs, list(keys))


def prescription_drugs(evidence_days: DataFrame, prescriptions: DataFrame, keys=("bene_id", "hcc_v28")) -> DataFrame:
    """Sorted distinct drug codes of the matching fill rows (bounded by the drug vocabulary)."""
    drugs = _fill_days(prescriptions).select("bene_id", "rx_date", "drug_code").distinct()
    days = interval_join(
        evidence_days, drugs.select("bene_id", "rx_date").distinct(), "bene_id", "event_date", "rx_date"
    )
    return (
        days.select(*keys, "rx_date")
        .distinct()
        .join(drugs, ["bene_id", "rx_date"])
        .select(*keys, "drug_code")
        .distinct()
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("drug_code")).alias("prescription_drug_codes"))
    )


# --- the same test on day arrays --------------------------------------------------


def member_fill_days(prescriptions: DataFrame) -> DataFrame:
    """Per member the days with fills and the fill rows on each (at most one entry per calendar day)."""
    per_day = _fill_days(prescriptions).groupBy("bene_id", "rx_date").agg(F.count("*").alias("n"))
    return per_day.groupBy("bene_id").agg(F.collect_list(F.struct("rx_date", "n")).alias("fill_days"))


def near_fill_days(evidence_days: Column, fill_days: Column, days: int = WINDOW_DAYS) -> Column:
    """Entries of ``fill_days`` inside the window of any day in ``evidence_days``.

    Where evidence is already one row per pair with its (bounded) set of days,
    this compares the two arrays in place and needs no exploding join.
    """
    return F.filter(
        F.coalesce(fill_days, F.array().cast("array<struct<rx_date: date, n: bigint>>")),
        lambda fill: F.exists(evidence_days, lambda day: F.abs(F.datediff(day, fill["rx_date"])) <= days),
    )


def fill_rows(fills: Column) -> Column:
    return F.aggregate(fills, F.lit(0).cast("bigint"), lambda total, fill: total + fill["n"])
