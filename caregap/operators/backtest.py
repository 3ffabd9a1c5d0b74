"""Retrospective validation on shifted windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.functions import clean, scores
from caregap.operators import evidence, gaps, intervals, lookup, ranking
from caregap.operators.evidence import joined_set
from caregap.operators.gaps import PAIR
from caregap.operators.quality import side_by_side
from caregap.schemas import EMERGING, RECAPTURE, TIERS, Periods


def _pair_table(timeline: DataFrame, periods: Periods, as_of: int | None = None) -> DataFrame:
    """Presence flags, current evidence and years seen per pair, in one pass.

    ``as_of=None`` counts years over the whole timeline, which is the established
    rule although it lets later years leak into the score; a year cuts it there.
    """
    day = F.col("event_date")
    hist = clean.in_years(day, periods.historical)
    curr = clean.in_years(day, [periods.current])
    val = clean.in_years(day, [periods.latest])
    year = F.year(day) if as_of is None else F.when(F.year(day) <= as_of, F.year(day))
    return gaps.diagnoses(timeline).groupBy(*PAIR).agg(
        F.max(hist).alias("in_historical"),
        F.max(curr).alias("in_current"),
        F.max(val).alias("in_validation"),
        F.count_if(curr).alias("evidence_count"),
        F.max(F.when(curr, day)).alias("_last"),
        joined_set(F.when(curr, F.col("source"))).alias("sources"),
        F.min(year).alias("_first_year"),
        F.max(year).alias("_last_year"),
    )


def presence(timeline: DataFrame, periods: Periods) -> DataFrame:
    return gaps.pair_presence(timeline, periods).withColumnRenamed("in_latest", "in_validation")


def _persistence():
    """At least two distinct years: the first and the last one differ."""
    return F.when(F.col("_first_year") < F.col("_last_year"), 1.0).otherwise(0.5)


def emerging(timeline: DataFrame, periods: Periods, as_of: int | None = None) -> DataFrame:
    pairs = _pair_table(timeline, periods, as_of).filter("in_current AND NOT in_historical")
    recency = scores.half_year_recency(F.col("_last"), periods.current, (1.0, 0.7, 0.3))
    score = scores.blend(recency, scores.saturate(F.col("evidence_count"), 5), _persistence(), F.lit(0.5))
    return pairs.select(*PAIR, "evidence_count", score.alias("priority_score"), F.col("in_validation").alias("confirmed"), "sources")


def recapture(timeline: DataFrame, periods: Periods, as_of: int | None = None) -> DataFrame:
    pairs = _pair_table(timeline, periods, as_of).filter("in_historical AND NOT in_current")
    score = scores.blend(F.lit(0.7), F.lit(0.5), _persistence(), F.lit(0.5))
    return pairs.select(*PAIR, score.alias("priority_score"), F.col("in_validation").alias("confirmed"))


def emerging_metrics(flags: DataFrame) -> DataFrame:
    """Precision, recall and F1 of emerging gaps against the validation year; zero where undefined."""
    hist, curr, val = F.col("in_historical"), F.col("in_current"), F.col("in_validation")
    flagged, new = curr & ~hist, val & ~hist
    counts = flags.agg(
        F.count_if(flagged).alias("flagged"),
        F.count_if(flagged & val).alias("confirmed"),
        F.count_if(new).alias("new_in_validation"),
        F.count_if(new & flagged).alias("caught"),
    )
    precision = F.coalesce(F.try_divide("confirmed", "flagged"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("caught", "new_in_validation"), F.lit(0.0))
    p, r = F.col("_p"), F.col("_r")
    return counts.withColumns({"_p": precision, "_r": recall}).select(
        "flagged", "confirmed", "new_in_validation", "caught",
        F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"),
    )


def recapture_rate(flags: DataFrame) -> DataFrame:
    flagged = F.col("in_historical") & ~F.col("in_current")
    counts = flags.agg(F.count_if(flagged).alias("flagged"), F.count_if(flagged & F.col("in_validation")).alias("returned"))
    return counts.withColumn("recapture_rate", F.round(F.coalesce(F.try_divide("returned", "flagged"), F.lit(0.0)), 6))


def tier_calibration(suspects: DataFrame, label: str) -> DataFrame:
    """Size, confirmed and rate for each of the three tiers, present even when empty."""
    t = scores.tier(F.col("priority_score"))
    sums = suspects.agg(
        *[F.count_if(t == x).alias(f"n_{x}") for x in TIERS],
        *[F.count_if((t == x) & F.col("confirmed")).alias(f"c_{x}") for x in TIERS],
    )
    rows = F.array(
        *[F.struct(F.lit(x).alias("tier"), F.col(f"n_{x}").alias("suspects"), F.col(f"c_{x}").alias("confirmed")) for x in TIERS]
    )
    return sums.select(F.explode(rows).alias("r")).select(
        F.lit(label).alias("suspect_type"), "r.tier", "r.suspects", "r.confirmed",
        F.round(F.coalesce(F.try_divide("r.confirmed", "r.suspects"), F.lit(0.0)), 6).alias("rate"),
    )


def top_confirmed(suspects: DataFrame, mapping: DataFrame, k: int = 10) -> DataFrame:
    per_hcc = suspects.groupBy("hcc_v28").agg(
        F.count_if("confirmed").alias("confirmed"), F.count("*").alias("flagged")
    ).filter("confirmed > 0")
    best = ranking.top_k(per_hcc, [F.desc("confirmed"), clean.hcc_order(F.col("hcc_v28"))], k)
    return lookup.with_description(best, mapping).withColumn("rate", F.round(F.col("confirmed") / F.col("flagged"), 6))


def evidence_backtest(timeline: DataFrame, prescriptions: DataFrame, periods: Periods) -> DataFrame:
    """Eight-signal back-test: scored emerging pairs plus recapture pairs with constant zero.

    One pass gives presence flags and current-year features per pair; the fills
    are matched on day arrays, so the events are not read again.
    """
    day = F.col("event_date")
    current = clean.in_years(day, [periods.current])
    pairs = evidence.with_day_counts(
        gaps.diagnoses(timeline)
        .filter(clean.in_years(day, periods.loaded_years))
        .withColumn("source", F.upper("source"))
        .groupBy(*PAIR)
        .agg(
            F.max(clean.in_years(day, periods.historical)).alias("in_historical"),
            F.max(current).alias("in_current"),
            F.max(clean.in_years(day, [periods.latest])).alias("in_validation"),
            *evidence.feature_columns(current, blanks_count=True),
        )
    ).filter("in_current <> in_historical")
    fills = intervals.member_fill_days(prescriptions.filter(current))
    rows = pairs.join(fills, "bene_id", "left").withColumn(
        "prescription_support_count",
        intervals.fill_rows(intervals.near_fill_days(F.col("evidence_days"), F.col("fill_days"))),
    )
    score = F.round(scores.weighted_sum(scores.component_scores(periods.reference_date), scores.BACKTEST_ORDER), 4)
    up = F.col("in_current")
    return rows.withColumn("priority_score", F.when(up, score).otherwise(0.0)).select(
        *PAIR,
        F.when(up, EMERGING).otherwise(RECAPTURE).alias("suspect_type"),
        "priority_score",
        scores.tier(F.col("priority_score")).alias("priority"),
        "diagnosis_count", "distinct_evidence_dates", "distinct_evidence_months", "distinct_sources",
        "principal_diagnosis_count",
        F.col("in_validation").alias("confirmed"),
    )


def reconcile(profile_rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Member counts per category from the profile against the raw rows."""
    raw = profile_rows.filter(F.col("hcc_v28").isNotNull()).groupBy("hcc_v28").agg(
        F.count_distinct("member_id").alias("raw_members")
    )
    stored = profile.groupBy("hcc_v28").agg(F.count("*").alias("profile_members"))
    return stored.join(raw, "hcc_v28", "full_outer").na.fill(0, ["raw_members", "profile_members"]).withColumn(
        "matches", F.when(F.col("raw_members") == F.col("profile_members"), "YES").otherwise("MISMATCH")
    )


def join_integrity(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows before and after the code lookup, rows found, rows with a category, distinct code-category pairs."""
    before = events.agg(F.count("*").alias("rows_before"))
    hcc = F.col("hcc_v28")
    after = lookup.with_hcc(events, mapping).agg(
        F.count("*").alias("rows_after"),
        F.count_if("in_crosswalk").alias("rows_code_found"),
        F.count_if(hcc.isNotNull()).alias("rows_with_hcc"),
        F.count_distinct("diagnosis_code").alias("unique_codes"),
        F.count_distinct(F.when(hcc.isNotNull(), F.struct("diagnosis_code", "hcc_v28"))).alias("unique_code_hcc_pairs"),
    )
    return side_by_side(before, after).withColumn("fan_out", F.col("rows_after") - F.col("rows_before"))
