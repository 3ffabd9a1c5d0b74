"""Integrity checks and quality reports as small tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.functions import clean, scores
from caregap.operators import gaps, lookup, ranking
from caregap.schemas import EMERGING, RECAPTURE, TIERS, Periods
from caregap.session import materialize


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row frames as one row: stacked with nulls, then folded by ``max`` (no cross join)."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack([df.agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(n)) for n, df in tables.items()])


def null_keys(keys: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    return _stack(
        [
            df.agg(F.count_if(F.col(k).isNull()).alias("null_keys")).withColumn("table_name", F.lit(n))
            for n, (df, k) in keys.items()
        ]
    )


def duplicate_keys(keys: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Number of key values that occur more than once, per table."""
    return _stack(
        [
            df.groupBy(k).count().filter("count > 1").agg(F.count("*").alias("duplicate_keys"))
            .withColumn("table_name", F.lit(n))
            for n, (df, k) in keys.items()
        ]
    )


def orphan_counts(tables: dict[str, DataFrame], members: DataFrame) -> DataFrame:
    return _stack(
        [
            lookup.orphans(df, members).agg(F.count("*").alias("orphans")).withColumn("table_name", F.lit(n))
            for n, df in tables.items()
        ]
    )


def mapping_coverage(mapping: DataFrame) -> DataFrame:
    return mapping.agg(
        F.count("*").alias("total_codes"),
        F.count_if(F.col("hcc_v28").isNotNull() & (F.col("hcc_v28") != "")).alias("mapped_codes"),
        F.count_if("payment_2026").alias("payment_codes"),
    )


def overall(tables: dict[str, DataFrame], keys: dict[str, tuple[DataFrame, str]], unique: dict[str, tuple[DataFrame, str]],
            members: DataFrame, dependents: dict[str, DataFrame]) -> DataFrame:
    """One row per check with its value and verdict, and the verdict over all of them."""
    checks = [
        row_counts({"members": tables["members"]}).select(F.lit("members_not_empty").alias("check_name"),
                                                          F.col("row_count").alias("value"),
                                                          (F.col("row_count") > 0).alias("passed")),
        null_keys(keys).agg(F.sum("null_keys").alias("value")).select(
            F.lit("null_keys").alias("check_name"), "value", (F.col("value") == 0).alias("passed")),
        duplicate_keys(unique).agg(F.sum("duplicate_keys").alias("value")).select(
            F.lit("duplicate_keys").alias("check_name"), "value", (F.col("value") == 0).alias("passed")),
        orphan_counts(dependents, members).agg(F.sum("orphans").alias("value")).select(
            F.lit("orphans").alias("check_name"), "value", (F.col("value") == 0).alias("passed")),
    ]
    each = materialize(_stack(checks))
    total = each.agg(F.count_if(~F.col("passed")).alias("value"), F.bool_and("passed").alias("passed")).select(
        F.lit("overall").alias("check_name"), "value", "passed"
    )
    return each.unionByName(total)


def candidate_quality(timeline: DataFrame, candidates: DataFrame, periods: Periods) -> DataFrame:
    """Row counts per period, pair counts per period and candidate support of the v0 rule."""
    dx = timeline.filter(F.lower("event_type") == "diagnosis").withColumn(
        "period", clean.period_of(F.col("event_date"), Periods(periods.historical, periods.current))
    )
    rows = dx.agg(
        F.count_distinct("bene_id").alias("members_analyzed"),
        F.count_if(F.col("period") == "historical").alias("historical_rows"),
        F.count_if(F.col("period") == "current").alias("current_rows"),
        F.count_if(F.col("period") == "other").alias("other_rows"),
    )
    pairs = gaps.pair_presence(timeline, periods).agg(
        F.count_if("in_historical").alias("historical_pairs"), F.count_if("in_current").alias("current_pairs")
    )
    found = candidates.agg(
        F.count("*").alias("candidates"),
        F.count_distinct("bene_id").alias("members_with_candidates"),
        F.count_if(F.col("evidence_count") >= 2).alias("multi_support"),
    )
    return side_by_side(rows, pairs, found)


def suspect_quality(members: DataFrame, baseline: DataFrame, suspects: DataFrame) -> DataFrame:
    t = scores.tier(F.col("priority_score"))
    s = suspects.agg(
        F.count("*").alias("suspects"),
        F.count_if(F.col("suspect_type") == EMERGING).alias("emerging"),
        F.count_if(F.col("suspect_type") == RECAPTURE).alias("recapture"),
        *[F.count_if(t == x).alias(x.lower()) for x in TIERS],
    )
    b = baseline.agg(F.count("*").alias("baseline_records"), F.count_distinct("bene_id").alias("members_with_baseline"))
    row = side_by_side(members.agg(F.count("*").alias("members")), b, s)
    return row.withColumns(
        {f"{x.lower()}_pct": F.round(clean.percent(F.col(x.lower()), F.col("suspects")), 4) for x in TIERS}
    )


def top_hccs_per_type(suspects: DataFrame, k: int = 10) -> DataFrame:
    counts = suspects.groupBy("suspect_type", "hcc_v28").agg(F.count("*").alias("candidates"))
    order = [F.desc("candidates"), clean.hcc_order(F.col("hcc_v28"))]
    return ranking.top_k_per_group(counts, ["suspect_type"], order, k)


def table_profile(df: DataFrame, member: str = "bene_id") -> DataFrame:
    """Type, null count and row count per column, with the distinct members of the table."""
    counted = df.agg(
        F.count("*").alias("_rows"), F.count_distinct(member).alias("_members"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n_{i}") for i, c in enumerate(df.columns)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(f"_n_{i}").alias("null_count"))
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return counted.select(F.explode(rows).alias("r"), "_rows", "_members").select(
        "r.*", F.col("_rows").alias("row_count"), F.col("_members").alias("distinct_members")
    )
