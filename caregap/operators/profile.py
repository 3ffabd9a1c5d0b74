"""Member-category profile and its distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.functions import clean
from caregap.operators import lookup, ranking
from caregap.operators.evidence import joined_set

KEY = ["member_id", "hcc_v28"]


def member_diagnoses(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Diagnosis rows with category and payment flag (``No`` where there is no category)."""
    rows = lookup.with_hcc(
        events.select(F.col("bene_id").alias("member_id"), "diagnosis_code", "event_date", "is_principal"),
        mapping,
        extra=("payment_2026",),
    )
    pays = clean.yes_no(F.col("payment_2026").cast("string"))
    return rows.select(
        "member_id", "diagnosis_code", "hcc_v28", F.when(F.col("hcc_v28").isNotNull(), pays).otherwise("No")
        .alias("payment_2026"), F.col("event_date").alias("diagnosis_date"), "is_principal",
    )


def hcc_profile(rows: DataFrame) -> DataFrame:
    """Rows, code set, first and last date and payment flag per member and category."""
    return rows.filter(F.col("hcc_v28").isNotNull()).groupBy(*KEY).agg(
        F.count("*").alias("supporting_diagnosis_count"),
        joined_set("diagnosis_code").alias("unique_diagnosis_codes"),
        F.min("diagnosis_date").alias("first_diagnosis_date"),
        F.max("diagnosis_date").alias("last_diagnosis_date"),
        F.when(F.max(F.col("payment_2026") == "Yes"), "Yes").otherwise("No").alias("payment_2026"),
    )


def unmapped_codes(rows: DataFrame) -> DataFrame:
    return (
        rows.filter(F.col("hcc_v28").isNull())
        .groupBy("diagnosis_code")
        .agg(F.count("*").alias("occurrence_count"))
        .orderBy(F.desc("occurrence_count"), "diagnosis_code")
    )


def hcc_distribution(rows: DataFrame) -> DataFrame:
    """Members, rows and code set per category.

    Aggregates straight from the rows: the member count is a true distinct count
    and the code set is bounded by the crosswalk, so a universal category is safe.
    """
    return rows.filter(F.col("hcc_v28").isNotNull()).groupBy("hcc_v28").agg(
        F.count_distinct("member_id").alias("member_count"),
        F.count("*").alias("total_diagnosis_occurrences"),
        joined_set("diagnosis_code").alias("unique_supporting_diagnosis_codes"),
        F.when(F.max(F.col("payment_2026") == "Yes"), "Yes").otherwise("No").alias("payment_2026"),
    )


def _code_counts(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("hcc_v28").isNotNull()).groupBy("hcc_v28", "diagnosis_code").agg(
        F.count("*").alias("n")
    )


def code_frequencies(rows: DataFrame) -> DataFrame:
    """``code:count`` list per category, most frequent first (one item per crosswalk code)."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("diagnosis_code").alias("code"))))
    text = F.transform(items, lambda x: F.concat(x["code"], F.lit(":"), (-x["k"]).cast("string")))
    members = rows.filter(F.col("hcc_v28").isNotNull()).groupBy("hcc_v28").agg(
        F.count_distinct("member_id").alias("number_of_members"), F.count("*").alias("total_occurrences")
    )
    listed = _code_counts(rows).groupBy("hcc_v28").agg(F.concat_ws("|", text).alias("supporting_diagnosis_codes"))
    return members.join(listed, "hcc_v28")


def top_codes(rows: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent codes per category."""
    return ranking.top_k_per_group(_code_counts(rows), ["hcc_v28"], [F.desc("n"), F.col("diagnosis_code")], k)


def member_code_counts(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """Distinct codes, rows and categories of sampled members."""
    stats = rows.join(sample.select("member_id"), "member_id", "left_semi").groupBy("member_id").agg(
        F.count_distinct("diagnosis_code").alias("unique_diagnosis_codes"),
        F.count("*").alias("diagnosis_occurrences"),
        F.size(F.collect_set("hcc_v28")).cast("bigint").alias("mapped_hcc_count"),
        joined_set("hcc_v28").alias("mapped_hcc_categories"),
    )
    return sample.select("member_id").join(stats, "member_id", "left").na.fill(
        0, ["unique_diagnosis_codes", "diagnosis_occurrences", "mapped_hcc_count"]
    ).na.fill("", ["mapped_hcc_categories"])


def member_trace(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """Every code of sampled members with its category and count."""
    return (
        rows.join(sample.select("member_id"), "member_id", "left_semi")
        .groupBy("member_id", "diagnosis_code", F.coalesce("hcc_v28", F.lit("(unmapped)")).alias("hcc_v28"))
        .agg(F.count("*").alias("occurrences"))
    )


def quality(rows: DataFrame) -> DataFrame:
    """Mapped and unmapped row shares, unique codes and categories, members with and without a category."""
    mapped = F.col("hcc_v28").isNotNull()
    return rows.agg(
        F.count("*").alias("total_rows"),
        F.count_if(mapped).alias("mapped_rows"),
        F.count_if(~mapped).alias("unmapped_rows"),
        F.count_distinct("diagnosis_code").alias("unique_codes"),
        F.count_distinct("hcc_v28").alias("unique_hccs"),
        F.count_distinct("member_id").alias("members"),
        F.count_distinct(F.when(mapped, F.col("member_id"))).alias("members_with_hcc"),
    ).select(
        "*",
        (F.col("members") - F.col("members_with_hcc")).alias("members_without_hcc"),
        F.round(clean.percent(F.col("mapped_rows"), F.col("total_rows")), 4).alias("pct_mapped"),
        F.round(clean.percent(F.col("unmapped_rows"), F.col("total_rows")), 4).alias("pct_unmapped"),
    )


def enrollment(members: DataFrame) -> DataFrame:
    """Members per enrollment year plus the multi-year totals."""
    years = F.split("enrollment_years", r"\|")
    per_year = members.select(F.explode(years).alias("measure")).groupBy("measure").agg(F.count("*").alias("members"))
    n = F.size(years)
    totals = members.agg(F.count_if(n > 1).alias("a"), F.count_if(n == 3).alias("b")).select(
        F.explode(
            F.array(
                F.struct(F.lit("in_2_or_more_years").alias("measure"), F.col("a").alias("members")),
                F.struct(F.lit("in_all_3_years").alias("measure"), F.col("b").alias("members")),
            )
        ).alias("r")
    )
    return per_year.unionByName(totals.select("r.measure", "r.members"))
