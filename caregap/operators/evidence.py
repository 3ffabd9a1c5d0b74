"""Evidence behind gaps: profiles, features, scores, references and the three suspect tables.

Lists whose length has a bound (codes of a category, sources, drug codes, days)
are arrays on the pair row. Lists without a bound (claim ids, event references)
are tables of their own in every size: one row per item with its position inside
the pair, while the pair row carries counts. ``nested`` builds full arrays for
groups that are known to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caregap import schemas
from caregap.functions import clean, scores, text
from caregap.operators import gaps, intervals, lookup, ranking
from caregap.operators import timeline as timeline_ops
from caregap.operators.gaps import PAIR
from caregap.schemas import EMERGING, RECAPTURE, Periods
from caregap.session import materialize

GAP = [*PAIR, "gap_type"]


def joined_set(c: Column | str) -> Column:
    """Sorted distinct values as pipe-delimited text; for bounded vocabularies only."""
    return F.concat_ws("|", F.array_sort(F.collect_set(c)))


def distinct_small(c: Column) -> Column:
    """Distinct count for columns with few values per group (days, months, sources, years)."""
    return F.size(F.collect_set(c)).cast("bigint")


def numbered(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add ``position`` 1, 2, ... inside each key, without bringing a key's rows into one task.

    Positions are those of one global order minus the first of the key; ``order``
    must be total inside a key.
    """
    ranked = ranking.global_rank(items, [*[F.col(k) for k in keys], *order], "_rank")
    first = ranked.groupBy(*keys).agg(F.min("_rank").alias("_first"))
    return ranked.join(first, keys).withColumn("position", F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first")


def nested(items: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """All distinct values of each key as one sorted array; for keys that are known to have few."""
    return items.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(name))


# --- profiles ---------------------------------------------------------------


def baseline_profile(timeline: DataFrame, mapping: DataFrame, periods: Periods) -> DataFrame:
    """Historical profile per pair: codes, distinct claims, first and last date, sources."""
    events = gaps.diagnoses(timeline).filter(clean.in_years(F.col("event_date"), periods.historical))
    profile = events.groupBy(*PAIR).agg(
        joined_set("code").alias("baseline_diagnosis_codes"),
        F.count_distinct(F.nullif("claim_id", F.lit(""))).alias("baseline_claim_count"),
        F.min("event_date").alias("first_baseline_date"),
        F.max("event_date").alias("last_baseline_date"),
        joined_set(F.nullif("source", F.lit(""))).alias("sources"),
    )
    return lookup.with_description(profile, mapping).select(*schemas.MEMBER_HCC_BASELINE.fieldNames())


def candidates_v0(timeline: DataFrame, periods: Periods) -> DataFrame:
    """Current-year evidence of pairs that are absent from the historical window.

    One pass: the historical rows only set a flag, the current rows are counted.
    """
    day = F.col("event_date")
    current = clean.in_years(day, [periods.current])
    events = gaps.diagnoses(timeline).filter(clean.in_years(day, (*periods.historical, periods.current)))
    return (
        events.groupBy(*PAIR)
        .agg(
            F.max(~current).alias("_historical"),
            joined_set(F.when(current, F.col("code"))).alias("supporting_diagnosis_codes"),
            F.count_if(current).alias("evidence_count"),
            F.min(F.when(current, day)).alias("first_evidence_date"),
            F.max(F.when(current, day)).alias("last_evidence_date"),
        )
        .filter(~F.col("_historical"))
        .drop("_historical")
        .withColumn("status", F.lit(schemas.PENDING))
    )


def claim_lists(timeline: DataFrame, candidates: DataFrame, periods: Periods) -> DataFrame:
    """Current-year claim ids behind v0 candidates: one row per pair and claim, with its position."""
    events = gaps.diagnoses(timeline).filter(
        clean.in_years(F.col("event_date"), [periods.current]) & (F.coalesce("claim_id", F.lit("")) != "")
    )
    claims = events.join(candidates.select(*PAIR), PAIR, "left_semi").select(*PAIR, "claim_id").distinct()
    return numbered(claims, PAIR, [F.col("claim_id")])


def period_evidence(timeline: DataFrame, periods: Periods) -> DataFrame:
    """Historical and current evidence of every pair in one pass."""
    day = F.col("event_date")
    hist, curr = clean.in_years(day, periods.historical), clean.in_years(day, [periods.current])
    return (
        gaps.diagnoses(timeline)
        .filter(clean.in_years(day, (*periods.historical, periods.current)))
        .groupBy(*PAIR)
        .agg(
            F.count_if(hist).alias("historical_count"),
            F.count_if(curr).alias("current_count"),
            joined_set(F.when(curr, F.col("code"))).alias("current_codes"),
            F.min(F.when(curr, day)).alias("current_first_date"),
            F.max(F.when(curr, day)).alias("current_last_date"),
        )
    )


def years_seen(timeline: DataFrame) -> DataFrame:
    """Distinct years per pair over the whole timeline."""
    return gaps.diagnoses(timeline).groupBy(*PAIR).agg(distinct_small(F.year("event_date")).alias("years_seen"))


# --- four-signal suspects (v1) ------------------------------------------------


def suspects_v1(
    timeline: DataFrame, prescriptions: DataFrame, members: DataFrame, mapping: DataFrame, periods: Periods
) -> DataFrame:
    """Both gap directions with recency, frequency, persistence and diversity scores.

    A gap pair has evidence in exactly one of the two windows, so one aggregate
    over both windows already is the evidence of the right one.
    """
    day = F.col("event_date")
    hist, curr = clean.in_years(day, periods.historical), clean.in_years(day, [periods.current])
    used = hist | curr
    pairs = (
        gaps.diagnoses(timeline)
        .groupBy(*PAIR)
        .agg(
            F.max(hist).alias("_hist"),
            F.max(curr).alias("_curr"),
            joined_set(F.when(used, F.col("code"))).alias("supporting_diagnosis_codes"),
            F.count_if(used).alias("evidence_count"),
            F.min(F.when(used, day)).alias("first_evidence_date"),
            F.max(F.when(used, day)).alias("last_evidence_date"),
            joined_set(F.when(used, F.nullif("source", F.lit("")))).alias("sources"),
            F.year(F.min(day)).alias("_first_year"),
            F.year(F.max(day)).alias("_last_year"),
            F.collect_set(F.when(curr, day)).alias("_days"),
        )
        .filter("_hist <> _curr")
        .join(members.select("bene_id"), "bene_id", "left_semi")
    )
    emerging = F.col("_curr")
    current_rx = prescriptions.filter(clean.in_years(day, [periods.current]))
    near = intervals.near_fill_days(F.col("_days"), F.col("fill_days"))
    scored = pairs.join(intervals.member_fill_days(current_rx), "bene_id", "left").withColumns(
        {
            "suspect_type": F.when(emerging, EMERGING).otherwise(RECAPTURE),
            "has_prescription_support": emerging & (F.size(near) > 0),
            "recency_score": F.when(
                emerging, scores.half_year_recency(F.col("last_evidence_date"), periods.current, (1.0, 0.7, 0.3))
            ).otherwise(
                scores.half_year_recency(F.col("last_evidence_date"), max(periods.historical), (0.8, 0.6, 0.4))
            ),
            "frequency_score": scores.saturate(F.col("evidence_count"), 5),
            # At least two distinct years: the first and the last one differ.
            "persistence_score": F.when(F.col("_first_year") < F.col("_last_year"), 1.0).otherwise(0.5),
        }
    )
    scored = scored.withColumn("diversity_score", F.when(F.col("has_prescription_support"), 1.0).otherwise(0.5))
    scored = scored.withColumn(
        "priority_score",
        scores.blend(*[F.col(f"{s}_score") for s in ("recency", "frequency", "persistence", "diversity")]),
    )
    return lookup.with_description(scored, mapping).select(
        *PAIR, "hcc_description", "suspect_type", "supporting_diagnosis_codes", "evidence_count",
        "first_evidence_date", "last_evidence_date", "sources", "has_prescription_support", "recency_score",
        "frequency_score", "persistence_score", "diversity_score", "priority_score",
        F.lit(schemas.PENDING).alias("status"),
    )


def suspect_claims(timeline: DataFrame, suspects: DataFrame, periods: Periods) -> DataFrame:
    """Claim ids behind v1 suspects, all of them: one row per suspect and claim."""
    day = F.col("event_date")
    events = gaps.diagnoses(timeline).filter(
        clean.in_years(day, (*periods.historical, periods.current)) & (F.coalesce("claim_id", F.lit("")) != "")
    )
    return events.select(*PAIR, "claim_id").distinct().join(suspects.select(*PAIR), PAIR, "left_semi")


def claim_samples(timeline: DataFrame, suspects: DataFrame, periods: Periods, size: int) -> DataFrame:
    """The first ``size`` sorted claim ids of each suspect as text, for the flat v1 layout."""
    first = ranking.top_k_per_group(suspect_claims(timeline, suspects, periods), PAIR, [F.col("claim_id")], size, "_n")
    return first.groupBy(*PAIR).agg(joined_set("claim_id").alias("supporting_claim_ids"))


def suspect_rows_v1(suspects: DataFrame, samples: DataFrame) -> DataFrame:
    """Output layout with sequential ids and fixed-decimal score text."""
    def fixed(c: str, digits: int) -> Column:
        return clean.fixed_decimals(F.col(c), digits).alias(c)

    rows = ranking.sequence_suspects(suspects.join(samples, PAIR, "left"))
    return rows.select(
        "suspect_id", *PAIR, "hcc_description", "suspect_type", "supporting_diagnosis_codes",
        F.coalesce("supporting_claim_ids", F.lit("")).alias("supporting_claim_ids"), "evidence_count",
        "first_evidence_date", "last_evidence_date", "sources",
        F.when(F.col("has_prescription_support"), "True").otherwise("False").alias("has_prescription_support"),
        *[fixed(f"{s}_score", 2) for s in ("recency", "frequency", "persistence", "diversity")],
        fixed("priority_score", 3), "status",
    )


# --- eight-signal suspects (v2) -------------------------------------------------


def deduplicate_events(events: DataFrame, *also: str) -> DataFrame:
    """One row per (member, date, category, claim, code, event); copies are merged before the shuffle.

    ``also`` names columns that follow from these.
    """
    return events.groupBy("bene_id", "event_date", "hcc_v28", "claim_id", "code", "event_id", *also).agg(
        F.min("source").alias("source"), F.max("is_principal").alias("is_principal")
    )


FEATURES = (
    "diagnosis_count", "unique_claim_count", "unique_event_count", "distinct_evidence_dates",
    "distinct_evidence_months", "distinct_sources", "principal_diagnosis_count",
)


def feature_columns(where: Column | None = None, blanks_count: bool = False) -> list[Column]:
    """Aggregates of the evidence features, over all rows or those that meet ``where``.

    Claims and events have no bound per key, so they are true distinct counts
    (spread by value before they are added up); days, months and sources are few.
    With ``blanks_count`` a missing value counts as one value.
    """
    def value(c: str) -> Column:
        column = F.coalesce(F.col(c), F.lit("")) if blanks_count else F.col(c)
        return column if where is None else F.when(where, column)

    counted = F.lit(True) if where is None else where
    day = F.when(counted, F.col("event_date"))
    return [
        F.count_if(counted).alias("diagnosis_count"),
        F.count_distinct(value("claim_id")).alias("unique_claim_count"),
        F.count_distinct(value("event_id")).alias("unique_event_count"),
        F.min(day).alias("first_evidence_date"),
        F.max(day).alias("last_evidence_date"),
        distinct_small(F.trunc(day, "MM")).alias("distinct_evidence_months"),
        distinct_small(value("source")).alias("distinct_sources"),
        F.count_if(counted & F.col("is_principal")).alias("principal_diagnosis_count"),
        F.array_sort(F.collect_set(value("code"))).alias("supporting_diagnosis_codes"),
        F.array_sort(F.collect_set(day)).alias("evidence_days"),
    ]


def with_day_counts(features: DataFrame) -> DataFrame:
    return features.withColumn("distinct_evidence_dates", F.size("evidence_days").cast("bigint"))


# A pair's rows meet as at most so many partial rows, by their claim.
SHARES = 64


def first_marks(events: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Mark one row of each distinct ``value`` per key, so that distinct counts become plain sums.

    Rows are dealt by key and value, so one key's rows spread over many tasks. The
    order takes in every column: equal runs of a task mark equal rows.
    """
    own = Window.partitionBy(*keys, value).orderBy(*[c for c in events.columns if c not in (*keys, value)])
    return events.withColumn(name, (F.row_number().over(own) == 1) & F.col(value).isNotNull())


def evidence_features(events: DataFrame, keys: list[str] = PAIR, blanks_count: bool = False) -> DataFrame:
    """The columns of ``feature_columns``, with every row in three shuffles whatever is counted.

    Several true distinct counts in one aggregation send each row once per count, twice.
    Rows are summed where their claim is counted, by key and share of the claims. What is
    left, at most ``SHARES`` rows of a key, is dealt by the first key alone, so that a
    member's pairs come out in one task and need no shuffle of their own.
    """
    if blanks_count:
        events = events.withColumns({c: F.coalesce(c, F.lit("")) for c in ("claim_id", "event_id", "source", "code")})
    rows = events.select(*keys, "event_date", "claim_id", "event_id", "source", "code", "is_principal")
    marked = first_marks(rows, keys, "event_id", "_new_event").drop("event_id")
    shared = [*keys, "_share"]
    marked = marked.withColumn("_share", F.pmod(F.xxhash64("claim_id"), F.lit(SHARES)).cast("int")).repartition(*shared)
    marked = first_marks(marked, shared, "claim_id", "_new_claim").drop("claim_id")
    parts = marked.groupBy(*shared).agg(
        F.count("*").alias("diagnosis_count"),
        F.count_if("_new_claim").alias("unique_claim_count"),
        F.count_if("_new_event").alias("unique_event_count"),
        F.count_if("is_principal").alias("principal_diagnosis_count"),
        *[F.collect_set(c).alias(c) for c in ("source", "code", "event_date")],
    )

    def union_of(c: str) -> Column:
        return F.array_distinct(F.flatten(F.collect_list(c)))

    counts = ("diagnosis_count", "unique_claim_count", "unique_event_count", "principal_diagnosis_count")
    grouped = parts.drop("_share").repartition(keys[0]).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in counts],
        F.size(union_of("source")).cast("bigint").alias("distinct_sources"),
        F.array_sort(union_of("code")).alias("supporting_diagnosis_codes"),
        F.array_sort(union_of("event_date")).alias("evidence_days"),
    )
    months = F.size(F.array_distinct(F.transform("evidence_days", lambda d: F.trunc(d, "MM")))).cast("bigint")
    grouped = grouped.withColumns({
        "first_evidence_date": F.array_min("evidence_days"), "last_evidence_date": F.array_max("evidence_days"),
        "distinct_evidence_months": months,
    })
    names = [
        "diagnosis_count", "unique_claim_count", "unique_event_count", "first_evidence_date", "last_evidence_date",
        "distinct_evidence_months", "distinct_sources", "principal_diagnosis_count", "supporting_diagnosis_codes", "evidence_days",
    ]
    return with_day_counts(grouped.select(*keys, *names))


def gap_events(timeline: DataFrame, found: DataFrame, periods: Periods) -> DataFrame:
    """Deduplicated evidence rows of each gap: current rows for emerging, historical rows for recapture."""
    day = F.col("event_date")
    events = gaps.diagnoses(timeline).filter(clean.in_years(day, (*periods.historical, periods.current)))
    side = F.when(clean.in_years(day, [periods.current]), EMERGING).otherwise(RECAPTURE)
    wanted = deduplicate_events(events).withColumn("gap_type", side)
    return wanted.join(found.select(*GAP), GAP, "left_semi")


def window_features(timeline: DataFrame, periods: Periods) -> DataFrame:
    """Features of every pair and window (as the gap side it would support) from one pass over the timeline.

    Also computes pairs that turn out to be no gap: that costs less than finding
    the gaps first and joining all events to them.
    """
    day = F.col("event_date")
    side = F.when(clean.in_years(day, [periods.current]), EMERGING).when(
        clean.in_years(day, periods.historical), RECAPTURE
    ).otherwise("LATEST")
    events = gaps.diagnoses(timeline).filter(clean.in_years(day, periods.loaded_years)).select(
        *PAIR, "event_date", "claim_id", "code", "event_id", "source", "is_principal"
    )
    # Copies of a row meet where its event is counted, so that both need one shuffle.
    dealt = events.withColumn("gap_type", side).repartition(*GAP, "event_id")
    return evidence_features(deduplicate_events(dealt, "gap_type"), GAP)


def period_features(timeline: DataFrame, periods: Periods) -> DataFrame:
    """``window_features``, stored for uses that read them more than once."""
    return materialize(window_features(timeline, periods))


def presence_from_features(features: DataFrame) -> DataFrame:
    def seen(side: str) -> Column:
        return F.max(F.col("gap_type") == side)

    return features.groupBy(*PAIR).agg(
        seen(RECAPTURE).alias("in_historical"), seen(EMERGING).alias("in_current"), seen("LATEST").alias("in_latest")
    )


def with_features(found: DataFrame, features: DataFrame) -> DataFrame:
    """Gaps with the features of their side; null where a gap has no evidence rows."""
    return found.join(features, GAP, "left")


def gaps_of_features(features: DataFrame, latest_is_current: bool = False) -> DataFrame:
    """Gaps against the historical pairs with the features of their side, where ``evidence_features`` put a member's pairs.

    The same rows as ``gaps.gaps_from_presence`` without a baseline and ``with_features``.
    A member has at most one row per category and window here, so windows over a
    member stay small. A row without a member has no features, as it meets none in a join.
    """
    pair, member = Window.partitionBy(*PAIR), Window.partitionBy("bene_id")
    side = F.col("gap_type")
    seen = {RECAPTURE: "in_base", EMERGING: "in_current", "LATEST": "in_latest"}
    rows = features.withColumn("_has_base", F.max(side == RECAPTURE).over(member))
    rows = rows.withColumns({flag: F.max(side == s).over(pair) for s, flag in seen.items()})
    wanted = F.when(F.col("in_current"), EMERGING).otherwise(RECAPTURE)
    seen_latest = F.col("in_current") if latest_is_current else F.col("in_latest")
    own = [F.when(F.col("bene_id").isNotNull(), F.col(c)).alias(c) for c in features.columns if c not in GAP]
    return rows.filter("_has_base AND in_base <> in_current").filter(side == wanted).select(
        *GAP, F.lit(schemas.PENDING).alias("status"), text.latest_context(side, seen_latest).alias("latest_context"), *own
    )


def score_gaps(found: DataFrame, prescriptions: DataFrame, reference_date) -> DataFrame:
    """The eight component scores of stored gaps with features; a gap without evidence rows scores zero."""
    days = found.filter(F.col("bene_id").isNotNull()).select(*GAP, F.explode("evidence_days").alias("event_date"))
    support = intervals.prescription_support(days, prescriptions, GAP)
    rows = found.join(support, GAP, "left").drop("evidence_days")
    counts = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in (*FEATURES, "prescription_support_count")}
    rows = rows.withColumns(counts).withColumn(
        "supporting_diagnosis_codes", F.coalesce("supporting_diagnosis_codes", F.array().cast("array<string>"))
    )
    empty = F.col("diagnosis_count") == 0
    parts = {
        name: F.when(empty, 0.0).otherwise(F.round(part, 4))
        for name, part in scores.component_scores(reference_date).items()
    }
    return rows.withColumns(parts)


def explain_gaps(scored: DataFrame) -> DataFrame:
    return scored.withColumn("reason_flags", text.reason_flags()).withColumn(
        "evidence_summary", text.evidence_summary()
    )


def suspects_v2(
    timeline: DataFrame, prescriptions: DataFrame, baseline: DataFrame | None, mapping: DataFrame, periods: Periods,
    latest_is_current: bool = False,
) -> DataFrame:
    """Gaps against a baseline with evidence features, scores, context, flags and summary."""
    features = window_features(timeline, periods) if baseline is None else period_features(timeline, periods)
    return suspects_from_features(features, prescriptions, baseline, mapping, periods, latest_is_current)


def suspects_from_features(
    features: DataFrame, prescriptions: DataFrame, baseline: DataFrame | None, mapping: DataFrame, periods: Periods,
    latest_is_current: bool = False,
) -> DataFrame:
    """The same from features of every pair and window, which are read once without a baseline and twice with one.

    Gaps with features are stored, because scores and the prescription match both start from them.
    """
    if baseline is None:
        found = gaps_of_features(features, latest_is_current)
    else:
        found = with_features(gaps.gaps_from_presence(presence_from_features(features), baseline, latest_is_current), features)
    rx = prescriptions if latest_is_current else prescriptions.filter(
        clean.in_years(F.col("event_date"), periods.loaded_years)
    )
    scored = explain_gaps(score_gaps(materialize(found), rx, periods.reference_date))
    return lookup.with_description(scored, mapping).withColumn("suspect_type", F.col("gap_type"))


def batch_priority(scored: DataFrame) -> DataFrame:
    """Four-part priority and tier from the eight component scores, as the batch run uses."""
    return scored.withColumn(
        "priority_score",
        scores.blend(*[F.col(c) for c in
                       ("recency_score", "frequency_score", "persistence_score", "source_diversity_score")]),
    ).withColumn("priority", scores.tier(F.col("priority_score")))


def run_batch_engine(
    timeline: DataFrame, claims: DataFrame, prescriptions: DataFrame, baseline: DataFrame, mapping: DataFrame,
    periods: Periods,
) -> DataFrame:
    """Gaps and scores for the members of one claims batch over history plus the batch."""
    batch_members = claims.select("bene_id").distinct()

    def scoped(df: DataFrame) -> DataFrame:
        return df.join(batch_members, "bene_id", "left_semi")

    combined = timeline_ops.with_batch(scoped(timeline), claims, mapping)
    return batch_priority(
        suspects_v2(combined, scoped(prescriptions), scoped(baseline), mapping, periods, latest_is_current=True)
    )


def batch_periods(claims: DataFrame, current_year: int | None = None) -> Periods:
    """Windows of a batch run: the given year or the largest claim year, and the two years before it."""
    year = current_year or claims.agg(F.year(F.max("claim_date"))).first()[0]
    if year is None:
        raise ValueError("Claim batch has no valid claim dates")
    return Periods.two_years_before(year)


# --- references and payloads ------------------------------------------------------


def evidence_references(events: DataFrame, keys: list[str] = GAP) -> DataFrame:
    """Atomic evidence, one row per reference (the long form of the reference list)."""
    return events.select(
        *keys, "event_id", "claim_id", F.col("event_date").alias("evidence_date"),
        F.col("code").alias("diagnosis_code"), "source", F.coalesce("is_principal", F.lit(False)).alias("is_principal"),
    )


def numbered_references(references: DataFrame, keys: list[str] = GAP) -> DataFrame:
    """References with their position in date order inside each gap."""
    order = ["evidence_date", "event_id", "claim_id", "diagnosis_code", "source", "is_principal"]
    return numbered(references, keys, [F.col(c) for c in order])


def reference_struct() -> Column:
    return F.struct(
        F.col("evidence_date").alias("date"), "event_id", "claim_id", "diagnosis_code", "source", "is_principal"
    )


def gap_claims(references: DataFrame, keys: list[str] = GAP) -> DataFrame:
    """Claim ids behind each gap: one row per gap and claim, with its position."""
    claims = references.filter(F.col("claim_id").isNotNull()).select(*keys, "claim_id").distinct()
    return numbered(claims, keys, [F.col("claim_id")])


OUTPUT_V2 = (
    *PAIR, "hcc_description", "gap_type", "suspect_type", "status", "latest_context", *FEATURES, "first_evidence_date",
    "last_evidence_date", "supporting_diagnosis_codes", "claim_count", "reference_count", "prescription_support_count",
    "prescription_drug_codes", *scores.EVIDENCE_WEIGHTS, "reason_flags", "evidence_summary",
)


def suspect_rows_v2(scored: DataFrame, references: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Output layout, one row per suspect; its claims and references are ``gap_claims`` and ``numbered_references``."""
    days = references.select(*GAP, F.col("evidence_date").alias("event_date")).distinct()
    drugs = intervals.prescription_drugs(days, prescriptions, GAP)
    counts = references.groupBy(*GAP).agg(
        F.count_distinct("claim_id").alias("claim_count"), F.count("*").alias("reference_count")
    )
    rows = scored.join(drugs, GAP, "left").join(counts, GAP, "left")
    return rows.withColumn(
        "prescription_drug_codes", F.coalesce("prescription_drug_codes", F.array().cast("array<string>"))
    ).na.fill(0, ["claim_count", "reference_count"]).select(*OUTPUT_V2)


def gap_sources(references: DataFrame, keys: list[str] = GAP) -> DataFrame:
    return references.groupBy(*keys).agg(joined_set("source").alias("sources"))


def evidence_rows(references: DataFrame, suspects: DataFrame, run_id: str) -> DataFrame:
    """Evidence table rows of a run: each reference with the suspect's key, summary and score."""
    owner = suspects.select(
        *GAP, F.coalesce("reviewer_summary", "evidence_summary").alias("evidence_text")
        if "reviewer_summary" in suspects.columns else F.col("evidence_summary").alias("evidence_text"),
        F.col("priority_score").alias("evidence_strength"),
    )
    return references.join(owner, GAP).select(
        clean.suspect_key(F.col("bene_id"), F.col("hcc_v28"), F.col("gap_type")).alias("suspect_id"),
        F.lit(run_id).alias("run_id"), "bene_id", F.lit("DIAGNOSIS").alias("evidence_type"), "evidence_date",
        "diagnosis_code", "claim_id", "source", "evidence_text", "evidence_strength",
        F.to_json(reference_struct()).alias("evidence_metadata"),
    )


def payload() -> Column:
    """Reviewer record of a scored gap; its references are records of their own."""
    evidence = F.struct(
        "diagnosis_count", "unique_claim_count", F.col("distinct_evidence_dates").alias("unique_evidence_dates"),
        F.col("distinct_evidence_months").alias("evidence_months"), "distinct_sources", "principal_diagnosis_count",
        "prescription_support_count", "first_evidence_date", "last_evidence_date",
        F.col("supporting_diagnosis_codes").alias("diagnosis_codes"),
    )
    return F.struct(
        "bene_id", F.col("hcc_v28").try_cast("int").alias("hcc_v28"), "hcc_description", "gap_type", "latest_context",
        F.col("reason_flags").alias("evidence_flags"), evidence.alias("evidence"),
        F.col("evidence_summary").alias("summary"), F.lit(text.REVIEW_INSTRUCTION).alias("review_instruction"),
    )


def payload_rows(scored: DataFrame, references: DataFrame) -> DataFrame:
    """JSON records, the same layout for every size: one per gap (position 0) and one per reference (1, 2, ...)."""
    gaps_part = scored.select(*GAP, F.lit(0).cast("bigint").alias("position"), F.to_json(payload()).alias("input_payload"))
    reference = F.struct(*GAP, reference_struct().alias("reference"))
    listed = numbered_references(references).join(scored.select(*GAP), GAP, "left_semi")
    return gaps_part.unionByName(listed.select(*GAP, "position", F.to_json(reference).alias("input_payload")))


def narratives(scored: DataFrame) -> DataFrame:
    """Reviewer narrative columns for scored gaps.

    Model priority, score and rank are told where a model scored the gap, else
    the rule-based ones; ``sources`` is optional.
    """
    text_null, number_null = F.lit(None).cast("string"), F.lit(None).cast("double")
    optional = {
        "sources": text_null, "ml_priority": text_null, "ml_priority_score": number_null,
        "ml_review_rank": F.lit(None).cast("bigint"),
    }
    rows = scored.withColumns({c: v for c, v in optional.items() if c not in scored.columns})
    told = {
        "priority": F.upper(F.coalesce("ml_priority", "priority")),
        # A model score of zero falls back to the rule score, as an absent one does.
        "priority_score": F.coalesce(F.nullif("ml_priority_score", F.lit(0.0)), "priority_score"),
        "review_rank": F.col("ml_review_rank"),
        "diagnosis_codes": F.col("supporting_diagnosis_codes"),
    }
    return rows.withColumns(told).withColumns(text.narrative_columns())
