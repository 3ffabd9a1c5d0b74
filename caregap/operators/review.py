"""Read models of the review workspace: filters, pages, details, decisions and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caregap import schemas
from caregap.functions import clean, scores
from caregap.operators import ranking
from caregap.operators.quality import side_by_side
from caregap.schemas import DECISIONS, EMERGING, PENDING, RECAPTURE, REVIEWED

SUPPORTING_EVENTS = 50
CONSOLE_PAGE = 15

# Columns a caller may sort the suspect queue by.
SORTABLE = (
    "suspect_id", "bene_id", "hcc_v28", "suspect_type", "priority_score", "evidence_count", "first_evidence_date",
    "last_evidence_date", "status", "ml_priority_score", "ml_review_rank", "review_rank",
)


# --- predicates ---------------------------------------------------------------


def ilike_any(term: str, *columns: str) -> Column:
    """Case-insensitive match; ``%`` and ``_`` in the term act as wildcards."""
    pattern = "%" + term.strip() + "%"
    condition = F.lit(False)
    for c in columns:
        condition = condition | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return condition


def contains_any(term: str, *columns: str) -> Column:
    """Case-insensitive plain substring over several columns."""
    q = term.lower()
    condition = F.lit(not term.strip())
    for c in columns:
        condition = condition | F.coalesce(F.lower(F.col(c).cast("string")).contains(q), F.lit(False))
    return condition


def filter_suspects(
    suspects: DataFrame, type: str | None = None, min_score: float | None = None, hcc: str | None = None,
    status: str | None = None, ml_priority: str | None = None,
) -> DataFrame:
    """Only the given parameters become predicates."""
    rows = suspects
    if type:
        rows = rows.filter(F.col("suspect_type") == type.upper())
    if min_score is not None:
        rows = rows.filter(F.col("priority_score") >= min_score)
    if hcc:
        rows = rows.filter(F.col("hcc_v28") == hcc.strip())
    if status:
        rows = rows.filter(F.col("status") == status.strip())
    if ml_priority:
        rows = rows.filter(F.col("ml_priority") == ml_priority.upper().strip())
    return rows


def filter_timeline(timeline: DataFrame, year: int | None = None, source: str | None = None, hcc_only: bool = False) -> DataFrame:
    rows = timeline
    if year is not None:
        rows = rows.filter(clean.in_years(F.col("event_date"), [year]))
    if source:
        rows = rows.filter(F.col("source") == source.strip())
    if hcc_only:
        rows = rows.filter(F.col("hcc_v28").isNotNull() & (F.col("hcc_v28") != ""))
    return rows


def filter_reviews(
    reviews: DataFrame, suspect_id: str | None = None, bene_id: str | None = None, decision: str | None = None
) -> DataFrame:
    rows = reviews
    if suspect_id:
        rows = rows.filter(F.col("suspect_id") == suspect_id.strip())
    if bene_id:
        rows = rows.filter(F.col("bene_id") == bene_id.strip())
    if decision:
        rows = rows.filter(F.col("decision") == decision.upper().strip())
    return rows


def search_reviews(reviews: DataFrame, term: str, decision: str = "ALL") -> DataFrame:
    rows = reviews if decision == "ALL" else reviews.filter(F.col("decision") == decision)
    return rows.filter(contains_any(term, "bene_id", "hcc_v28", "notes"))


# --- sort and page --------------------------------------------------------------


def sort_order(columns: list[str], sort: str = "ml_review_rank", order: str = "asc", tiebreak: str = "suspect_id") -> list[Column]:
    """Sort by a named column with nulls last ascending and first descending; unknown names use the rank."""
    name = sort if sort in SORTABLE and sort in columns else "ml_review_rank"
    key = F.asc_nulls_last(name) if order.lower() == "asc" else F.desc_nulls_first(name)
    return [key, F.col(tiebreak)]


def page_of(df: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    """Rows of a page in a total order. Later pages are cut by global position, so no task merges all earlier pages."""
    if page == 1:
        return df.orderBy(*order).limit(size)
    ranked = ranking.global_rank(df, order, "_place").filter(F.col("_place").between((page - 1) * size + 1, page * size))
    return ranked.orderBy("_place").drop("_place")


def page_after(df: DataFrame, keys: list[tuple[str, bool]], last: dict, size: int = 20) -> DataFrame:
    """The page behind the row ``last`` in the order of ``keys`` (column, ascending); only ``size`` rows a task are merged.

    Nulls come last in ascending and first in descending order.
    """
    after = F.lit(False)
    for name, ascending in reversed(keys):
        column, value = F.col(name), last[name]
        if ascending:
            beyond = F.lit(False) if value is None else column.isNull() | (column > F.lit(value))
        else:
            beyond = column.isNotNull() if value is None else F.coalesce(column < F.lit(value), F.lit(False))
        after = beyond | (column.eqNullSafe(F.lit(value)) & after)
    order = [F.asc_nulls_last(name) if ascending else F.desc_nulls_first(name) for name, ascending in keys]
    return df.filter(after).orderBy(*order).limit(size)


def page_info(df: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """Total and page count (one page when empty) of a filtered query."""
    total = F.col("total")
    return df.agg(F.count("*").alias("total")).select(
        total, F.lit(page).cast("bigint").alias("page"), F.lit(size).cast("bigint").alias("size"),
        F.when(total > 0, F.ceil(total / F.lit(size)).cast("bigint")).otherwise(F.lit(1).cast("bigint")).alias("pages"),
    )


def timeline_order(newest_first: bool = True) -> list[Column]:
    """Date (newest first in the workspace, oldest first in the console), type, then stable tie-breaks."""
    day = F.desc("event_date") if newest_first else F.asc("event_date")
    return [day, F.col("event_type"), F.col("event_id"), F.col("code")]


def browse_queue(
    suspects: DataFrame, decisions: DataFrame, type: str | None = None, min_score: float | None = None,
    hcc: str | None = None, page: int = 1,
) -> DataFrame:
    """Console queue page with the decision or ``PENDING`` beside each suspect."""
    rows = page_of(
        filter_suspects(suspects, type=type, min_score=min_score, hcc=hcc),
        [F.desc("priority_score"), F.col("suspect_id")], page, CONSOLE_PAGE,
    )
    return with_decision(rows, decisions)


# --- joins ------------------------------------------------------------------------


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Newest row per key by a sortable column."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(
        key, *[F.col(f"_row.{c}").alias(c) for c in rest]
    )


def with_decision(suspects: DataFrame, decisions: DataFrame) -> DataFrame:
    made = latest_per_key(decisions.select("suspect_id", "decision", "reviewer_timestamp"), "suspect_id",
                          "reviewer_timestamp").select("suspect_id", "decision")
    return suspects.join(made, "suspect_id", "left").withColumn("decision", F.coalesce("decision", F.lit("PENDING")))


def pending(suspects: DataFrame, decisions: DataFrame) -> DataFrame:
    return suspects.join(decisions.select("suspect_id"), "suspect_id", "left_anti").orderBy(
        F.desc("priority_score"), "suspect_id"
    )


def members_by_suspects(members: DataFrame, suspects: DataFrame, has_suspects: bool) -> DataFrame:
    how = "left_semi" if has_suspects else "left_anti"
    return members.join(suspects.select("bene_id"), "bene_id", how)


def matching_events(timeline: DataFrame, suspects: DataFrame, claims: DataFrame) -> DataFrame:
    """Events of a suspect's member with the same category, a supporting code or a supporting claim.

    ``suspects`` has suspect_id, bene_id, hcc_v28 and diagnosis_codes (a bounded
    list); ``claims`` has one row per suspect_id and claim_id, and the suspect's
    bene_id where the caller has it. Claims go the way of the events, by member, so that
    each event is sent once: a member's suspects are few and meet its rows as one list,
    which also cuts the timeline to members with suspects; a window over member and claim
    tells the suspects of the claim. A row that meets several conditions appears once.
    Rows of the timeline that are equal in every column stay apart by their ``row``.
    """
    own = suspects.select("suspect_id", "bene_id", "hcc_v28", "diagnosis_codes")
    columns = list(schemas.TIMELINE_COLUMNS)
    events = timeline.select(*columns).withColumn("row", F.monotonically_increasing_id())
    if "bene_id" not in claims.columns:
        claims = claims.select("suspect_id", "claim_id").join(own.select("suspect_id", "bene_id").distinct(), "suspect_id")
    of_member = own.groupBy("bene_id").agg(F.collect_list(F.struct("suspect_id", "hcc_v28", "diagnosis_codes")).alias("_own"))
    marked = claims.filter("claim_id IS NOT NULL").select("bene_id", "claim_id", F.col("suspect_id").alias("_claimant"))
    rows = events.unionByName(marked, allowMissingColumns=True).join(of_member, "bene_id")

    def meets(s: Column) -> Column:
        return (s["hcc_v28"] == F.col("hcc_v28")) | F.array_contains(s["diagnosis_codes"], F.col("code"))

    by_value = F.transform(F.filter("_own", meets), lambda s: s["suspect_id"])
    by_claim = F.collect_set("_claimant").over(Window.partitionBy("bene_id", "claim_id"))
    met = rows.select(*columns, "row", "_claimant", by_value.alias("_by_value")).withColumn("_by_claim", by_claim)
    both = F.array_distinct(F.concat("_by_value", "_by_claim"))
    return met.filter(F.col("row").isNotNull()).select(F.explode(both).alias("suspect_id"), *columns, "row")


def supporting_events(
    timeline: DataFrame, suspects: DataFrame, claims: DataFrame, limit: int = SUPPORTING_EVENTS, group: tuple[str, ...] = ("suspect_id",)
) -> DataFrame:
    """Most recent matching events per suspect.

    Where a suspect's id belongs to one member only, ``group`` may begin with bene_id: rows then stay where they met.
    """
    found = matching_events(timeline, suspects, claims)
    order = [F.desc("event_date"), F.col("event_type"), F.col("event_id"), F.col("code"), F.col("claim_id"), F.col("row")]
    return ranking.top_k_per_group(found, list(group), order, limit)


def suspect_detail(suspects: DataFrame, members: DataFrame, baseline: DataFrame, reviews: DataFrame) -> DataFrame:
    """Suspect with member attributes, baseline size and the newest reviewer record."""
    counts = baseline.groupBy("bene_id").agg(F.count("*").alias("baseline_hcc_count"))
    newest = latest_per_key(
        reviews.select("suspect_id", "review_id", "reviewer_summary"), "suspect_id", "review_id"
    )
    return (
        suspects.join(members.select("bene_id", "sex", "state"), "bene_id", "left")
        .join(counts, "bene_id", "left")
        .join(newest, "suspect_id", "left")
        .withColumn("baseline_hcc_count", F.coalesce("baseline_hcc_count", F.lit(0).cast("bigint")))
    )


def suspect_baseline(suspects: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline rows of each suspect's member, for the detail view."""
    own = suspects.select("suspect_id", "bene_id")
    return own.join(baseline, "bene_id")


def member_suspects(suspects: DataFrame) -> DataFrame:
    """Suspects of each member, best score first, with their place. A member has at most one per category and type."""
    order = Window.partitionBy("bene_id").orderBy(F.desc("priority_score"), "suspect_id")
    return suspects.withColumn("place", F.row_number().over(order).cast("bigint"))


def member_stats(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("bene_id").agg(
        F.count_distinct("claim_id").alias("total_claims"),
        F.count_if(F.lower("event_type") == "diagnosis").alias("total_diagnoses"),
    )


def member_detail(members: DataFrame, baseline: DataFrame, suspects: DataFrame, timeline: DataFrame) -> DataFrame:
    """Member row with timeline, baseline and suspect counters."""
    base = baseline.groupBy("bene_id").agg(F.count("*").alias("baseline_hcc_count"))
    open_work = suspects.groupBy("bene_id").agg(
        F.count("*").alias("suspect_hcc_count"), F.count_if(F.col("status") == PENDING).alias("pending_review_count")
    )
    joined = (
        members.select("bene_id", "sex", "state")
        .join(member_stats(timeline), "bene_id", "left")
        .join(base, "bene_id", "left")
        .join(open_work, "bene_id", "left")
    )
    return joined.na.fill(
        0, ["total_claims", "total_diagnoses", "baseline_hcc_count", "suspect_hcc_count", "pending_review_count"]
    )


# --- counters ------------------------------------------------------------------------


def dashboard(members: DataFrame, baseline: DataFrame, suspects: DataFrame) -> DataFrame:
    """Eight headline numbers in one row."""
    m = members.agg(F.count("bene_id").alias("total_members"))
    b = baseline.agg(F.count_distinct("bene_id").alias("members_with_baseline"))
    kind = F.upper("suspect_type")
    s = suspects.agg(
        F.count("suspect_id").alias("total_suspects"),
        F.count_if(kind == EMERGING).alias("emerging_count"),
        F.count_if(kind == RECAPTURE).alias("recapture_count"),
        F.count_if(F.col("priority_score") >= scores.HIGH_FROM).alias("high_priority_count"),
        F.count_if(F.col("status") == REVIEWED).alias("reviewed_count"),
        F.count_if(F.col("status") == PENDING).alias("pending_count"),
    )
    return side_by_side(m, b, s)


def hcc_pivot(suspects: DataFrame) -> DataFrame:
    """Emerging and recapture counts per category, largest total first."""
    hcc, kind = F.coalesce(F.nullif("hcc_v28", F.lit("")), F.lit("UNKNOWN")), F.upper("suspect_type")
    return (
        suspects.groupBy(hcc.alias("hcc_v28"))
        .agg(F.count_if(kind == EMERGING).alias("emerging_count"), F.count_if(kind == RECAPTURE).alias("recapture_count"))
        .withColumn("description", F.concat(F.lit("HCC "), F.col("hcc_v28")))
        .orderBy(F.desc(F.col("emerging_count") + F.col("recapture_count")), "hcc_v28")
    )


def _tier_counts() -> list[Column]:
    s = F.col("priority_score")
    return [
        F.count_if(s >= scores.HIGH_FROM).alias("high"),
        F.count_if((s >= scores.MEDIUM_FROM) & (s < scores.HIGH_FROM)).alias("medium"),
        F.count_if(s < scores.MEDIUM_FROM).alias("low"),
    ]


def _decision_counts() -> list[Column]:
    return [F.count_if(F.col("decision") == d).alias(d.lower()) for d in DECISIONS]


def score_histogram(suspects: DataFrame) -> DataFrame:
    return suspects.agg(*_tier_counts())


def decision_counts(reviews: DataFrame) -> DataFrame:
    return reviews.agg(*_decision_counts())


def overview(members: DataFrame, baseline: DataFrame, suspects: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cohort, type and tier counts with shares, decision counts, and pending = total − reviewed."""
    decided = latest_per_key(decisions.select("suspect_id", "decision", "reviewer_timestamp"), "suspect_id",
                             "reviewer_timestamp")
    b = baseline.agg(
        F.count_distinct("bene_id").alias("members_with_baseline"), F.count("*").alias("baseline_hccs")
    )
    s = suspects.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("suspect_type") == EMERGING).alias("emerging"),
        F.count_if(F.col("suspect_type") == RECAPTURE).alias("recapture"),
        *_tier_counts(),
    )
    d = decided.agg(F.count("*").alias("reviewed"), *_decision_counts())
    row = side_by_side(members.agg(F.count("*").alias("members")), b, s, d)
    shares = {f"{t}_pct": F.round(clean.percent(F.col(t), F.col("total")), 4) for t in ("high", "medium", "low")}
    return row.withColumns(shares).withColumn("pending", F.col("total") - F.col("reviewed"))


def members_with_opportunities(suspects: DataFrame, k: int = 10) -> DataFrame:
    return ranking.top_k(suspects.groupBy("bene_id").agg(F.count("*").alias("suspects")), [F.col("bene_id")], k)


# --- decisions ------------------------------------------------------------------------


def check_decisions(decisions: DataFrame, suspects: DataFrame) -> DataFrame:
    """Decisions with a ``reason`` when refused, else with the suspect's values copied in."""
    value = F.upper(clean.strip(F.col("decision")))
    snapshot = suspects.select("suspect_id", "bene_id", "hcc_v28", "suspect_type", "priority_score")
    return (
        decisions.withColumn("_given", F.col("decision"))
        .withColumn("decision", value)
        .join(snapshot, "suspect_id", "left")
        .withColumn(
            "reason",
            F.when(
                ~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)),
                F.concat(F.lit("Invalid decision: "), F.coalesce("_given", F.lit(""))),
            ).when(F.col("bene_id").isNull(), F.concat(F.lit("Suspect not found: "), F.col("suspect_id"))),
        )
        .drop("_given")
    )


def apply_decisions(suspects: DataFrame, checked: DataFrame) -> DataFrame:
    """Suspects with status ``REVIEWED`` where an accepted decision exists."""
    decided = checked.filter(F.col("reason").isNull()).select("suspect_id").distinct()
    return set_status(suspects, decided.withColumn("new_status", F.lit(REVIEWED)))


def set_status(suspects: DataFrame, updates: DataFrame) -> DataFrame:
    return (
        suspects.join(updates.select("suspect_id", "new_status"), "suspect_id", "left")
        .withColumn("status", F.coalesce("new_status", "status"))
        .drop("new_status")
    )


def aligned(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows with exactly the columns of ``schema``; columns they lack are null."""
    return rows.select(
        *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def upsert_suspects(stored: DataFrame, fresh: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Fresh rows win as a whole, but a stored review status stays; suspects absent from the run are kept.

    Both sides are aligned to one schema (given, or all columns of either), so a run
    with or without model columns neither fails nor drops what other suspects have.
    """
    if schema is None:
        schema = T.StructType([*fresh.schema, *(f for f in stored.schema if f.name not in fresh.columns)])
    new, old = (aligned(rows, schema).select("suspect_id", F.struct("*").alias(name)) for rows, name in ((fresh, "new"), (stored, "old")))
    joined = new.join(old, "suspect_id", "full_outer")
    winner = F.coalesce("new", "old")
    return joined.select(
        *[(F.coalesce("old.status", "new.status") if f.name == "status" else winner[f.name]).alias(f.name) for f in schema]
    )
