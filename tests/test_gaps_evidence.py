import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caregap import schemas
from caregap.operators import evidence, gaps, intervals, ranking, review
from caregap.schemas import Periods

PERIODS = Periods((1998, 1999), 2000, 2001)


def timeline(spark, rows):
    """rows: (bene, day, hcc, claim, code, event, source, principal)."""
    data = [(b, dt.date.fromisoformat(d), "diagnosis", code, hcc, src, claim, event, p)
            for b, d, hcc, claim, code, event, src, p in rows]
    return spark.createDataFrame(data, schemas.MEMBER_TIMELINE)


@pytest.fixture(scope="module")
def small(spark):
    return timeline(spark, [
        ("A", "1998-05-01", "1", "c1", "X1", "e1", "CARRIER", True),
        ("A", "2000-08-01", "2", "c2", "X2", "e2", "INPATIENT", True),
        ("A", "2000-08-01", "2", "c2", "X2", "e2", "INPATIENT", True),
        ("A", "2000-09-01", "2", "c3", "X3", "e3", "CARRIER", False),
        ("A", "2001-01-01", "1", "c4", "X1", "e4", "CARRIER", False),
        ("B", "2000-02-01", "5", "c5", "X5", "e5", "CARRIER", False),
        ("C", "1999-02-01", "7", "c6", "X7", "e6", "CARRIER", False),
        ("C", "2000-02-01", "7", "c7", "X7", "e7", "CARRIER", False),
        ("D", "2000-03-01", "9", "c8", "X9", "e8", "CARRIER", False),
    ])


def pairs(df):
    return sorted((r.bene_id, r.hcc_v28) for r in df.collect())


def test_three_gap_rules(spark, small):
    members = spark.createDataFrame([("A",), ("B",), ("C",)], "bene_id string")
    assert pairs(gaps.emerging_v0(small, PERIODS)) == [("A", "2"), ("B", "5"), ("D", "9")]
    v1 = sorted((r.bene_id, r.hcc_v28, r.gap_type) for r in gaps.gaps_v1(small, members, PERIODS).collect())
    assert v1 == [("A", "1", "RECAPTURE"), ("A", "2", "EMERGING"), ("B", "5", "EMERGING")]
    v2 = sorted((r.bene_id, r.hcc_v28, r.gap_type, r.latest_context) for r in gaps.gaps_v2(small, None, PERIODS).collect())
    assert v2 == [("A", "1", "RECAPTURE", "REAPPEARED"), ("A", "2", "EMERGING", "NOT_SEEN_LATEST")]
    given = gaps.gaps_v2(small, gaps.baseline_pairs(small, PERIODS), PERIODS)
    assert sorted(map(tuple, given.collect())) == sorted(map(tuple, gaps.gaps_v2(small, None, PERIODS).collect()))


def test_gap_without_evidence_scores_zero(spark, small):
    base = spark.createDataFrame([("A", "44")], "bene_id string, hcc_v28 string")
    rx = spark.createDataFrame([], schemas.EVENTS_PRESCRIPTION)
    mapping = spark.createDataFrame([("X2", "two", "2", True)], schemas.HCC_MAPPING)
    rows = {r.hcc_v28: r for r in evidence.suspects_v2(small, rx, base, mapping, PERIODS).collect()}
    assert set(rows) == {"2", "44"}
    assert rows["44"].diagnosis_count == 0 and rows["44"].recency_score == 0.0
    assert rows["44"].evidence_summary.startswith("No current evidence")
    assert rows["44"].reason_flags == ["STILL_ABSENT"]
    assert rows["2"].diagnosis_count == 2 and rows["2"].unique_claim_count == 2
    assert rows["2"].hcc_description == "two" and rows["44"].hcc_description == "Unknown"


def brute_support(days, rx):
    found = {}
    for b, h, d in days:
        for rb, event, rd in rx:
            if rb == b and abs((d - rd).days) <= 30:
                found.setdefault((b, h), set()).add(event)
    return {k: len(v) for k, v in found.items()}


def test_prescription_support_matches_brute_force(spark):
    """Half of all rows belong to one member and some fill ids occur on several dates."""
    rng = random.Random(7)
    day = lambda: dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(500))
    who = lambda: "HOT" if rng.random() < 0.5 else f"M{rng.randrange(20)}"
    days = list({(who(), str(rng.randrange(4)), day()) for _ in range(300)})
    rx = [(who(), f"E{rng.randrange(250)}", day()) for _ in range(400)]
    left = spark.createDataFrame(days, "bene_id string, hcc_v28 string, event_date date")
    right = spark.createDataFrame([(b, e, d, "N" + e) for b, e, d in rx],
                                  "bene_id string, event_id string, event_date date, drug_code string")
    got = {(r.bene_id, r.hcc_v28): r.prescription_support_count
           for r in intervals.prescription_support(left, right).collect()}
    assert got == brute_support(days, rx)
    assert set(pairs(intervals.pairs_with_prescription(left, right))) == set(got)
    rows = {}
    for b, h in got:
        own = [d for b2, h2, d in days if (b2, h2) == (b, h)]
        rows[(b, h)] = sum(1 for rb, _, rd in rx if rb == b and any(abs((d - rd).days) <= 30 for d in own))
    counted = {(r.bene_id, r.hcc_v28): r.rx_support_count for r in intervals.prescription_row_counts(left, right).collect()}
    assert counted == rows
    arrays = left.groupBy("bene_id", "hcc_v28").agg(F.collect_set("event_date").alias("d")).join(
        intervals.member_fill_days(right), "bene_id", "left")
    near = intervals.fill_rows(intervals.near_fill_days(F.col("d"), F.col("fill_days")))
    assert {(r.bene_id, r.hcc_v28): r.n for r in arrays.select("bene_id", "hcc_v28", near.alias("n")).collect() if r.n} == rows


def test_interval_join_finds_each_match_once(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(0, 400, 7)]
    left = spark.createDataFrame([("k", d) for d in days], "bene_id string, a date")
    right = spark.createDataFrame([("k", d) for d in days], "bene_id string, b date")
    got = intervals.interval_join(left, right, "bene_id", "a", "b", 30).collect()
    want = [(a, b) for a in days for b in days if abs((a - b).days) <= 30]
    assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_lists_have_one_layout_for_every_size(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") < 4000, "HOT").otherwise("cold").alias("k"), F.concat(F.lit("c"), F.col("id")).alias("v"))
    rows = evidence.numbered(df, ["k"], [F.col("v")]).collect()
    for k, n, first in (("HOT", 4000, 0), ("cold", 1000, 4000)):
        own = sorted((r.position, r.v) for r in rows if r.k == k)
        assert own == list(enumerate(sorted(f"c{i}" for i in range(first, first + n)), 1))
    assert {r.k: len(r["items"]) for r in evidence.nested(df, ["k"], F.col("v"), "items").collect()} == {"HOT": 4000, "cold": 1000}


def test_global_rank_is_dense_with_ties(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("score"), "id").repartition(7)
    ranked = ranking.global_rank(df, [F.desc("score"), F.col("id")], "n").orderBy("n").collect()
    assert [r.n for r in ranked] == list(range(1, 1001))
    assert [(r.score, r.id) for r in ranked] == sorted(((i % 3, i) for i in range(1000)), key=lambda t: (-t[0], t[1]))


def test_severity_is_inert_by_default(spark):
    rows = spark.createDataFrame(
        [("A", "1", "EMERGING", "CONTINUED", 3, 1.0), ("B", "2", "RECAPTURE", "STILL_ABSENT", 2, 0.4)],
        "bene_id string, hcc_v28 string, gap_type string, latest_context string, diagnosis_count int, frequency_score double",
    )
    levels = spark.createDataFrame([("1", 4.0)], "hcc_v28 string, severity_level double")
    plain = {r.bene_id: r for r in ranking.rank_candidates(rows).collect()}
    inert = {r.bene_id: r for r in ranking.rank_candidates(rows, levels).collect()}
    used = {r.bene_id: r for r in ranking.rank_candidates(rows, levels, use_severity=True).collect()}
    assert plain["A"].review_priority_score == inert["A"].review_priority_score
    assert inert["A"].severity_reference_status == "MISSING_HCC_REFERENCE"
    assert used["A"].severity_score == 1.0 and used["A"].review_priority_score == round(0.65 * 0.18 + 0.15 + 0.20, 4)
    assert plain["A"].review_rank == 1 and plain["B"].review_queue


def test_upsert_keeps_review_status(spark):
    stored = spark.createDataFrame([("s1", 0.1, "REVIEWED"), ("s2", 0.2, "PENDING_REVIEW")], "suspect_id string, score double, status string")
    fresh = spark.createDataFrame([("s1", 0.9, "PENDING_REVIEW"), ("s3", 0.3, "PENDING_REVIEW")], "suspect_id string, score double, status string")
    got = {r.suspect_id: (r.score, r.status) for r in review.upsert_suspects(stored, fresh).collect()}
    assert got == {"s1": (0.9, "REVIEWED"), "s2": (0.2, "PENDING_REVIEW"), "s3": (0.3, "PENDING_REVIEW")}


def test_top_k_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    top = ranking.top_k_per_group(df, ["g"], [F.desc("id")], 3)
    assert sorted((r.g, r.id) for r in top.collect()) == [(0, 994), (0, 996), (0, 998), (1, 995), (1, 997), (1, 999)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
