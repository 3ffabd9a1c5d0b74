"""Review workspace: filters, pages, details, counters and decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caregap.operators import gaps, review
from caregap.operators.text_index import TextIndex
from caregap.plans.fixtures import PERIODS
from caregap.plans.registry import query
from caregap.session import ensure_checkpoint_dir

_PAGE = "suspect_id, bene_id, hcc_v28, suspect_type, priority_score"
_SHOWN = ["suspect_id", "bene_id", "hcc_v28", "suspect_type", "priority_score"]


@query(
    "p5_member_search",
    "SELECT bene_id, state FROM members WHERE bene_id ILIKE '%tion_1%' OR state ILIKE '%tion_1%'",
)
def _(f):
    return f.members.filter(review.ilike_any(" tion_1 ", "bene_id", "state")).select("bene_id", "state")


@query(
    "p6_suspect_search",
    f"""SELECT {_PAGE} FROM suspects WHERE lower(bene_id) LIKE '%anvil%' OR hcc_v28 LIKE '%anvil%'
        OR lower(hcc_description) LIKE '%anvil%' OR lower(suspect_type) LIKE '%anvil%'""",
)
def _(f):
    term = review.contains_any("ANVIL", "bene_id", "hcc_v28", "hcc_description", "suspect_type")
    return f.suspects.filter(term).select(*_SHOWN)


@query(
    "p7_review_search",
    "SELECT review_id, decision, notes FROM reviews WHERE decision = 'SUPPORTED' AND lower(notes) LIKE '%of hcc 1%'",
)
def _(f):
    return review.search_reviews(f.reviews, "OF HCC 1", "SUPPORTED").select("review_id", "decision", "notes")


def _indexed(f, rows, *columns: str) -> TextIndex:
    return TextIndex.build(rows, f"{ensure_checkpoint_dir(f.spark)}/stores/{uuid.uuid4().hex}", columns)


@query(
    "p5_indexed_members",
    "SELECT bene_id, state FROM members WHERE bene_id ILIKE '%000_17%' OR state ILIKE '%000_17%'",
)
def _(f):
    return _indexed(f, f.members.select("bene_id", "state"), "bene_id", "state").ilike(" 000_17 ")


@query(
    "p6_indexed_suspects",
    f"""SELECT {_PAGE} FROM suspects WHERE lower(bene_id) LIKE '%anvil%' OR hcc_v28 LIKE '%anvil%'
        OR lower(hcc_description) LIKE '%anvil%' OR lower(suspect_type) LIKE '%anvil%'""",
)
def _(f):
    rows = f.suspects.select(*_SHOWN, "hcc_description")
    return _indexed(f, rows, "bene_id", "hcc_v28", "hcc_description", "suspect_type").contains("ANVIL").select(*_SHOWN)


@query(
    "p7_indexed_reviews",
    "SELECT review_id, decision, notes FROM reviews WHERE decision = 'SUPPORTED' AND lower(notes) LIKE '%of hcc 1%'",
)
def _(f):
    rows = f.reviews.select("review_id", "decision", "notes", "bene_id", "hcc_v28")
    found = _indexed(f, rows, "bene_id", "hcc_v28", "notes").contains("OF HCC 1")
    return found.filter("decision = 'SUPPORTED'").select("review_id", "decision", "notes")


@query(
    "p8_suspect_filters",
    f"""SELECT {_PAGE} FROM suspects WHERE suspect_type = 'EMERGING' AND priority_score >= 0.6 AND hcc_v28 = '12'
        AND status = 'PENDING_REVIEW' AND ml_priority = 'MEDIUM'""",
)
def _(f):
    return review.filter_suspects(
        f.suspects, type="emerging", min_score=0.6, hcc=" 12 ", status="PENDING_REVIEW", ml_priority="medium"
    ).select(*_SHOWN)


_MATCH_SQL = """(SELECT s.suspect_id, t.* FROM suspects s JOIN timeline t ON t.bene_id = s.bene_id
       AND (t.hcc_v28 = s.hcc_v28 OR list_contains(string_split(s.supporting_diagnosis_codes, '|'), t.code)
            OR t.claim_id IN (SELECT claim_id FROM mapped e WHERE e.bene_id = s.bene_id AND e.hcc_v28 = s.hcc_v28
                              AND e.yr BETWEEN 1998 AND 2000)))"""


def _matching(f):
    """Suspects with their codes, and their claims in long form."""
    f.stored_timeline().stored("suspects")
    claims = gaps.diagnoses(f.dx_timeline).filter("year(event_date) BETWEEN 1998 AND 2000").select(*gaps.PAIR, "claim_id")
    suspects = f.suspects.withColumn("diagnosis_codes", F.split("supporting_diagnosis_codes", r"\|"))
    return f.timeline, suspects, suspects.select(*gaps.PAIR, "suspect_id").join(claims, gaps.PAIR)


@query("p11_matching_events", f"SELECT suspect_id, event_id, event_type, code, claim_id, event_date FROM {_MATCH_SQL}")
def _(f):
    return review.matching_events(*_matching(f)).select("suspect_id", "event_id", "event_type", "code", "claim_id", "event_date")


@query(
    "w12_recent_supporting_events",
    f"""SELECT suspect_id, event_id, code, event_date, position FROM (
          SELECT *, row_number() OVER (PARTITION BY suspect_id ORDER BY event_date DESC, event_type, event_id, code, claim_id) AS position
          FROM {_MATCH_SQL}) WHERE position <= 50""",
)
def _(f):
    # The suspect's id is made from its member's.
    return review.supporting_events(*_matching(f), group=("bene_id", "suspect_id")).select("suspect_id", "event_id", "code", "event_date", "position")


@query("j8_members_with_suspects", "SELECT bene_id, state FROM members WHERE bene_id IN (SELECT bene_id FROM suspects)")
def _(f):
    return review.members_by_suspects(f.members, f.suspects, True).select("bene_id", "state")


@query("j8_members_without_suspects", "SELECT bene_id, state FROM members WHERE bene_id NOT IN (SELECT bene_id FROM suspects)")
def _(f):
    return review.members_by_suspects(f.members, f.suspects, False).select("bene_id", "state")


@query(
    "j12_suspects_with_decision",
    """SELECT s.suspect_id, s.priority_score, coalesce(r.decision, 'PENDING') AS decision
       FROM suspects s LEFT JOIN reviews r USING (suspect_id)""",
)
def _(f):
    return review.with_decision(f.suspects, f.reviews).select("suspect_id", "priority_score", "decision")


@query(
    "w15_pending_work",
    """SELECT suspect_id, priority_score FROM suspects WHERE suspect_id NOT IN (SELECT suspect_id FROM reviews)
       ORDER BY priority_score DESC, suspect_id""",
)
def _(f):
    return review.pending(f.suspects, f.reviews).select("suspect_id", "priority_score")


_NARRATIVES = """(SELECT suspect_id, max(review_id) AS review_id, arg_max(reviewer_summary, review_id) AS reviewer_summary FROM (
       SELECT suspect_id, 'L1-' || suspect_id AS review_id, 'draft for HCC ' || hcc_v28 AS reviewer_summary FROM suspects
       UNION ALL SELECT suspect_id, 'L2-' || suspect_id, 'final for HCC ' || hcc_v28 FROM suspects WHERE CAST(hcc_v28 AS INTEGER) % 2 = 0)
       GROUP BY suspect_id)"""


def _reviewer_records(f):
    key = F.col("suspect_id")
    hcc = F.col("hcc_v28")
    drafts = f.suspects.select(
        key, F.concat(F.lit("L1-"), key).alias("review_id"), F.concat(F.lit("draft for HCC "), hcc).alias("reviewer_summary")
    )
    finals = f.suspects.filter(hcc.cast("int") % 2 == 0).select(
        key, F.concat(F.lit("L2-"), key).alias("review_id"), F.concat(F.lit("final for HCC "), hcc).alias("reviewer_summary")
    )
    return drafts.unionByName(finals)


@query("w11_latest_record", f"SELECT suspect_id, review_id, reviewer_summary FROM {_NARRATIVES}")
def _(f):
    return review.latest_per_key(_reviewer_records(f), "suspect_id", "review_id")


@query(
    "j13_suspect_detail",
    f"""SELECT s.suspect_id, s.bene_id, m.sex, m.state, coalesce(b.n, 0) AS baseline_hcc_count, r.review_id, r.reviewer_summary
        FROM suspects s LEFT JOIN members m USING (bene_id)
        LEFT JOIN (SELECT bene_id, count(*) AS n FROM baseline GROUP BY bene_id) b USING (bene_id)
        LEFT JOIN {_NARRATIVES} r USING (suspect_id)""",
)
def _(f):
    return review.suspect_detail(f.suspects, f.members, f.baseline, _reviewer_records(f)).select(
        "suspect_id", "bene_id", "sex", "state", "baseline_hcc_count", "review_id", "reviewer_summary"
    )


@query(
    "j14_member_detail",
    """SELECT m.bene_id, m.sex, m.state, coalesce(t.total_claims, 0) AS total_claims, coalesce(t.total_diagnoses, 0) AS total_diagnoses,
              coalesce(b.n, 0) AS baseline_hcc_count, coalesce(s.n, 0) AS suspect_hcc_count, coalesce(s.p, 0) AS pending_review_count
       FROM members m
       LEFT JOIN (SELECT bene_id, count(DISTINCT claim_id) AS total_claims, count(*) FILTER (event_type = 'diagnosis') AS total_diagnoses
                  FROM timeline GROUP BY bene_id) t USING (bene_id)
       LEFT JOIN (SELECT bene_id, count(*) AS n FROM baseline GROUP BY bene_id) b USING (bene_id)
       LEFT JOIN (SELECT bene_id, count(*) AS n, count(*) FILTER (status = 'PENDING_REVIEW') AS p FROM suspects GROUP BY bene_id) s
         USING (bene_id)""",
)
def _(f):
    f.stored_timeline()
    return review.member_detail(f.members, f.baseline, f.suspects, f.timeline)


@query(
    "j13_suspect_baseline",
    """SELECT s.suspect_id, b.bene_id, b.hcc_v28 FROM suspects s JOIN baseline b USING (bene_id)""",
)
def _(f):
    return review.suspect_baseline(f.suspects, f.baseline).select("suspect_id", "bene_id", "hcc_v28")


@query(
    "j14_member_suspects",
    """SELECT bene_id, suspect_id, priority_score, status, row_number() OVER (PARTITION BY bene_id ORDER BY priority_score DESC, suspect_id) AS place
       FROM suspects""",
)
def _(f):
    return review.member_suspects(f.suspects).select("bene_id", "suspect_id", "priority_score", "status", "place")


@query(
    "w8_page_after_a_key",
    """SELECT bene_id, state FROM members WHERE state ILIKE '%tion_2%' AND bene_id > 'B00000077' ORDER BY bene_id LIMIT 20""",
)
def _(f):
    rows = f.members.filter(review.ilike_any("tion_2", "bene_id", "state")).select("bene_id", "state")
    return review.page_after(rows, [("bene_id", True)], {"bene_id": "B00000077"})


@query(
    "a16_member_stats",
    """SELECT bene_id, count(DISTINCT claim_id) AS total_claims, count(*) FILTER (event_type = 'diagnosis') AS total_diagnoses
       FROM timeline GROUP BY bene_id""",
)
def _(f):
    return review.member_stats(f.timeline)


@query(
    "w8_member_page",
    "SELECT bene_id, state FROM members WHERE state ILIKE '%tion_2%' ORDER BY bene_id LIMIT 20 OFFSET 40",
)
def _(f):
    rows = f.members.filter(review.ilike_any("tion_2", "bene_id", "state")).select("bene_id", "state")
    return review.page_of(rows, [F.col("bene_id")], page=3, size=20)


@query(
    "w8_page_info",
    """SELECT count(*) AS total, CAST(3 AS BIGINT) AS page, CAST(20 AS BIGINT) AS size,
              CASE WHEN count(*) > 0 THEN CAST(ceil(count(*) / 20.0e0) AS BIGINT) ELSE 1 END AS pages
       FROM members WHERE state ILIKE '%tion_2%'""",
)
def _(f):
    return review.page_info(f.members.filter(review.ilike_any("tion_2", "bene_id", "state")), page=3, size=20)


@query(
    "w9_sorted_suspect_page",
    f"SELECT {_PAGE} FROM suspects ORDER BY last_evidence_date DESC NULLS FIRST, suspect_id LIMIT 20 OFFSET 20",
)
def _(f):
    order = review.sort_order(f.suspects.columns, "last_evidence_date", "desc")
    return review.page_of(f.suspects, order, page=2, size=20).select(*_SHOWN)


@query(
    "w10_member_timeline_page",
    """SELECT bene_id, event_date, event_type, event_id, code FROM timeline WHERE bene_id = 'B00000077'
       ORDER BY event_date DESC, event_type, event_id, code LIMIT 20""",
)
def _(f):
    rows = f.timeline.filter(F.col("bene_id") == "B00000077")
    return review.page_of(rows, review.timeline_order(), size=20).select("bene_id", "event_date", "event_type", "event_id", "code")


@query(
    "w10_console_timeline",
    """SELECT bene_id, event_date, event_type, event_id, code FROM timeline WHERE bene_id = 'B00000077'
       ORDER BY event_date, event_type, event_id, code LIMIT 50""",
)
def _(f):
    rows = f.timeline.filter(F.col("bene_id") == "B00000077")
    return review.page_of(rows, review.timeline_order(False), size=50).select("bene_id", "event_date", "event_type", "event_id", "code")


@query(
    "w16_console_queue",
    """SELECT s.suspect_id, s.priority_score, coalesce(r.decision, 'PENDING') AS decision FROM (
         SELECT * FROM suspects WHERE suspect_type = 'RECAPTURE' AND hcc_v28 = '10' ORDER BY priority_score DESC, suspect_id LIMIT 15 OFFSET 15) s
       LEFT JOIN reviews r USING (suspect_id)""",
)
def _(f):
    return review.browse_queue(f.suspects, f.reviews, type="RECAPTURE", hcc="10", page=2).select(
        "suspect_id", "priority_score", "decision"
    )


_DASH = """SELECT (SELECT count(*) FROM members) AS total_members, (SELECT count(DISTINCT bene_id) FROM baseline) AS members_with_baseline,
       count(*) AS total_suspects, count(*) FILTER (suspect_type = 'EMERGING') AS emerging_count,
       count(*) FILTER (suspect_type = 'RECAPTURE') AS recapture_count, count(*) FILTER (priority_score >= 0.75) AS high_priority_count,
       count(*) FILTER (status = 'REVIEWED') AS reviewed_count, count(*) FILTER (status = 'PENDING_REVIEW') AS pending_count FROM suspects"""


@query("a12_dashboard_metrics", _DASH)
def _(f):
    f.stored("dx_timeline", "suspects")
    return review.dashboard(f.members, f.baseline, f.suspects)


@query(
    "a13_hcc_by_type",
    """SELECT hcc_v28, 'HCC ' || hcc_v28 AS description, count(*) FILTER (suspect_type = 'EMERGING') AS emerging_count,
              count(*) FILTER (suspect_type = 'RECAPTURE') AS recapture_count FROM suspects GROUP BY hcc_v28""",
)
def _(f):
    return review.hcc_pivot(f.suspects)


@query(
    "a14_score_histogram",
    """SELECT count(*) FILTER (priority_score >= 0.75) AS high, count(*) FILTER (priority_score >= 0.5 AND priority_score < 0.75) AS medium,
              count(*) FILTER (priority_score < 0.5) AS low FROM suspects""",
)
def _(f):
    return review.score_histogram(f.suspects)


@query(
    "a15_decision_counts",
    """SELECT count(*) FILTER (decision = 'SUPPORTED') AS supported, count(*) FILTER (decision = 'NOT_SUPPORTED') AS not_supported,
              count(*) FILTER (decision = 'INSUFFICIENT_EVIDENCE') AS insufficient_evidence FROM reviews""",
)
def _(f):
    return review.decision_counts(f.reviews)


@query(
    "a29_review_overview",
    """SELECT (SELECT count(*) FROM members) AS members, (SELECT count(DISTINCT bene_id) FROM baseline) AS members_with_baseline,
              (SELECT count(*) FROM baseline) AS baseline_hccs, s.*, r.*, round(high * 100.0e0 / total, 4) AS high_pct,
              round(medium * 100.0e0 / total, 4) AS medium_pct, round(low * 100.0e0 / total, 4) AS low_pct, total - reviewed AS pending
       FROM (SELECT count(*) AS total, count(*) FILTER (suspect_type = 'EMERGING') AS emerging,
                    count(*) FILTER (suspect_type = 'RECAPTURE') AS recapture, count(*) FILTER (priority_score >= 0.75) AS high,
                    count(*) FILTER (priority_score >= 0.5 AND priority_score < 0.75) AS medium,
                    count(*) FILTER (priority_score < 0.5) AS low FROM suspects) s,
            (SELECT count(*) AS reviewed, count(*) FILTER (decision = 'SUPPORTED') AS supported,
                    count(*) FILTER (decision = 'NOT_SUPPORTED') AS not_supported,
                    count(*) FILTER (decision = 'INSUFFICIENT_EVIDENCE') AS insufficient_evidence FROM reviews) r""",
)
def _(f):
    f.stored("dx_timeline", "suspects")
    return review.overview(f.members, f.baseline, f.suspects, f.reviews)


@query(
    "u7_check_decisions",
    "SELECT review_id, suspect_id, bene_id, hcc_v28, suspect_type, priority_score, decision, notes, CAST(reviewer_timestamp AS VARCHAR) AS reviewer_timestamp, reason FROM checked",
)
def _(f):
    return review.check_decisions(f.decisions, f.suspects).withColumn("reviewer_timestamp", F.col("reviewer_timestamp").cast("string"))


@query(
    "u7_apply_decisions",
    """SELECT suspect_id, CASE WHEN suspect_id IN (SELECT suspect_id FROM reviews) THEN 'REVIEWED' ELSE status END AS status FROM suspects""",
)
def _(f):
    return review.apply_decisions(f.suspects, review.check_decisions(f.decisions, f.suspects)).select("suspect_id", "status")


@query(
    "u8_bulk_status_change",
    """SELECT suspect_id, CASE WHEN CAST(hcc_v28 AS INTEGER) % 3 = 0 THEN 'ON_HOLD' ELSE status END AS status FROM suspects""",
)
def _(f):
    updates = f.suspects.filter(F.col("hcc_v28").cast("int") % 3 == 0).select("suspect_id", F.lit("ON_HOLD").alias("new_status"))
    return review.set_status(f.suspects, updates).select("suspect_id", "status")


@query(
    "u9_review_history",
    """SELECT review_id, decision, CAST(reviewer_timestamp AS VARCHAR) AS reviewer_timestamp FROM reviews WHERE decision = 'NOT_SUPPORTED'
       ORDER BY reviewer_timestamp DESC, review_id LIMIT 20""",
)
def _(f):
    rows = review.filter_reviews(f.reviews, decision=" not_supported ")
    return review.page_of(rows, [F.desc("reviewer_timestamp"), F.col("review_id")]).select(
        "review_id", "decision", F.col("reviewer_timestamp").cast("string").alias("reviewer_timestamp")
    )
