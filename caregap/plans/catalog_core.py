"""Lookups, timeline, profiles, gaps, evidence and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from caregap.functions import clean, scores, text
from caregap.operators import evidence, gaps, intervals, lookup, profile, ranking, review
from caregap.operators import timeline as tl
from caregap.plans.fixtures import PERIODS
from caregap.plans.registry import query

PAIR, GAP = gaps.PAIR, evidence.GAP
SCORES = list(scores.EVIDENCE_WEIGHTS)
SCORES_SQL = ", ".join(SCORES)
COUNTS = [*evidence.FEATURES, "prescription_support_count"]
COUNTS_SQL = ", ".join(COUNTS)


def flat(c: str):
    return F.concat_ws("|", c).alias(c)


# --- reference loads and joins ----------------------------------------------------


@query(
    "s8_mapping_first_wins",
    """SELECT DISTINCT ON (diagnosis_code) diagnosis_code, description, nullif(hcc_v28, '') AS hcc_v28, payment_2026
       FROM repeated_mapping ORDER BY diagnosis_code, row_idx""",
)
def _(f):
    return lookup.crosswalk(f.repeated_mapping)


@query(
    "s9_mapping_last_wins",
    """SELECT DISTINCT ON (diagnosis_code) diagnosis_code, description, nullif(hcc_v28, '') AS hcc_v28, payment_2026
       FROM repeated_mapping ORDER BY diagnosis_code, row_idx DESC""",
)
def _(f):
    return lookup.crosswalk(f.repeated_mapping, last_wins=True)


@query(
    "j1_code_hcc_lookup",
    """SELECT bene_id, event_id, claim_id, event_date, code AS diagnosis_code, hcc_v28, in_crosswalk FROM dx_timeline""",
)
def _(f):
    return lookup.with_hcc(f.dx, f.mapping).select(
        "bene_id", "event_id", "claim_id", "event_date", "diagnosis_code", "hcc_v28", "in_crosswalk"
    )


@query(
    "j2_events_of_known_members",
    "SELECT row_idx, bene_id, claim_id FROM batch_rows WHERE bene_id IN (SELECT bene_id FROM members)",
)
def _(f):
    return lookup.of_members(f.batch_rows, f.members).select("row_idx", "bene_id", "claim_id")


@query(
    "j3_orphan_events",
    "SELECT row_idx, bene_id, claim_id FROM batch_rows WHERE bene_id NOT IN (SELECT bene_id FROM members)",
)
def _(f):
    return lookup.orphans(f.batch_rows, f.members).select("row_idx", "bene_id", "claim_id")


@query(
    "j4_hcc_descriptions",
    """SELECT bene_id, b.hcc_v28, coalesce(hcc_description, 'Unknown') AS hcc_description
       FROM baseline b LEFT JOIN descriptions USING (hcc_v28)""",
)
def _(f):
    return lookup.with_description(f.baseline, f.mapping).select("bene_id", "hcc_v28", "hcc_description")


@query("a28_first_description_per_hcc", "SELECT hcc_v28, hcc_description FROM descriptions")
def _(f):
    return f.descriptions


@query("j5_prescription_near_evidence", "SELECT bene_id, hcc_v28 FROM v1_rx")
def _(f):
    rx = f.rx.filter(clean.in_years(F.col("event_date"), [PERIODS.current]))
    days = gaps.diagnoses(f.dx_timeline).filter(clean.in_years(F.col("event_date"), [PERIODS.current]))
    return intervals.pairs_with_prescription(days.select(*PAIR, "event_date").distinct(), rx)


@query(
    "j6_prescription_support_set",
    "SELECT bene_id, hcc_v28, gap_type, prescription_support_count, prescription_drug_codes FROM v2_support",
)
def _(f):
    f.stored("dx_timeline")
    days = f.gap_events.select(*GAP, "event_date").distinct()
    rx = f.rx.filter(clean.in_years(F.col("event_date"), PERIODS.loaded_years))
    return intervals.support_and_drugs(days, rx, GAP).select(
        *GAP, "prescription_support_count", flat("prescription_drug_codes")
    )


@query(
    "j7_prescription_row_count",
    """SELECT e.bene_id, e.hcc_v28, count(*) AS rx_support_count
       FROM (SELECT DISTINCT bene_id, hcc_v28 FROM mapped WHERE yr = 2000) e
       JOIN rx r ON r.bene_id = e.bene_id AND year(r.event_date) = 2000
       WHERE EXISTS (SELECT 1 FROM mapped d WHERE d.bene_id = e.bene_id AND d.hcc_v28 = e.hcc_v28 AND d.yr = 2000
                     AND abs(date_diff('day', r.event_date, d.event_date)) <= 30)
       GROUP BY ALL""",
)
def _(f):
    current = clean.in_years(F.col("event_date"), [PERIODS.current])
    days = gaps.diagnoses(f.dx_timeline).filter(current).select(*PAIR, "event_date").distinct()
    return intervals.prescription_row_counts(days, f.rx.filter(current))


@query(
    "j9_latest_period_presence",
    "SELECT bene_id, hcc_v28, gap_type, latest_context IN ('CONTINUED', 'REAPPEARED') AS seen_latest FROM gaps_v2",
)
def _(f):
    seen = gaps.pair_presence(f.dx_timeline, PERIODS).filter("in_latest").select(*PAIR, F.lit(True).alias("seen_latest"))
    return f.gaps_v2.select(*GAP).join(seen, PAIR, "left").withColumn(
        "seen_latest", F.coalesce("seen_latest", F.lit(False))
    )


# --- timeline and profile -----------------------------------------------------------


@query(
    "r8_member_timeline",
    """SELECT bene_id, event_date, event_type, code, hcc_v28, source, claim_id, event_id, is_principal FROM timeline""",
)
def _(f):
    return f.timeline


@query(
    "r9_timeline_with_batch",
    """SELECT bene_id, event_date, 'diagnosis' AS event_type, code, hcc_v28, source, claim_id, event_id, is_principal
       FROM mapped WHERE event_date < DATE '2001-01-01'
       UNION ALL
       SELECT c.bene_id, c.claim_date, 'diagnosis', c.diagnosis_code, m.hcc_v28, c.source, c.claim_id,
              c.batch_id || ':' || c.claim_id, c.is_principal
       FROM batch_claims c JOIN mapping m ON m.diagnosis_code = c.diagnosis_code WHERE m.hcc_v28 IS NOT NULL""",
)
def _(f):
    return tl.with_batch(f.batch_history, f.batch_claims, f.mapping)


@query(
    "a19_timeline_coverage",
    """SELECT count(*) AS total_diagnoses, count(hcc_v28) AS mapped,
              count(*) FILTER (in_crosswalk AND hcc_v28 IS NULL) AS in_crosswalk_no_hcc,
              count(*) FILTER (NOT in_crosswalk) AS not_in_crosswalk FROM dx_timeline""",
)
def _(f):
    return tl.coverage(f.dx, f.mapping)


_PROFILE_SQL = """SELECT member_id, hcc_v28, count(*) AS supporting_diagnosis_count,
       string_agg(DISTINCT diagnosis_code, '|' ORDER BY diagnosis_code) AS unique_diagnosis_codes,
       min(diagnosis_date) AS first_diagnosis_date, max(diagnosis_date) AS last_diagnosis_date,
       max(payment_2026) AS payment_2026
       FROM profile_rows WHERE hcc_v28 IS NOT NULL GROUP BY member_id, hcc_v28"""


@query("a1_member_hcc_profile", _PROFILE_SQL)
def _(f):
    return profile.hcc_profile(f.profile_rows)


@query(
    "a2_unmapped_codes",
    """SELECT diagnosis_code, count(*) AS occurrence_count FROM profile_rows WHERE hcc_v28 IS NULL
       GROUP BY diagnosis_code""",
)
def _(f):
    return profile.unmapped_codes(f.profile_rows)


@query(
    "a3_baseline_profile",
    """SELECT bene_id, hcc_v28, any_value(coalesce(hcc_description, 'Unknown')) AS hcc_description,
              string_agg(DISTINCT code, '|' ORDER BY code) AS baseline_diagnosis_codes,
              count(DISTINCT claim_id) AS baseline_claim_count, min(event_date) AS first_baseline_date,
              max(event_date) AS last_baseline_date, string_agg(DISTINCT source, '|' ORDER BY source) AS sources
       FROM mapped LEFT JOIN descriptions USING (hcc_v28) WHERE yr IN (1998, 1999) GROUP BY bene_id, hcc_v28""",
)
def _(f):
    return evidence.baseline_profile(f.dx_timeline, f.mapping, PERIODS)


@query(
    "a4_period_conditional_evidence",
    """SELECT bene_id, hcc_v28, count(*) FILTER (yr < 2000) AS historical_count,
              count(*) FILTER (yr = 2000) AS current_count,
              coalesce(string_agg(DISTINCT code, '|' ORDER BY code) FILTER (yr = 2000), '') AS current_codes,
              min(event_date) FILTER (yr = 2000) AS current_first_date,
              max(event_date) FILTER (yr = 2000) AS current_last_date
       FROM mapped WHERE yr BETWEEN 1998 AND 2000 GROUP BY bene_id, hcc_v28""",
)
def _(f):
    return evidence.period_evidence(f.dx_timeline, PERIODS)


_FEATURES_SQL = """count(*) AS diagnosis_count, count(DISTINCT claim_id) AS unique_claim_count,
       count(DISTINCT event_id) AS unique_event_count, min(event_date) AS first_evidence_date,
       max(event_date) AS last_evidence_date, count(DISTINCT event_date) AS distinct_evidence_dates,
       count(DISTINCT strftime(event_date, '%Y-%m')) AS distinct_evidence_months,
       count(DISTINCT source) AS distinct_sources, count(*) FILTER (is_principal) AS principal_diagnosis_count,
       string_agg(DISTINCT code, '|' ORDER BY code) AS supporting_diagnosis_codes"""


@query("a5_evidence_features", f"SELECT bene_id, hcc_v28, gap_type, {_FEATURES_SQL} FROM gap_events GROUP BY bene_id, hcc_v28, gap_type")
def _(f):
    return evidence.evidence_features(f.gap_events, GAP).drop("evidence_days").withColumn(
        "supporting_diagnosis_codes", F.concat_ws("|", "supporting_diagnosis_codes")
    )


@query("a6_evidence_features_raw", f"SELECT bene_id, hcc_v28, {_FEATURES_SQL} FROM mapped WHERE yr = 2000 GROUP BY bene_id, hcc_v28")
def _(f):
    rows = gaps.diagnoses(f.dx_timeline).filter(clean.in_years(F.col("event_date"), [PERIODS.current]))
    return evidence.evidence_features(rows, PAIR, blanks_count=True).drop("evidence_days").withColumn(
        "supporting_diagnosis_codes", F.concat_ws("|", "supporting_diagnosis_codes")
    )


@query("a7_years_seen", "SELECT bene_id, hcc_v28, count(DISTINCT yr) AS years_seen FROM mapped GROUP BY bene_id, hcc_v28")
def _(f):
    return evidence.years_seen(f.dx_timeline)


@query(
    "a9_hcc_distribution",
    """SELECT hcc_v28, count(DISTINCT member_id) AS member_count, count(*) AS total_diagnosis_occurrences,
              string_agg(DISTINCT diagnosis_code, '|' ORDER BY diagnosis_code) AS unique_supporting_diagnosis_codes,
              max(payment_2026) AS payment_2026
       FROM profile_rows WHERE hcc_v28 IS NOT NULL GROUP BY hcc_v28""",
)
def _(f):
    return profile.hcc_distribution(f.profile_rows)


@query(
    "a10_code_frequencies",
    """SELECT a.hcc_v28, number_of_members, total_occurrences, supporting_diagnosis_codes
       FROM (SELECT hcc_v28, count(DISTINCT member_id) AS number_of_members, count(*) AS total_occurrences
             FROM profile_rows WHERE hcc_v28 IS NOT NULL GROUP BY hcc_v28) a
       JOIN (SELECT hcc_v28, string_agg(diagnosis_code || ':' || n, '|' ORDER BY n DESC, diagnosis_code)
                      AS supporting_diagnosis_codes
             FROM (SELECT hcc_v28, diagnosis_code, count(*) AS n FROM profile_rows WHERE hcc_v28 IS NOT NULL GROUP BY ALL)
             GROUP BY hcc_v28) b ON a.hcc_v28 = b.hcc_v28""",
)
def _(f):
    return profile.code_frequencies(f.profile_rows)


@query("a11_candidates_by_hcc", "SELECT hcc_v28, count(*) AS candidates FROM gaps_v0 GROUP BY hcc_v28")
def _(f):
    return gaps.emerging_v0(f.dx_timeline, PERIODS).groupBy("hcc_v28").agg(F.count("*").alias("candidates"))


# --- gaps --------------------------------------------------------------------------------


@query("g1_emerging_v0", "SELECT bene_id, hcc_v28 FROM gaps_v0")
def _(f):
    return gaps.emerging_v0(f.dx_timeline, PERIODS)


@query(
    "g1_candidates_v0",
    """SELECT bene_id, hcc_v28, string_agg(DISTINCT code, '|' ORDER BY code) AS supporting_diagnosis_codes,
              count(*) AS evidence_count, min(event_date) AS first_evidence_date, max(event_date) AS last_evidence_date,
              'PENDING_REVIEW' AS status
       FROM mapped JOIN gaps_v0 USING (bene_id, hcc_v28) WHERE yr = 2000 GROUP BY bene_id, hcc_v28""",
)
def _(f):
    return evidence.candidates_v0(f.dx_timeline, PERIODS)


@query(
    "g1_candidate_claim_lists",
    """SELECT bene_id, hcc_v28, claim_id, row_number() OVER (PARTITION BY bene_id, hcc_v28 ORDER BY claim_id) AS position
       FROM (SELECT DISTINCT bene_id, hcc_v28, claim_id FROM mapped JOIN gaps_v0 USING (bene_id, hcc_v28) WHERE yr = 2000)""",
)
def _(f):
    return evidence.claim_lists(f.dx_timeline, gaps.emerging_v0(f.dx_timeline, PERIODS), PERIODS)


@query("g2_emerging_v1", "SELECT bene_id, hcc_v28 FROM suspects_v1 WHERE suspect_type = 'EMERGING'")
def _(f):
    return gaps.gaps_v1(f.dx_timeline, f.members, PERIODS).filter("gap_type = 'EMERGING'").select(*PAIR)


@query("g3_recapture_v1", "SELECT bene_id, hcc_v28 FROM suspects_v1 WHERE suspect_type = 'RECAPTURE'")
def _(f):
    return gaps.gaps_v1(f.dx_timeline, f.members, PERIODS).filter("gap_type = 'RECAPTURE'").select(*PAIR)


@query("g4_gaps_v2", "SELECT bene_id, hcc_v28, gap_type, status, latest_context FROM gaps_v2")
def _(f):
    return gaps.gaps_v2(f.dx_timeline, f.baseline, PERIODS)


@query("g5_member_hcc_pairs", "SELECT DISTINCT bene_id, hcc_v28 FROM mapped WHERE yr = 2000")
def _(f):
    return gaps.pair_presence(f.dx_timeline, PERIODS).filter("in_current").select(*PAIR)


@query("g6_baseline_pairs", "SELECT bene_id, hcc_v28 FROM baseline")
def _(f):
    return f.baseline


@query("g7_members_in_any_period", "SELECT DISTINCT bene_id FROM mapped WHERE yr BETWEEN 1998 AND 2001")
def _(f):
    return gaps.members_in_any_period(f.dx_timeline, PERIODS)


@query(
    "g8_period_intersection",
    """SELECT count(*) AS n FROM (
         (SELECT bene_id, hcc_v28 FROM mapped WHERE yr = 2001 EXCEPT SELECT bene_id, hcc_v28 FROM mapped WHERE yr IN (1998, 1999))
         INTERSECT
         (SELECT bene_id, hcc_v28 FROM mapped WHERE yr = 2000 EXCEPT SELECT bene_id, hcc_v28 FROM mapped WHERE yr IN (1998, 1999)))""",
)
def _(f):
    flags = gaps.pair_presence(f.dx_timeline, PERIODS)
    return flags.agg(F.count_if(F.expr("in_latest AND in_current AND NOT in_historical")).alias("n"))


@query("g9_members_without_hcc", "SELECT bene_id FROM members WHERE bene_id NOT IN (SELECT bene_id FROM mapped)")
def _(f):
    return gaps.members_without_hcc(f.members, f.dx_timeline)


@query(
    "g10_batch_periods",
    """SELECT CAST(max(year(claim_date)) AS INTEGER) AS current_year, CAST(max(year(claim_date)) - 2 AS INTEGER) AS first_year,
              CAST(max(year(claim_date)) - 1 AS INTEGER) AS last_year, make_date(max(year(claim_date)), 12, 31) AS reference_date
       FROM batch_claims""",
)
def _(f):
    p = evidence.batch_periods(f.batch_claims)
    return f.batch_claims.limit(1).select(
        F.lit(p.current).alias("current_year"), F.lit(min(p.historical)).alias("first_year"),
        F.lit(max(p.historical)).alias("last_year"), F.lit(p.reference_date).alias("reference_date"),
    )


# --- scoring -------------------------------------------------------------------------------

_V1_COLUMNS = [
    "bene_id", "hcc_v28", "hcc_description", "suspect_type", "supporting_diagnosis_codes", "evidence_count",
    "first_evidence_date", "last_evidence_date", "sources", "has_prescription_support", "recency_score",
    "frequency_score", "persistence_score", "diversity_score", "priority_score", "status",
]


def _v1_sql(kind: str | None = None) -> str:
    where = f" WHERE suspect_type = '{kind}'" if kind else ""
    return f"SELECT {', '.join(_V1_COLUMNS)} FROM suspects_v1{where}"


@query("suspects_v1", _v1_sql())
def _(f):
    return f.suspects_v1


@query("e1_emerging_scores_v1", _v1_sql("EMERGING"))
def _(f):
    return f.suspects_v1.filter("suspect_type = 'EMERGING'")


@query("e2_recapture_scores_v1", _v1_sql("RECAPTURE"))
def _(f):
    return f.suspects_v1.filter("suspect_type = 'RECAPTURE'")


_E3_ROWS = """SELECT 'SUSP_' || printf('%07d', row_number() OVER (ORDER BY s.bene_id, s.suspect_type, CAST(s.hcc_v28 AS INTEGER)))
         AS suspect_id, s.bene_id, s.hcc_v28, s.suspect_type, supporting_diagnosis_codes, supporting_claim_ids, evidence_count,
       CASE WHEN has_prescription_support THEN 'True' ELSE 'False' END AS has_prescription_support,
       printf('%.2f', recency_score) AS recency_score, printf('%.2f', frequency_score) AS frequency_score,
       printf('%.2f', persistence_score) AS persistence_score, printf('%.2f', diversity_score) AS diversity_score,
       printf('%.3f', priority_score) AS priority_score, status
FROM suspects_v1 s JOIN (
  SELECT bene_id, hcc_v28, array_to_string(list_sort(list(DISTINCT claim_id))[1:10], '|') AS supporting_claim_ids
  FROM mapped WHERE yr BETWEEN 1998 AND 2000 GROUP BY ALL) c ON c.bene_id = s.bene_id AND c.hcc_v28 = s.hcc_v28"""


@query("e3_suspect_rows_v1", _E3_ROWS)
def _(f):
    samples = evidence.claim_samples(f.dx_timeline, f.suspects_v1, PERIODS, 10)
    return evidence.suspect_rows_v1(f.suspects_v1, samples).drop(
        "hcc_description", "first_evidence_date", "last_evidence_date", "sources"
    )


@query(
    "w2_sequence_ids",
    """SELECT bene_id, hcc_v28, suspect_type, 'SUSP_' || printf('%07d', row_number() OVER (
         ORDER BY bene_id, suspect_type, CAST(hcc_v28 AS INTEGER))) AS suspect_id FROM suspects_v1""",
)
def _(f):
    return ranking.sequence_suspects(
        gaps.gaps_v1(f.dx_timeline, f.members, PERIODS).withColumnRenamed("gap_type", "suspect_type")
    )


@query(
    "e4_components_v2",
    f"SELECT bene_id, hcc_v28, gap_type, {COUNTS_SQL}, first_evidence_date, last_evidence_date, {SCORES_SQL} FROM v2_scored",
)
def _(f):
    return f.suspects_v2.select(*GAP, *COUNTS, "first_evidence_date", "last_evidence_date", *SCORES)


@query("e7_latest_context", "SELECT bene_id, hcc_v28, gap_type, latest_context FROM gaps_v2")
def _(f):
    return f.gaps_v2.select(*GAP, "latest_context")


@query("e8_reason_flags", "SELECT bene_id, hcc_v28, gap_type, reason_flags FROM suspects_v2")
def _(f):
    return f.suspects_v2.select(*GAP, flat("reason_flags"))


@query("e9_evidence_summary", "SELECT bene_id, hcc_v28, gap_type, evidence_summary FROM suspects_v2")
def _(f):
    return f.suspects_v2.select(*GAP, "evidence_summary")


@query(
    "suspects_v2",
    f"""SELECT bene_id, hcc_v28, hcc_description, gap_type, gap_type AS suspect_type, status, latest_context, {COUNTS_SQL},
               first_evidence_date, last_evidence_date, supporting_diagnosis_codes, {SCORES_SQL}, reason_flags, evidence_summary
        FROM suspects_v2""",
)
def _(f):
    return f.suspects_v2.select(
        *PAIR, "hcc_description", "gap_type", "suspect_type", "status", "latest_context", *COUNTS, "first_evidence_date",
        "last_evidence_date", flat("supporting_diagnosis_codes"), *SCORES, flat("reason_flags"), "evidence_summary",
    )


@query(
    "r10_deduplicated_events",
    """SELECT bene_id, event_date, hcc_v28, claim_id, code, event_id, min(source) AS source,
              bool_or(is_principal) AS is_principal
       FROM mapped GROUP BY bene_id, event_date, hcc_v28, claim_id, code, event_id""",
)
def _(f):
    return evidence.deduplicate_events(gaps.diagnoses(f.dx_timeline))


@query(
    "e10_evidence_references",
    """SELECT bene_id, hcc_v28, gap_type, event_id, claim_id, event_date AS evidence_date, code AS diagnosis_code, source,
              is_principal FROM gap_events""",
)
def _(f):
    return evidence.evidence_references(f.gap_events)


_REFERENCES = """SELECT DISTINCT bene_id, hcc_v28, gap_type, event_id, claim_id, event_date AS evidence_date, code AS diagnosis_code,
       source, is_principal FROM gap_events"""
_ORDER = "evidence_date, event_id, claim_id, diagnosis_code, source, is_principal"


@query(
    "e10_numbered_references",
    f"SELECT *, row_number() OVER (PARTITION BY bene_id, hcc_v28, gap_type ORDER BY {_ORDER}) AS position FROM ({_REFERENCES})",
)
def _(f):
    return evidence.numbered_references(evidence.evidence_references(f.gap_events))


@query(
    "e10_references_of_hot_gaps",
    f"""SELECT *, row_number() OVER (PARTITION BY region ORDER BY {_ORDER}) AS position
        FROM (SELECT DISTINCT right(bene_id, 1) AS region, * EXCLUDE (bene_id, hcc_v28, gap_type) FROM ({_REFERENCES}))""",
)
def _(f):
    """All references under ten ids, so that every group is far above any page: the layout and order stay the same."""
    rows = evidence.evidence_references(f.gap_events).withColumn("region", F.right("bene_id", F.lit(1))).drop(*GAP).distinct()
    return evidence.numbered_references(rows, ["region"])


@query(
    "e10_nested_references",
    """SELECT bene_id, hcc_v28, gap_type, count(*) AS refs, string_agg(event_id, '|' ORDER BY event_date, event_id, claim_id, code) AS event_ids
       FROM gap_events GROUP BY bene_id, hcc_v28, gap_type""",
)
def _(f):
    rows = evidence.nested(evidence.evidence_references(f.gap_events), GAP, evidence.reference_struct(), "evidence_references")
    return rows.select(
        *GAP, F.size("evidence_references").cast("bigint").alias("refs"),
        F.concat_ws("|", F.transform("evidence_references", lambda r: r["event_id"])).alias("event_ids"),
    )


@query(
    "s11_suspect_rows_v2",
    f"""SELECT s.bene_id, s.hcc_v28, s.hcc_description, s.gap_type, s.gap_type AS suspect_type, s.status, s.latest_context,
               {", ".join(f"s.{c}" for c in COUNTS)}, s.first_evidence_date, s.last_evidence_date, s.supporting_diagnosis_codes,
               coalesce(s.prescription_drug_codes, '') AS prescription_drug_codes, c.claim_count, c.reference_count,
               {", ".join(f"s.{c}" for c in SCORES)}, s.reason_flags, s.evidence_summary
       FROM suspects_v2 s JOIN (SELECT bene_id, hcc_v28, gap_type, count(DISTINCT claim_id) AS claim_count,
                                       count(*) AS reference_count FROM gap_events GROUP BY bene_id, hcc_v28, gap_type) c
         ON c.bene_id = s.bene_id AND c.hcc_v28 = s.hcc_v28 AND c.gap_type = s.gap_type""",
)
def _(f):
    rx = f.rx.filter(clean.in_years(F.col("event_date"), PERIODS.loaded_years))
    rows = evidence.suspect_rows_v2(f.suspects_v2, evidence.evidence_references(f.gap_events), rx)
    lists = ("supporting_diagnosis_codes", "prescription_drug_codes", "reason_flags")
    return rows.select(*[flat(c) if c in lists else c for c in rows.columns if c not in SCORES], *SCORES)


@query(
    "s11_suspect_claims",
    """SELECT bene_id, hcc_v28, gap_type, claim_id, row_number() OVER (PARTITION BY bene_id, hcc_v28, gap_type ORDER BY claim_id) AS position
       FROM (SELECT DISTINCT bene_id, hcc_v28, gap_type, claim_id FROM gap_events)""",
)
def _(f):
    return evidence.gap_claims(evidence.evidence_references(f.gap_events))


@query(
    "s13_payload_records",
    f"""SELECT bene_id, hcc_v28, gap_type, CAST(0 AS BIGINT) AS position, latest_context, evidence_summary AS summary, diagnosis_count,
               NULL AS event_id, '1.0' AS schema_version FROM suspects_v2
        UNION ALL SELECT bene_id, hcc_v28, gap_type, row_number() OVER (PARTITION BY bene_id, hcc_v28, gap_type ORDER BY {_ORDER}), NULL, NULL,
               NULL, event_id, '1.0' FROM ({_REFERENCES})""",
)
def _(f):
    rows = evidence.payload_rows(f.suspects_v2, evidence.evidence_references(f.gap_events))
    parsed = F.from_json(
        "input_payload",
        "latest_context string, summary string, evidence struct<diagnosis_count: bigint>, reference struct<event_id: string>",
    )
    return rows.withColumn("p", parsed).select(
        *GAP, "position", "p.latest_context", "p.summary", "p.evidence.diagnosis_count", "p.reference.event_id",
        F.lit(text.ENVELOPE["schema_version"]).alias("schema_version"),
    )


@query(
    "e12_reviewer_narrative",
    """SELECT bene_id, hcc_v28, gap_type, gap_type || ' Gap: ' || lbl AS summary_title,
       CASE gap_type WHEN 'EMERGING' THEN 'Beneficiary ' || bene_id || ' presents with an Emerging Documentation Gap for ' || lbl
            || '. This condition was not documented in the historical 2-year baseline profile and has newly emerged in current claims.'
            ELSE 'Beneficiary ' || bene_id || ' has a documented historical baseline for ' || lbl
            || ' that requires annual recapture. Current claims evidence shows active persistence supporting continued risk adjustment documentation.' END
       || ' Evaluated with ' || priority || ' priority (Score: ' || printf('%.2f', priority_score) || '). Atomic evidence includes '
       || diagnosis_count || ' diagnosis event(s) (ICD-10: ' || codes || ') from ' || first_evidence_date || ' to ' || last_evidence_date
       || ' via ' || sources || '.' || CASE WHEN prescription_support_count > 0 THEN ' Part D therapy is actively aligned with '
          || prescription_support_count || ' fill(s).' ELSE '' END AS clinical_narrative,
       concat_ws(' / ', 'Documented across ' || diagnosis_count || ' diagnosis event(s) across ' || unique_claim_count
          || ' unique claim(s) between ' || first_evidence_date || ' and ' || last_evidence_date || '.',
          'Encounters identified across clinical care settings: ' || sources || '.',
          CASE WHEN principal_diagnosis_count > 0 THEN 'Recorded as Principal Inpatient Diagnosis in ' || principal_diagnosis_count
               || ' encounter(s), indicating high clinical acuity.' END,
          CASE WHEN prescription_support_count > 0 THEN 'Supported by ' || prescription_support_count
               || ' matching Part D pharmacy fill(s) demonstrating active medical management.'
               ELSE 'No concurrent Part D pharmacy fills detected for direct disease management.' END) AS evidence_breakdown,
       concat_ws(' / ', 'Verify clinical encounter notes signed by a qualified provider for ICD-10 code(s): ' || codes || '.',
          'Confirm active management, evaluation, assessment, or treatment (MEAT criteria) during encounters dated '
          || first_evidence_date || ' to ' || last_evidence_date || '.',
          'Check face-to-face provider documentation status for CMS-HCC V28 risk adjustment compliance.') AS verification_checklist
       FROM (SELECT s.*, coalesce(hcc_description, 'Unknown') || ' (HCC ' || hcc_v28 || ')' AS lbl, replace(supporting_diagnosis_codes, '|', ', ') AS codes,
                    (SELECT string_agg(DISTINCT source, '|' ORDER BY source) FROM batch_events e WHERE e.bene_id = s.bene_id
                     AND e.hcc_v28 = s.hcc_v28 AND e.gap_type = s.gap_type) AS sources
             FROM batch_suspects s LEFT JOIN descriptions USING (hcc_v28))""",
)
def _(f):
    combined = tl.with_batch(f.batch_history, f.batch_claims, f.mapping)
    from caregap.plans.fixtures import BATCH

    refs = evidence.evidence_references(evidence.gap_events(combined, f.batch_suspects, BATCH))
    rows = evidence.narratives(f.batch_suspects.join(evidence.gap_sources(refs), GAP, "left"))
    return rows.select(
        *GAP, "summary_title", "clinical_narrative",
        F.concat_ws(" / ", "evidence_breakdown").alias("evidence_breakdown"),
        F.concat_ws(" / ", "verification_checklist").alias("verification_checklist"),
    )


@query(
    "e14_gap_sources",
    """SELECT bene_id, hcc_v28, gap_type, string_agg(DISTINCT source, '|' ORDER BY source) AS sources
       FROM gap_events GROUP BY bene_id, hcc_v28, gap_type""",
)
def _(f):
    return evidence.gap_sources(evidence.evidence_references(f.gap_events))


# --- ranking ---------------------------------------------------------------------------------


@query(
    "w3_review_ranking",
    """SELECT bene_id, hcc_v28, gap_type, evidence_strength_score, gap_urgency_score, review_priority_score, review_rank,
              review_rank <= 100 AS review_queue, 'NOT_AVAILABLE' AS severity_reference_status FROM ranked""",
)
def _(f):
    return ranking.rank_candidates(f.suspects_v2).select(
        *GAP, "evidence_strength_score", "gap_urgency_score", "review_priority_score", "review_rank", "review_queue",
        "severity_reference_status",
    )


@query(
    "w3_top_100_queue",
    "SELECT bene_id, hcc_v28, gap_type, review_priority_score FROM ranked WHERE review_rank <= 100",
)
def _(f):
    scored = ranking.review_scores(f.suspects_v2)
    return ranking.top_k(scored, ranking.review_order(), ranking.QUEUE_SIZE).select(*GAP, "review_priority_score")


@query(
    "j10_severity_reference",
    """SELECT bene_id, hcc_v28, gap_type, round(s.severity_level / 5.0e0, 6) AS severity_score,
              'AVAILABLE' AS severity_reference_status,
              round_even(10000.0e0 * (0.65e0 * evidence_strength_score + (1.0e0 - 0.65e0 - 0.20e0) * gap_urgency_score
                    + 0.20e0 * (s.severity_level / 5.0e0)), 0) / 10000.0e0 AS review_priority_score
       FROM ranked LEFT JOIN severity s USING (hcc_v28)""",
)
def _(f):
    return ranking.review_scores(f.suspects_v2, f.severity, use_severity=True).select(
        *GAP, F.round("severity_score", 6).alias("severity_score"), "severity_reference_status", "review_priority_score"
    )


@query(
    "w1_numeric_hcc_order",
    """SELECT hcc_v28, CAST(row_number() OVER (ORDER BY coalesce(TRY_CAST(hcc_v28 AS INTEGER), 999), hcc_v28) AS BIGINT) AS place
       FROM (SELECT hcc_v28 FROM severity UNION ALL SELECT p_brand FROM part GROUP BY p_brand)""",
)
def _(f):
    brands = f.table("part").select(F.col("p_brand").alias("hcc_v28")).distinct()
    values = f.severity.select("hcc_v28").unionByName(brands)
    return ranking.global_rank(values, [clean.hcc_order(F.col("hcc_v28")), F.col("hcc_v28")], "place")


@query(
    "w6_top_hccs",
    """SELECT hcc_v28, count(*) AS members FROM (SELECT DISTINCT bene_id, hcc_v28 FROM mapped) GROUP BY hcc_v28
       ORDER BY members DESC, CAST(hcc_v28 AS INTEGER) LIMIT 15""",
)
def _(f):
    pairs = gaps.diagnoses(f.dx_timeline).select(*PAIR).distinct()
    counts = pairs.groupBy("hcc_v28").agg(F.count("*").alias("members"))
    return ranking.top_k(counts, [F.desc("members"), clean.hcc_order(F.col("hcc_v28"))], 15)


@query(
    "w7_top_codes_per_hcc",
    """SELECT hcc_v28, diagnosis_code, n, position FROM (
         SELECT hcc_v28, diagnosis_code, count(*) AS n,
                row_number() OVER (PARTITION BY hcc_v28 ORDER BY count(*) DESC, diagnosis_code) AS position
         FROM profile_rows WHERE hcc_v28 IS NOT NULL GROUP BY hcc_v28, diagnosis_code) WHERE position <= 5""",
)
def _(f):
    return profile.top_codes(f.profile_rows, 5)


_SAMPLE_SQL = """(SELECT bene_id AS member_id, row_number() OVER (ORDER BY bene_id) - 1 AS pos, count(*) OVER () AS n
       FROM members)"""


@query(
    "w13_evenly_spaced_members",
    f"""SELECT member_id, pos AS sample_position FROM {_SAMPLE_SQL}
        WHERE pos IN (SELECT CAST(floor(i * (n - 1) / 9.0e0) AS BIGINT) FROM (SELECT unnest(range(10)) AS i), (SELECT count(*) AS n FROM members))""",
)
def _(f):
    members = f.members.select(F.col("bene_id").alias("member_id"))
    return ranking.evenly_spaced(members, [F.col("member_id")], 10)


_EVEN = f"""(SELECT member_id FROM {_SAMPLE_SQL} WHERE pos IN (
         SELECT CAST(floor(i * (n - 1) / 9.0e0) AS BIGINT) FROM (SELECT unnest(range(10)) AS i), (SELECT count(*) AS n FROM members)))"""


@query(
    "a24_sample_member_codes",
    f"""SELECT member_id, count(DISTINCT diagnosis_code) AS unique_diagnosis_codes, count(diagnosis_code) AS diagnosis_occurrences,
               count(DISTINCT hcc_v28) AS mapped_hcc_count,
               coalesce(string_agg(DISTINCT hcc_v28, '|' ORDER BY hcc_v28), '') AS mapped_hcc_categories
        FROM {_EVEN} LEFT JOIN profile_rows USING (member_id) GROUP BY member_id""",
)
def _(f):
    members = f.members.select(F.col("bene_id").alias("member_id"))
    return profile.member_code_counts(f.profile_rows, ranking.evenly_spaced(members, [F.col("member_id")], 10))


@query(
    "w14_member_trace",
    f"""SELECT member_id, diagnosis_code, coalesce(hcc_v28, '(unmapped)') AS hcc_v28, count(*) AS occurrences
        FROM profile_rows WHERE member_id IN (SELECT member_id FROM {_SAMPLE_SQL} WHERE pos IN (100, 500, 1000, 2500, least(4999, n - 1)))
        GROUP BY ALL""",
)
def _(f):
    members = f.members.select(F.col("bene_id").alias("member_id"))
    positions = [100, 500, 1000, 2500, min(4999, members.count() - 1)]
    return profile.member_trace(f.profile_rows, ranking.at_positions(members, [F.col("member_id")], positions))


@query(
    "w5_categorical_sort",
    """SELECT bene_id, hcc_v28, ml_priority, priority_score, evidence_count FROM suspects
       ORDER BY CASE ml_priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, priority_score DESC, evidence_count DESC""",
)
def _(f):
    rank = F.when(F.col("ml_priority") == "HIGH", 0).when(F.col("ml_priority") == "MEDIUM", 1).otherwise(2)
    return f.suspects.select(*PAIR, "ml_priority", "priority_score", "evidence_count").orderBy(
        rank, F.desc("priority_score"), F.desc("evidence_count"), "bene_id"
    )


@query(
    "a30_members_with_opportunities",
    "SELECT bene_id, count(*) AS suspects FROM suspects GROUP BY bene_id ORDER BY bene_id LIMIT 10",
)
def _(f):
    return review.members_with_opportunities(
        gaps.gaps_v1(f.dx_timeline, f.members, PERIODS), 10
    )
