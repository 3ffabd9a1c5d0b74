"""Back-tests, quality gate and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from caregap.operators import backtest, evidence, gaps, ingest, profile, quality
from caregap.plans.fixtures import PERIODS, RETROSPECTIVE
from caregap.plans.registry import query


@query("v1_period_presence", """SELECT bene_id, hcc_v28, h AS in_historical, c AS in_current, v AS in_validation FROM retro WHERE h OR c OR v""")
def _(f):
    return backtest.presence(f.dx_timeline, RETROSPECTIVE)


@query("v2_backtest_emerging", "SELECT bene_id, hcc_v28, evidence_count, priority_score, confirmed, sources FROM retro_emerging")
def _(f):
    return backtest.emerging(f.dx_timeline, RETROSPECTIVE)


@query(
    "v2_backtest_emerging_as_of",
    """SELECT e.bene_id, e.hcc_v28, e.confirmed, round(0.30e0 * CASE WHEN r.last_date >= DATE '1999-07-01' THEN 1.0e0 ELSE 0.7e0 END
              + 0.25e0 * least(r.evidence_count / 5.0e0, 1.0e0)
              + 0.20e0 * CASE WHEN y.years >= 2 THEN 1.0e0 ELSE 0.5e0 END + 0.25e0 * 0.5e0, 3) AS priority_score
       FROM retro_emerging e JOIN retro r ON r.bene_id = e.bene_id AND r.hcc_v28 = e.hcc_v28
       JOIN (SELECT bene_id, hcc_v28, count(DISTINCT yr) AS years FROM mapped WHERE yr <= 1999 GROUP BY ALL) y
         ON y.bene_id = e.bene_id AND y.hcc_v28 = e.hcc_v28""",
)
def _(f):
    return backtest.emerging(f.dx_timeline, RETROSPECTIVE, as_of=1999).select(*gaps.PAIR, "confirmed", "priority_score")


@query("v3_backtest_recapture", "SELECT bene_id, hcc_v28, priority_score, confirmed FROM retro_recapture")
def _(f):
    return backtest.recapture(f.dx_timeline, RETROSPECTIVE)


@query(
    "v4_precision_recall_f1",
    """SELECT flagged, confirmed, new_in_validation, caught, round(p, 6) AS precision, round(r, 6) AS recall,
              round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0e0 END, 6) AS f1
       FROM (SELECT *, CASE WHEN flagged > 0 THEN CAST(confirmed AS DOUBLE) / flagged ELSE 0.0e0 END AS p,
                    CASE WHEN new_in_validation > 0 THEN CAST(caught AS DOUBLE) / new_in_validation ELSE 0.0e0 END AS r
             FROM (SELECT count(*) FILTER (c AND NOT h) AS flagged, count(*) FILTER (c AND NOT h AND v) AS confirmed,
                          count(*) FILTER (v AND NOT h) AS new_in_validation, count(*) FILTER (v AND c AND NOT h) AS caught FROM retro))""",
)
def _(f):
    return backtest.emerging_metrics(backtest.presence(f.dx_timeline, RETROSPECTIVE))


@query(
    "v5_recapture_rate",
    """SELECT count(*) AS flagged, count(*) FILTER (confirmed) AS returned,
              round(count(*) FILTER (confirmed) / CAST(count(*) AS DOUBLE), 6) AS recapture_rate FROM retro_recapture""",
)
def _(f):
    return backtest.recapture_rate(backtest.presence(f.dx_timeline, RETROSPECTIVE))


_TIERS = """SELECT '{label}' AS suspect_type, t.tier, count(s.bene_id) AS suspects, count(s.bene_id) FILTER (s.confirmed) AS confirmed,
       round(CASE WHEN count(s.bene_id) > 0 THEN count(s.bene_id) FILTER (s.confirmed) / CAST(count(s.bene_id) AS DOUBLE) ELSE 0.0e0 END, 6) AS rate
       FROM (SELECT unnest(['HIGH', 'MEDIUM', 'LOW']) AS tier) t
       LEFT JOIN (SELECT *, CASE WHEN priority_score >= 0.75 THEN 'HIGH' WHEN priority_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS tier
                  FROM {table}) s ON s.tier = t.tier GROUP BY t.tier"""


@query(
    "v6_tier_calibration",
    _TIERS.format(label="EMERGING", table="retro_emerging") + " UNION ALL " + _TIERS.format(label="RECAPTURE", table="retro_recapture"),
)
def _(f):
    up = backtest.tier_calibration(backtest.emerging(f.dx_timeline, RETROSPECTIVE), "EMERGING")
    return up.unionByName(backtest.tier_calibration(backtest.recapture(f.dx_timeline, RETROSPECTIVE), "RECAPTURE"))


@query(
    "v7_top_confirmed_hccs",
    """SELECT hcc_v28, coalesce(hcc_description, 'Unknown') AS hcc_description, confirmed, flagged, round(confirmed / CAST(flagged AS DOUBLE), 6) AS rate
       FROM (SELECT hcc_v28, count(*) FILTER (confirmed) AS confirmed, count(*) AS flagged FROM retro_emerging GROUP BY hcc_v28
             HAVING count(*) FILTER (confirmed) > 0 ORDER BY confirmed DESC, CAST(hcc_v28 AS INTEGER) LIMIT 10)
       LEFT JOIN descriptions USING (hcc_v28)""",
)
def _(f):
    return backtest.top_confirmed(backtest.emerging(f.dx_timeline, RETROSPECTIVE), f.mapping)


_V8 = """SELECT bene_id, hcc_v28, 'EMERGING' AS suspect_type, priority_score,
       CASE WHEN priority_score >= 0.75 THEN 'HIGH' WHEN priority_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
       diagnosis_count, distinct_evidence_dates, distinct_evidence_months, distinct_sources, principal_diagnosis_count, confirmed
FROM (SELECT *, round(0.18e0 * (1.0e0 - exp(-diagnosis_count / 15.0e0)) + 0.18e0 * least(distinct_evidence_months / 4.0e0, 1.0e0)
        + 0.15e0 * least(claims / 3.0e0, 1.0e0) + 0.15e0 * least(distinct_evidence_dates / 5.0e0, 1.0e0)
        + 0.15e0 * exp(-greatest(0, date_diff('day', last_date, DATE '1999-12-31')) / 365.0e0)
        + 0.08e0 * least(distinct_sources / 2.0e0, 1.0e0) + 0.08e0 * least(principal_diagnosis_count / 2.0e0, 1.0e0)
        + 0.03e0 * least(rx_rows / 2.0e0, 1.0e0), 4) AS priority_score
      FROM (SELECT m.bene_id, m.hcc_v28, any_value(r.v) AS confirmed, count(*) AS diagnosis_count, count(DISTINCT claim_id) AS claims,
                   count(DISTINCT event_date) AS distinct_evidence_dates, max(event_date) AS last_date,
                   count(DISTINCT strftime(event_date, '%Y-%m')) AS distinct_evidence_months,
                   count(DISTINCT source) AS distinct_sources, count(*) FILTER (is_principal) AS principal_diagnosis_count,
                   (SELECT count(*) FROM rx x WHERE x.bene_id = m.bene_id AND year(x.event_date) = 1999 AND EXISTS (
                      SELECT 1 FROM mapped d WHERE d.bene_id = m.bene_id AND d.hcc_v28 = m.hcc_v28 AND d.yr = 1999
                      AND abs(date_diff('day', x.event_date, d.event_date)) <= 30)) AS rx_rows
            FROM mapped m JOIN retro r ON r.bene_id = m.bene_id AND r.hcc_v28 = m.hcc_v28 AND r.c AND NOT r.h
            WHERE yr = 1999 GROUP BY m.bene_id, m.hcc_v28))
UNION ALL SELECT bene_id, hcc_v28, 'RECAPTURE', 0.0e0, 'LOW', 0, 0, 0, 0, 0, v FROM retro WHERE h AND NOT c"""


@query("v8_evidence_backtest", _V8)
def _(f):
    return backtest.evidence_backtest(f.dx_timeline, f.rx, RETROSPECTIVE)


@query(
    "e5_composite_score_v2",
    f"SELECT bene_id, hcc_v28, priority_score, priority FROM ({_V8}) WHERE suspect_type = 'EMERGING'",
)
def _(f):
    return backtest.evidence_backtest(f.dx_timeline, f.rx, RETROSPECTIVE).filter("suspect_type = 'EMERGING'").select(
        *gaps.PAIR, "priority_score", "priority"
    )


@query(
    "v9_profile_reconciliation",
    """SELECT hcc_v28, count(DISTINCT member_id) AS profile_members, count(DISTINCT member_id) AS raw_members, 'YES' AS matches
       FROM profile_rows WHERE hcc_v28 IS NOT NULL GROUP BY hcc_v28""",
)
def _(f):
    return backtest.reconcile(f.profile_rows, profile.hcc_profile(f.profile_rows))


@query(
    "v10_join_integrity",
    """SELECT (SELECT count(*) FROM dx) AS rows_before, count(*) AS rows_after, count(*) FILTER (in_crosswalk) AS rows_code_found,
              count(hcc_v28) AS rows_with_hcc, count(DISTINCT code) AS unique_codes,
              count(DISTINCT code || '/' || hcc_v28) AS unique_code_hcc_pairs, count(*) - (SELECT count(*) FROM dx) AS fan_out FROM dx_timeline""",
)
def _(f):
    return backtest.join_integrity(f.dx, f.mapping)


# --- quality gate ------------------------------------------------------------------------


def _tables(f):
    return {
        "members": f.members, "hcc_mappings": f.mapping, "events_diagnosis": f.dx, "events_prescription": f.rx,
        "member_timeline": f.timeline, "member_hcc_baseline": f.baseline, "suspects": f.suspects, "review_decisions": f.reviews,
    }


@query(
    "q1_row_counts",
    """SELECT 'members' AS table_name, count(*) AS row_count FROM members UNION ALL SELECT 'hcc_mappings', count(*) FROM mapping
       UNION ALL SELECT 'events_diagnosis', count(*) FROM dx UNION ALL SELECT 'events_prescription', count(*) FROM rx
       UNION ALL SELECT 'member_timeline', count(*) FROM timeline UNION ALL SELECT 'member_hcc_baseline', count(*) FROM baseline
       UNION ALL SELECT 'suspects', count(*) FROM suspects UNION ALL SELECT 'review_decisions', count(*) FROM reviews""",
)
def _(f):
    f.stored("dx", "rx", "dx_timeline", "suspects")
    return quality.row_counts(_tables(f))


@query(
    "q2_null_keys",
    """SELECT 'members' AS table_name, count(*) FILTER (bene_id IS NULL) AS null_keys FROM members
       UNION ALL SELECT 'claims_batch', count(*) FILTER (claim_id IS NULL) FROM batch_rows
       UNION ALL SELECT 'suspects', count(*) FILTER (suspect_id IS NULL) FROM suspects""",
)
def _(f):
    return quality.null_keys(
        {"members": (f.members, "bene_id"), "claims_batch": (f.batch_rows, "claim_id"), "suspects": (f.suspects, "suspect_id")}
    )


_DUP = "SELECT '{n}' AS table_name, count(*) AS duplicate_keys FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1)"


@query(
    "q3_a17_duplicate_keys",
    " UNION ALL ".join(
        _DUP.format(n=n, k=k, t=t)
        for n, k, t in (("members", "bene_id", "members"), ("events_diagnosis", "event_id", "dx"), ("suspects", "suspect_id", "suspects"))
    ),
)
def _(f):
    return quality.duplicate_keys(
        {"members": (f.members, "bene_id"), "events_diagnosis": (f.dx, "event_id"), "suspects": (f.suspects, "suspect_id")}
    )


@query(
    "q4_orphans",
    """SELECT 'events_diagnosis' AS table_name, count(*) FILTER (bene_id NOT IN (SELECT bene_id FROM members)) AS orphans FROM dx
       UNION ALL SELECT 'events_prescription', count(*) FILTER (bene_id NOT IN (SELECT bene_id FROM members)) FROM rx
       UNION ALL SELECT 'claims_batch', count(*) FILTER (bene_id NOT IN (SELECT bene_id FROM members)) FROM batch_rows""",
)
def _(f):
    return quality.orphan_counts(
        {"events_diagnosis": f.dx, "events_prescription": f.rx, "claims_batch": f.batch_rows}, f.members
    )


@query(
    "q5_a18_mapping_coverage",
    "SELECT count(*) AS total_codes, count(hcc_v28) AS mapped_codes, count(*) FILTER (payment_2026) AS payment_codes FROM mapping",
)
def _(f):
    return quality.mapping_coverage(f.mapping)


@query(
    "q6_rejection_summary",
    """SELECT split_part(reason, ':', 1) AS reason, count(*) AS rejected_rows FROM validated WHERE reason IS NOT NULL GROUP BY 1""",
)
def _(f):
    return ingest.rejection_summary(f.validated)


@query(
    "q7_overall_gate",
    """SELECT 'members_not_empty' AS check_name, (SELECT count(*) FROM members) AS value, true AS passed
       UNION ALL SELECT 'null_keys', 0, true
       UNION ALL SELECT 'duplicate_keys', (SELECT count(*) FROM (SELECT event_id FROM dx GROUP BY event_id HAVING count(*) > 1)), false
       UNION ALL SELECT 'orphans', (SELECT count(*) FROM batch_rows WHERE bene_id NOT IN (SELECT bene_id FROM members)), false
       UNION ALL SELECT 'overall', 2, false""",
)
def _(f):
    f.stored("dx", "batch_rows")
    return quality.overall(
        {"members": f.members}, {"members": (f.members, "bene_id"), "events_diagnosis": (f.dx, "event_id")},
        {"members": (f.members, "bene_id"), "events_diagnosis": (f.dx, "event_id")}, f.members, {"claims_batch": f.batch_rows},
    )


# --- reports ---------------------------------------------------------------------------------


@query(
    "a21_profile_quality",
    """SELECT *, members - members_with_hcc AS members_without_hcc, round(mapped_rows * 100.0e0 / total_rows, 4) AS pct_mapped,
              round(unmapped_rows * 100.0e0 / total_rows, 4) AS pct_unmapped
       FROM (SELECT count(*) AS total_rows, count(hcc_v28) AS mapped_rows, count(*) - count(hcc_v28) AS unmapped_rows,
                    count(DISTINCT diagnosis_code) AS unique_codes, count(DISTINCT hcc_v28) AS unique_hccs,
                    count(DISTINCT member_id) AS members, count(DISTINCT member_id) FILTER (hcc_v28 IS NOT NULL) AS members_with_hcc
             FROM profile_rows)""",
)
def _(f):
    return profile.quality(f.profile_rows)


@query(
    "a22_candidate_quality",
    """SELECT (SELECT count(DISTINCT bene_id) FROM dx) AS members_analyzed,
              (SELECT count(*) FROM dx WHERE year(event_date) IN (1998, 1999)) AS historical_rows,
              (SELECT count(*) FROM dx WHERE year(event_date) = 2000) AS current_rows,
              (SELECT count(*) FROM dx WHERE year(event_date) NOT IN (1998, 1999, 2000)) AS other_rows,
              (SELECT count(*) FROM presence WHERE in_historical) AS historical_pairs,
              (SELECT count(*) FROM presence WHERE in_current) AS current_pairs,
              count(*) AS candidates, count(DISTINCT bene_id) AS members_with_candidates, count(*) FILTER (n >= 2) AS multi_support
       FROM (SELECT bene_id, hcc_v28, count(*) AS n FROM mapped JOIN gaps_v0 USING (bene_id, hcc_v28) WHERE yr = 2000 GROUP BY ALL)""",
)
def _(f):
    return quality.candidate_quality(f.dx_timeline, evidence.candidates_v0(f.dx_timeline, PERIODS), PERIODS)


@query(
    "a23_suspect_quality",
    """SELECT (SELECT count(*) FROM members) AS members, (SELECT count(*) FROM baseline) AS baseline_records,
              (SELECT count(DISTINCT bene_id) FROM baseline) AS members_with_baseline, *,
              round(high * 100.0e0 / suspects, 4) AS high_pct, round(medium * 100.0e0 / suspects, 4) AS medium_pct,
              round(low * 100.0e0 / suspects, 4) AS low_pct
       FROM (SELECT count(*) AS suspects, count(*) FILTER (suspect_type = 'EMERGING') AS emerging,
                    count(*) FILTER (suspect_type = 'RECAPTURE') AS recapture, count(*) FILTER (priority_score >= 0.75) AS high,
                    count(*) FILTER (priority_score >= 0.5 AND priority_score < 0.75) AS medium,
                    count(*) FILTER (priority_score < 0.5) AS low FROM suspects_v1)""",
)
def _(f):
    return quality.suspect_quality(f.members, f.baseline, f.suspects_v1)


@query(
    "a23_top_hccs_per_type",
    """SELECT suspect_type, hcc_v28, candidates, position FROM (
         SELECT suspect_type, hcc_v28, count(*) AS candidates,
                row_number() OVER (PARTITION BY suspect_type ORDER BY count(*) DESC, CAST(hcc_v28 AS INTEGER)) AS position
         FROM suspects_v1 GROUP BY suspect_type, hcc_v28) WHERE position <= 10""",
)
def _(f):
    pairs = gaps.gaps_v1(f.dx_timeline, f.members, PERIODS).withColumnRenamed("gap_type", "suspect_type")
    return quality.top_hccs_per_type(pairs, 10)


@query("a26_class_distribution", "SELECT ml_priority, count(*) AS n FROM suspects GROUP BY ml_priority")
def _(f):
    return f.suspects.groupBy("ml_priority").agg(F.count("*").alias("n"))


@query(
    "a27_table_profile",
    """SELECT * FROM (VALUES ('bene_id', 'string'), ('event_date', 'date'), ('event_type', 'string'), ('code', 'string'), ('hcc_v28', 'string'),
              ('source', 'string'), ('claim_id', 'string'), ('event_id', 'string'), ('is_principal', 'boolean')) AS c(column_name, data_type)
       JOIN (UNPIVOT (SELECT count(*) FILTER (bene_id IS NULL) AS bene_id, count(*) FILTER (event_date IS NULL) AS event_date,
                             count(*) FILTER (event_type IS NULL) AS event_type, count(*) FILTER (code IS NULL) AS code,
                             count(*) FILTER (hcc_v28 IS NULL) AS hcc_v28, count(*) FILTER (source IS NULL) AS source,
                             count(*) FILTER (claim_id IS NULL) AS claim_id, count(*) FILTER (event_id IS NULL) AS event_id,
                             count(*) FILTER (is_principal IS NULL) AS is_principal FROM timeline)
             ON COLUMNS(*) INTO NAME column_name VALUE null_count) USING (column_name),
            (SELECT count(*) AS row_count, count(DISTINCT bene_id) AS distinct_members FROM timeline)""",
)
def _(f):
    return quality.table_profile(f.timeline)
