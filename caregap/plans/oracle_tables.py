"""Fixture tables as DuckDB SQL, in dependency order; the DataFrame form is in ``fixtures``."""

TABLES: dict[str, str] = {}

TABLES["members"] = """
SELECT 'B' || printf('%08d', c_custkey) AS bene_id,
       DATE '1925-01-01' + CAST(c_custkey % 20000 AS INTEGER) AS birth_date,
       CASE WHEN c_custkey % 2 = 0 THEN '2' ELSE '1' END AS sex, c_mktsegment AS race, n_name AS state
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

TABLES["raw_mapping"] = """
SELECT p_partkey AS row_idx, 'D' || printf('%06d', p_partkey) AS diagnosis_code, p_name AS description,
       CASE WHEN p_size <= 30 THEN CAST(p_size AS VARCHAR) ELSE '' END AS hcc_v28,
       p_size % 2 = 0 AS payment_2026
FROM part"""

TABLES["mapping"] = """
SELECT diagnosis_code, description, nullif(hcc_v28, '') AS hcc_v28, payment_2026 FROM raw_mapping"""

TABLES["repeated_mapping"] = """
SELECT row_idx, 'D' || printf('%06d', row_idx // 3) AS diagnosis_code, description, hcc_v28, payment_2026
FROM raw_mapping"""

TABLES["descriptions"] = """
SELECT hcc_v28, arg_min(description, diagnosis_code) AS hcc_description
FROM mapping WHERE hcc_v28 IS NOT NULL AND description IS NOT NULL GROUP BY hcc_v28"""

TABLES["dx"] = """
SELECT 'B' || printf('%08d', o_custkey) AS bene_id,
       source || '_' || l_orderkey || '_' || l_linenumber AS event_id,
       CAST(l_orderkey AS VARCHAR) AS claim_id, CAST(o_orderdate AS DATE) AS event_date, source,
       'D' || printf('%06d', l_partkey) AS diagnosis_code, l_linenumber = 1 AS is_principal
FROM lineitem JOIN (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'INPATIENT' WHEN 'O' THEN 'OUTPATIENT'
                              ELSE 'CARRIER' END AS source FROM orders) ON l_orderkey = o_orderkey"""

TABLES["rx"] = """
SELECT DISTINCT 'B' || printf('%08d', o_custkey) AS bene_id,
       'PDE_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS event_id,
       l_orderkey || '_' || l_linenumber || '_' || l_partkey AS pde_id,
       CAST(l_shipdate AS DATE) AS event_date, CAST(l_suppkey AS VARCHAR) AS drug_code
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"""

TABLES["dx_timeline"] = """
SELECT d.bene_id, d.event_date, 'diagnosis' AS event_type, d.diagnosis_code AS code, m.hcc_v28, d.source, d.claim_id,
       d.event_id, d.is_principal, m.diagnosis_code IS NOT NULL AS in_crosswalk
FROM dx d LEFT JOIN mapping m ON m.diagnosis_code = d.diagnosis_code"""

TABLES["timeline"] = """
SELECT bene_id, event_date, event_type, code, hcc_v28, source, claim_id, event_id, is_principal FROM dx_timeline
UNION ALL
SELECT bene_id, event_date, 'prescription', drug_code, NULL, 'PDE', pde_id, event_id, NULL FROM rx"""

TABLES["mapped"] = "SELECT *, year(event_date) AS yr FROM dx_timeline WHERE hcc_v28 IS NOT NULL"

TABLES["profile_rows"] = """
SELECT d.bene_id AS member_id, d.diagnosis_code, m.hcc_v28,
       CASE WHEN m.hcc_v28 IS NOT NULL AND m.payment_2026 THEN 'Yes' ELSE 'No' END AS payment_2026,
       d.event_date AS diagnosis_date, d.is_principal
FROM dx d LEFT JOIN mapping m ON m.diagnosis_code = d.diagnosis_code"""

TABLES["presence"] = """
SELECT bene_id, hcc_v28, bool_or(yr IN (1998, 1999)) AS in_historical, bool_or(yr = 2000) AS in_current,
       bool_or(yr = 2001) AS in_latest
FROM mapped WHERE yr BETWEEN 1998 AND 2001 GROUP BY ALL"""

TABLES["baseline"] = "SELECT bene_id, hcc_v28 FROM presence WHERE in_historical"

TABLES["gaps_v0"] = "SELECT bene_id, hcc_v28 FROM presence WHERE in_current AND NOT in_historical"

TABLES["v1_rx"] = """
SELECT DISTINCT e.bene_id, e.hcc_v28 FROM (SELECT DISTINCT bene_id, hcc_v28, event_date FROM mapped WHERE yr = 2000) e
JOIN rx r ON r.bene_id = e.bene_id AND year(r.event_date) = 2000
         AND abs(date_diff('day', r.event_date, e.event_date)) <= 30"""

TABLES["v1_pairs"] = """
SELECT bene_id, hcc_v28, bool_or(yr IN (1998, 1999)) AS h, bool_or(yr = 2000) AS c,
       string_agg(DISTINCT code, '|' ORDER BY code) FILTER (yr BETWEEN 1998 AND 2000) AS supporting_diagnosis_codes,
       count(*) FILTER (yr BETWEEN 1998 AND 2000) AS evidence_count,
       min(event_date) FILTER (yr BETWEEN 1998 AND 2000) AS first_evidence_date,
       max(event_date) FILTER (yr BETWEEN 1998 AND 2000) AS last_evidence_date,
       string_agg(DISTINCT source, '|' ORDER BY source) FILTER (yr BETWEEN 1998 AND 2000) AS sources,
       count(DISTINCT yr) AS years_seen
FROM mapped GROUP BY bene_id, hcc_v28"""

TABLES["v1_scored"] = """
SELECT p.bene_id, p.hcc_v28, coalesce(hcc_description, 'Unknown') AS hcc_description,
       CASE WHEN c THEN 'EMERGING' ELSE 'RECAPTURE' END AS suspect_type, supporting_diagnosis_codes, evidence_count,
       first_evidence_date, last_evidence_date, sources, c AND x.bene_id IS NOT NULL AS has_prescription_support,
       CASE WHEN c THEN CASE WHEN last_evidence_date >= DATE '2000-07-01' THEN 1.0e0
                             WHEN last_evidence_date >= DATE '2000-01-01' THEN 0.7e0 ELSE 0.3e0 END
            ELSE CASE WHEN last_evidence_date >= DATE '1999-07-01' THEN 0.8e0
                      WHEN last_evidence_date >= DATE '1999-01-01' THEN 0.6e0 ELSE 0.4e0 END END AS recency_score,
       least(evidence_count / 5.0e0, 1.0e0) AS frequency_score,
       CASE WHEN years_seen >= 2 THEN 1.0e0 ELSE 0.5e0 END AS persistence_score,
       CASE WHEN c AND x.bene_id IS NOT NULL THEN 1.0e0 ELSE 0.5e0 END AS diversity_score
FROM v1_pairs p JOIN members USING (bene_id) LEFT JOIN descriptions USING (hcc_v28)
LEFT JOIN v1_rx x ON x.bene_id = p.bene_id AND x.hcc_v28 = p.hcc_v28
WHERE h <> c"""

TABLES["suspects_v1"] = """
SELECT *, round(0.30e0 * recency_score + 0.25e0 * frequency_score + 0.20e0 * persistence_score
                + 0.25e0 * diversity_score, 3) AS priority_score, 'PENDING_REVIEW' AS status
FROM v1_scored"""

TABLES["gaps_v2"] = """
SELECT p.bene_id, p.hcc_v28, CASE WHEN in_current THEN 'EMERGING' ELSE 'RECAPTURE' END AS gap_type,
       'PENDING_REVIEW' AS status,
       CASE WHEN in_current THEN CASE WHEN in_latest THEN 'CONTINUED' ELSE 'NOT_SEEN_LATEST' END
            WHEN in_latest THEN 'REAPPEARED' ELSE 'STILL_ABSENT' END AS latest_context
FROM presence p WHERE in_current <> in_historical AND bene_id IN (SELECT bene_id FROM baseline)"""

TABLES["gap_events"] = """
SELECT g.bene_id, g.hcc_v28, g.gap_type, e.event_date, e.claim_id, e.code, e.event_id, min(e.source) AS source,
       bool_or(e.is_principal) AS is_principal
FROM gaps_v2 g JOIN mapped e ON e.bene_id = g.bene_id AND e.hcc_v28 = g.hcc_v28
 AND ((g.gap_type = 'EMERGING' AND e.yr = 2000) OR (g.gap_type = 'RECAPTURE' AND e.yr IN (1998, 1999)))
GROUP BY ALL"""

TABLES["v2_hits"] = """
SELECT DISTINCT e.bene_id, e.hcc_v28, e.gap_type, r.event_id, r.drug_code
FROM (SELECT DISTINCT bene_id, hcc_v28, gap_type, event_date FROM gap_events) e
JOIN rx r ON r.bene_id = e.bene_id AND year(r.event_date) BETWEEN 1998 AND 2001
         AND abs(date_diff('day', r.event_date, e.event_date)) <= 30"""

TABLES["v2_support"] = """
SELECT bene_id, hcc_v28, gap_type, count(DISTINCT event_id) AS prescription_support_count,
       string_agg(DISTINCT drug_code, '|' ORDER BY drug_code) AS prescription_drug_codes
FROM v2_hits GROUP BY ALL"""

TABLES["v2_features"] = """
SELECT bene_id, hcc_v28, gap_type, count(*) AS diagnosis_count, count(DISTINCT claim_id) AS unique_claim_count,
       count(DISTINCT event_id) AS unique_event_count, min(event_date) AS first_evidence_date,
       max(event_date) AS last_evidence_date, count(DISTINCT event_date) AS distinct_evidence_dates,
       count(DISTINCT strftime(event_date, '%Y-%m')) AS distinct_evidence_months,
       count(DISTINCT source) AS distinct_sources, count(*) FILTER (is_principal) AS principal_diagnosis_count,
       string_agg(DISTINCT code, '|' ORDER BY code) AS supporting_diagnosis_codes
FROM gap_events GROUP BY bene_id, hcc_v28, gap_type"""

_COMPONENTS = """
       round(1.0e0 - exp(-diagnosis_count / 15.0e0), 4) AS frequency_score,
       round(exp(-greatest(0, date_diff('day', last_evidence_date, {ref})) / 365.0e0), 4) AS recency_score,
       round(least(distinct_evidence_months / 4.0e0, 1.0e0), 4) AS persistence_score,
       round(least(unique_claim_count / 3.0e0, 1.0e0), 4) AS repeated_claim_score,
       round(least(distinct_evidence_dates / 5.0e0, 1.0e0), 4) AS repeated_date_score,
       round(least(distinct_sources / 2.0e0, 1.0e0), 4) AS source_diversity_score,
       round(least(principal_diagnosis_count / 2.0e0, 1.0e0), 4) AS principal_score,
       round(least(prescription_support_count / 2.0e0, 1.0e0), 4) AS prescription_score"""

TABLES["v2_scored"] = f"""
SELECT *, {_COMPONENTS.format(ref="DATE '2000-12-31'")}
FROM (SELECT g.*, coalesce(hcc_description, 'Unknown') AS hcc_description,
             coalesce(diagnosis_count, 0) AS diagnosis_count, coalesce(unique_claim_count, 0) AS unique_claim_count,
             coalesce(unique_event_count, 0) AS unique_event_count, first_evidence_date, last_evidence_date,
             coalesce(distinct_evidence_dates, 0) AS distinct_evidence_dates,
             coalesce(distinct_evidence_months, 0) AS distinct_evidence_months,
             coalesce(distinct_sources, 0) AS distinct_sources,
             coalesce(principal_diagnosis_count, 0) AS principal_diagnosis_count,
             coalesce(supporting_diagnosis_codes, '') AS supporting_diagnosis_codes,
             coalesce(prescription_support_count, 0) AS prescription_support_count, prescription_drug_codes
      FROM gaps_v2 g LEFT JOIN v2_features USING (bene_id, hcc_v28, gap_type)
      LEFT JOIN v2_support USING (bene_id, hcc_v28, gap_type) LEFT JOIN descriptions USING (hcc_v28))"""

_EXPLAIN = """
       concat_ws('|', CASE WHEN recency_score >= 0.75 THEN 'RECENT_EVIDENCE' END,
                 CASE WHEN frequency_score >= 0.75 THEN 'FREQUENT_EVIDENCE' END,
                 CASE WHEN persistence_score >= 0.75 THEN 'PERSISTENT_EVIDENCE' END,
                 CASE WHEN source_diversity_score >= 1.0 THEN 'MULTIPLE_SOURCE_TYPES' END,
                 CASE WHEN principal_diagnosis_count > 0 THEN 'PRINCIPAL_DIAGNOSIS_PRESENT' END,
                 CASE WHEN prescription_support_count > 0 THEN 'PRESCRIPTION_SUPPORTED' END,
                 latest_context) AS reason_flags,
       coalesce(nullif(concat_ws('; ',
                 CASE WHEN diagnosis_count > 0 THEN diagnosis_count || ' supporting diagnosis event(s)' END,
                 CASE WHEN distinct_sources > 0 THEN distinct_sources || ' source type(s)' END,
                 CASE WHEN distinct_evidence_months > 0
                      THEN 'evidence across ' || distinct_evidence_months || ' month(s)' END,
                 CASE WHEN unique_claim_count > 0 THEN unique_claim_count || ' claim(s)' END,
                 CASE WHEN principal_diagnosis_count > 0 THEN 'includes principal diagnosis evidence' END,
                 CASE WHEN prescription_support_count > 0
                      THEN prescription_support_count || ' prescription event(s) within +/-30 days' END,
                 CASE WHEN last_evidence_date IS NOT NULL
                      THEN 'latest diagnosis evidence ' || CAST(last_evidence_date AS VARCHAR) END), ''),
                 'No current evidence; review data completeness before acting') AS evidence_summary"""

TABLES["suspects_v2"] = f"SELECT *, {_EXPLAIN} FROM v2_scored"

TABLES["ranked"] = """
SELECT *, row_number() OVER (ORDER BY review_priority_score DESC, evidence_strength_score DESC, diagnosis_count DESC,
                             bene_id, CAST(hcc_v28 AS INTEGER), gap_type) AS review_rank
FROM (SELECT *, round_even(10000.0e0 * (0.78e0 * evidence_strength_score + (1.0e0 - 0.78e0 - 0.0e0) * gap_urgency_score + 0.0e0), 0) / 10000.0e0
                AS review_priority_score
      FROM (SELECT *, round_even(10000.0e0 * (0.0e0 + frequency_score * 0.18e0 + persistence_score * 0.18e0 + recency_score * 0.15e0
                            + repeated_claim_score * 0.15e0 + repeated_date_score * 0.15e0
                            + source_diversity_score * 0.08e0 + principal_score * 0.08e0
                            + prescription_score * 0.03e0), 0) / 10000.0e0 AS evidence_strength_score,
                   CASE WHEN gap_type = 'EMERGING' THEN 1.0e0 WHEN latest_context = 'STILL_ABSENT' THEN 0.85e0
                        ELSE 0.65e0 END AS gap_urgency_score FROM suspects_v2))"""

TABLES["suspects"] = """
SELECT 'SUS-' || bene_id || '-' || hcc_v28 || '-' || suspect_type AS suspect_id, bene_id, hcc_v28, hcc_description,
       suspect_type, supporting_diagnosis_codes, evidence_count, first_evidence_date, last_evidence_date,
       priority_score,
       CASE WHEN priority_score >= 0.75 THEN 'HIGH' WHEN priority_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END
         AS ml_priority,
       CASE WHEN CAST(hcc_v28 AS INTEGER) % 7 = 0 THEN 'REVIEWED' ELSE 'PENDING_REVIEW' END AS status
FROM suspects_v1"""

TABLES["decisions"] = """
SELECT 'R-' || suspect_id AS review_id, suspect_id,
       CASE (CAST(substr(bene_id, 2) AS BIGINT) + CAST(hcc_v28 AS INTEGER)) % 4 WHEN 0 THEN ' supported '
            WHEN 1 THEN 'NOT_SUPPORTED' WHEN 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'MAYBE' END AS decision,
       'Chart ' || CAST(substr(bene_id, 2) AS BIGINT) || ' of HCC ' || hcc_v28 AS notes,
       make_timestamp(1000000 * (978307200 + (CAST(substr(bene_id, 2) AS BIGINT) % 1000) * 3600
                                 + CAST(hcc_v28 AS INTEGER))) AS reviewer_timestamp
FROM suspects WHERE CAST(hcc_v28 AS INTEGER) % 5 = 0"""

TABLES["checked"] = """
SELECT d.review_id, d.suspect_id, s.bene_id, s.hcc_v28, s.suspect_type, s.priority_score,
       upper(trim(d.decision)) AS decision, d.notes, d.reviewer_timestamp,
       CASE WHEN upper(trim(d.decision)) NOT IN ('SUPPORTED', 'NOT_SUPPORTED', 'INSUFFICIENT_EVIDENCE')
            THEN 'Invalid decision: ' || d.decision END AS reason
FROM decisions d JOIN suspects s USING (suspect_id)"""

TABLES["reviews"] = "SELECT * EXCLUDE (reason) FROM checked WHERE reason IS NULL"

TABLES["severity"] = """
SELECT DISTINCT hcc_v28, CAST(CAST(hcc_v28 AS INTEGER) % 5 + 1 AS DOUBLE) AS severity_level
FROM mapping WHERE hcc_v28 IS NOT NULL"""

_DIRTY = ("coalesce(' ' || lower(substr({c}, 1, 4)) || '.' || substr({c}, 5) || ' ', 'NULL')")

TABLES["wide_claims"] = (
    """
SELECT o_orderkey AS row_idx,
       CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE 'B' || printf('%08d', o_custkey) END AS BENE_ID,
       CAST(o_orderkey AS VARCHAR) AS CLM_ID,
       CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE upper(strftime(o_orderdate, '%d-%b-%Y')) END AS CLM_FROM_DT,
       strftime(o_orderdate, '%d-%b-%Y') AS CLM_THRU_DT, CAST(o_orderdate AS DATE) AS order_date, c1 AS ADMTG_DGNS_CD,
       CASE o_orderstatus WHEN 'F' THEN 'INPATIENT' WHEN 'O' THEN 'OUTPATIENT' ELSE 'CARRIER' END AS source, """
    + _DIRTY.format(c="c0") + " AS PRNCPAL_DGNS_CD, "
    + ", ".join(_DIRTY.format(c=f"c{i}") + f" AS ICD_DGNS_CD{i}" for i in range(1, 26))
    + ", codes\nFROM (SELECT l_orderkey, codes, "
    + ", ".join(f"codes[{i + 1}] AS c{i}" for i in range(26))
    + " FROM (SELECT l_orderkey, list('D' || printf('%06d', l_partkey) ORDER BY l_linenumber, l_partkey) AS codes"
    + " FROM lineitem GROUP BY l_orderkey)) JOIN orders ON l_orderkey = o_orderkey"
)

TABLES["long_claims"] = """
SELECT w.BENE_ID AS bene_id, w.CLM_ID AS claim_id, w.source, w.order_date AS event_date, w.codes[slot + 1] AS code, slot,
       list_position(w.codes, w.codes[slot + 1]) = slot + 1 AS first_slot, w.codes[1] AS principal, w.ADMTG_DGNS_CD AS admitting
FROM wide_claims w, (SELECT unnest(range(26)) AS slot) WHERE w.codes[slot + 1] IS NOT NULL"""

TABLES["pde"] = """
SELECT CASE WHEN l_orderkey % 97 = 0 THEN ' ' ELSE 'B' || printf('%08d', o_custkey) END AS BENE_ID,
       CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE l_orderkey || '_' || l_linenumber || '_' || l_partkey END AS PDE_ID,
       strftime(l_shipdate, '%d-%b-%y') AS SRVC_DT, CAST(l_shipdate AS DATE) AS ship_date,
       ' ' || CAST(l_suppkey AS VARCHAR) AS PROD_SRVC_ID
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"""

TABLES["yearly_members"] = """
SELECT o_orderkey AS row_idx, 'B' || printf('%08d', o_custkey) AS bene_id, year(o_orderdate) AS year,
       o_orderpriority AS state, o_orderstatus AS sex
FROM orders WHERE year(o_orderdate) IN (1998, 1999, 2000)"""

TABLES["batch_rows"] = """
SELECT event_id AS row_idx,
       CASE event_id % 50 WHEN 7 THEN ' ' WHEN 17 THEN 'X' || user_id
            ELSE 'B' || printf('%08d', user_id) END AS bene_id,
       CAST(CASE event_id % 50 WHEN 11 THEN event_id - 1 WHEN 23 THEN NULL ELSE event_id END AS VARCHAR) AS claim_id,
       CASE event_id % 50 WHEN 13 THEN '2024-13-45' WHEN 29 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS claim_date,
       'D' || printf('%06d', CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT)) AS diagnosis_code,
       event_type AS source, CASE WHEN event_id % 3 = 0 THEN 'Y' ELSE 'no' END AS is_principal
FROM events"""

TABLES["validated"] = """
SELECT row_idx, nullif(trim(b.bene_id), '') AS bene_id, b.claim_id, b.claim_date AS raw_date, b.diagnosis_code, b.source,
       lower(b.is_principal) IN ('true', 'yes', '1', 'y') AS is_principal,
       CASE WHEN trim(b.bene_id) = '' THEN 'Missing bene_id'
            WHEN b.claim_id IS NOT NULL AND row_number() OVER (
                   PARTITION BY b.claim_id, trim(b.bene_id) = '' ORDER BY row_idx) > 1
              THEN 'Duplicate claim_id in batch: ' || b.claim_id
            WHEN b.claim_date <> '' AND try_strptime(b.claim_date, '%Y-%m-%d') IS NULL
              THEN 'Invalid claim date: ' || b.claim_date
            WHEN m.bene_id IS NULL THEN 'Unknown bene_id: ' || b.bene_id END AS reason
FROM batch_rows b LEFT JOIN members m ON m.bene_id = b.bene_id"""

TABLES["batch_claims"] = """
SELECT 'B200101' AS batch_id, claim_id, bene_id, event_date AS claim_date, diagnosis_code, source, is_principal
FROM dx WHERE event_date BETWEEN DATE '2001-01-01' AND DATE '2001-01-31'"""

TABLES["batch_timeline"] = """
SELECT t.* FROM (SELECT bene_id, event_date, code, hcc_v28, source, claim_id, event_id, is_principal FROM mapped
                 WHERE event_date < DATE '2001-01-01'
                 UNION ALL
                 SELECT c.bene_id, c.claim_date, c.diagnosis_code, m.hcc_v28, c.source, c.claim_id,
                        c.batch_id || ':' || c.claim_id, c.is_principal
                 FROM batch_claims c JOIN mapping m ON m.diagnosis_code = c.diagnosis_code
                 WHERE m.hcc_v28 IS NOT NULL) t
WHERE bene_id IN (SELECT bene_id FROM batch_claims) AND year(event_date) BETWEEN 1999 AND 2001"""

TABLES["batch_presence"] = """
SELECT bene_id, hcc_v28, bool_or(year(event_date) < 2001) AS h, bool_or(year(event_date) = 2001) AS c
FROM batch_timeline GROUP BY ALL"""

TABLES["batch_gaps"] = """
SELECT bene_id, hcc_v28, CASE WHEN c THEN 'EMERGING' ELSE 'RECAPTURE' END AS gap_type,
       CASE WHEN c THEN 'CONTINUED' ELSE 'STILL_ABSENT' END AS latest_context
FROM batch_presence WHERE h <> c AND bene_id IN (SELECT bene_id FROM batch_presence WHERE h)"""

TABLES["batch_events"] = """
SELECT g.bene_id, g.hcc_v28, g.gap_type, e.event_date, e.claim_id, e.code, e.event_id, min(e.source) AS source,
       bool_or(e.is_principal) AS is_principal
FROM batch_gaps g JOIN batch_timeline e USING (bene_id, hcc_v28) GROUP BY ALL"""

TABLES["batch_support"] = """
SELECT e.bene_id, e.hcc_v28, e.gap_type, count(DISTINCT r.event_id) AS prescription_support_count
FROM (SELECT DISTINCT bene_id, hcc_v28, gap_type, event_date FROM batch_events) e
JOIN rx r ON r.bene_id = e.bene_id AND abs(date_diff('day', r.event_date, e.event_date)) <= 30 GROUP BY ALL"""

TABLES["batch_scored"] = f"""
SELECT *, {_COMPONENTS.format(ref="DATE '2001-12-31'")}
FROM (SELECT g.bene_id, g.hcc_v28, g.gap_type, g.latest_context, count(*) AS diagnosis_count,
             count(DISTINCT claim_id) AS unique_claim_count, count(DISTINCT event_id) AS unique_event_count,
             min(event_date) AS first_evidence_date, max(event_date) AS last_evidence_date,
             count(DISTINCT event_date) AS distinct_evidence_dates,
             count(DISTINCT strftime(event_date, '%Y-%m')) AS distinct_evidence_months,
             count(DISTINCT source) AS distinct_sources, count(*) FILTER (is_principal) AS principal_diagnosis_count,
             string_agg(DISTINCT code, '|' ORDER BY code) AS supporting_diagnosis_codes,
             any_value(coalesce(s.prescription_support_count, 0)) AS prescription_support_count
      FROM batch_gaps g JOIN batch_events e USING (bene_id, hcc_v28, gap_type)
      LEFT JOIN batch_support s USING (bene_id, hcc_v28, gap_type)
      GROUP BY g.bene_id, g.hcc_v28, g.gap_type, g.latest_context)"""

TABLES["batch_suspects"] = f"""
SELECT *, CASE WHEN priority_score >= 0.75 THEN 'HIGH' WHEN priority_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority
FROM (SELECT *, {_EXPLAIN},
             round(0.30e0 * recency_score + 0.25e0 * frequency_score + 0.20e0 * persistence_score
                   + 0.25e0 * source_diversity_score, 3) AS priority_score
      FROM batch_scored)"""

TABLES["retro"] = """
SELECT bene_id, hcc_v28, bool_or(yr IN (1997, 1998)) AS h, bool_or(yr = 1999) AS c, bool_or(yr = 2000) AS v,
       count(*) FILTER (yr = 1999) AS evidence_count, max(event_date) FILTER (yr = 1999) AS last_date,
       coalesce(string_agg(DISTINCT source, '|' ORDER BY source) FILTER (yr = 1999), '') AS sources,
       count(DISTINCT yr) AS years
FROM mapped GROUP BY bene_id, hcc_v28"""

TABLES["retro_emerging"] = """
SELECT bene_id, hcc_v28, evidence_count, v AS confirmed, sources,
       round(0.30e0 * CASE WHEN last_date >= DATE '1999-07-01' THEN 1.0e0 WHEN last_date >= DATE '1999-01-01' THEN 0.7e0
                           ELSE 0.3e0 END + 0.25e0 * least(evidence_count / 5.0e0, 1.0e0)
             + 0.20e0 * CASE WHEN years >= 2 THEN 1.0e0 ELSE 0.5e0 END + 0.25e0 * 0.5e0, 3) AS priority_score
FROM retro WHERE c AND NOT h"""

TABLES["retro_recapture"] = """
SELECT bene_id, hcc_v28, v AS confirmed,
       round(0.30e0 * 0.7e0 + 0.25e0 * 0.5e0 + 0.20e0 * CASE WHEN years >= 2 THEN 1.0e0 ELSE 0.5e0 END
             + 0.25e0 * 0.5e0, 3) AS priority_score
FROM retro WHERE h AND NOT c"""

TABLES["predictions"] = """
SELECT bene_id, hcc_v28, suspect_type AS gap_type,
       CASE WHEN priority_score >= 0.75 THEN 'HIGH' WHEN priority_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS actual,
       (0.5e0 + recency_score) / t AS p0, (1.0e0 + frequency_score) / t AS p1, (0.25e0 + persistence_score) / t AS p2
FROM (SELECT *, 0.5e0 + recency_score + (1.0e0 + frequency_score) + (0.25e0 + persistence_score) AS t FROM suspects_v1)"""

TABLES["labelled"] = """
SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'LOW' WHEN p1 >= p2 THEN 'MEDIUM' ELSE 'HIGH' END AS predicted
FROM predictions"""

TABLES["reported"] = """
SELECT c, tp, pred, sup, CASE WHEN pred > 0 THEN tp / CAST(pred AS DOUBLE) ELSE 0.0e0 END AS p,
       CASE WHEN sup > 0 THEN tp / CAST(sup AS DOUBLE) ELSE 0.0e0 END AS r,
       CASE WHEN pred + sup > 0 THEN 2 * tp / CAST(pred + sup AS DOUBLE) ELSE 0.0e0 END AS f
FROM (SELECT c, count(*) FILTER (actual = c AND predicted = c) AS tp, count(*) FILTER (predicted = c) AS pred,
             count(*) FILTER (actual = c) AS sup
      FROM labelled, (SELECT unnest(['LOW', 'MEDIUM', 'HIGH']) AS c) GROUP BY c)"""

TABLES["training_events"] = "SELECT DISTINCT ON (event_id) * FROM mapped ORDER BY event_id, bene_id, event_date, hcc_v28, code, claim_id, source, is_principal"

TABLES["training_features"] = """
SELECT bene_id, hcc_v28, count(*) AS diagnosis_count, count(DISTINCT code) AS unique_icd_count,
       count(DISTINCT yr) AS active_years,
       CAST(date_diff('day', max(event_date), DATE '1999-12-31') AS BIGINT) AS days_since_last_diagnosis,
       count(DISTINCT claim_id) AS unique_claim_count, count(DISTINCT source) AS source_count,
       count(*) FILTER (source = 'INPATIENT') AS inpatient_count,
       count(*) FILTER (source = 'OUTPATIENT') AS outpatient_count,
       count(*) FILTER (source = 'CARRIER') AS carrier_count,
       count(*) FILTER (is_principal) AS principal_diagnosis_count
FROM training_events WHERE yr BETWEEN 1997 AND 1999 GROUP BY bene_id, hcc_v28"""

TABLES["training_set"] = """
SELECT f.*, CAST(t.bene_id IS NOT NULL AS INTEGER) AS target, CAST(h.bene_id IS NOT NULL AS INTEGER) AS holdout_target
FROM training_features f
LEFT JOIN (SELECT DISTINCT bene_id, hcc_v28 FROM training_events WHERE yr = 2000) t USING (bene_id, hcc_v28)
LEFT JOIN (SELECT DISTINCT bene_id, hcc_v28 FROM training_events WHERE yr = 2001) h USING (bene_id, hcc_v28)"""
