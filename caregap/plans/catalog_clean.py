"""Scalar cleaning, filters, projections, reshape and ingest rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from caregap.functions import clean, scores
from caregap.operators import evidence, gaps, ingest, profile, reshape, review
from caregap.operators import timeline as tl
from caregap.plans.fixtures import COHORT, PERIODS, WIDE_SLOTS, code_id
from caregap.schemas import SOURCE_SLOTS
from caregap.plans.registry import query
from caregap.schemas import Periods

# --- scalar expressions --------------------------------------------------------


@query(
    "x1_clean_code",
    """SELECT row_idx, nullif(replace(upper(trim(PRNCPAL_DGNS_CD)), '.', ''), 'NULL') AS code,
              nullif(replace(upper(trim(ICD_DGNS_CD1)), '.', ''), 'NULL') AS code_1 FROM wide_claims""",
)
def _(f):
    return f.wide_claims.select(
        "row_idx", clean.clean_code(F.col("PRNCPAL_DGNS_CD")).alias("code"),
        clean.clean_code(F.col("ICD_DGNS_CD1"), clean.NULL_CODES_UPLOAD).alias("code_1"),
    )


@query(
    "x2_clean_code_keep_dots",
    "SELECT p_partkey, regexp_replace(upper(trim(p_name || ' v.' || p_size)), '\\s+', '', 'g') AS code FROM part",
)
def _(f):
    raw = F.concat(F.col("p_name"), F.lit(" v."), F.col("p_size").cast("string"))
    return f.table("part").select("p_partkey", clean.clean_code_keep_dots(raw).alias("code"))


@query("x3_month_name_date", "SELECT BENE_ID AS bene_id, SRVC_DT AS raw, ship_date AS event_date FROM pde")
def _(f):
    return f.pde.select(
        F.col("BENE_ID").alias("bene_id"), F.col("SRVC_DT").alias("raw"),
        clean.month_name_date(F.col("SRVC_DT")).alias("event_date"),
    )


@query(
    "x4_claim_date",
    """SELECT CAST(row_idx AS VARCHAR) AS id, CASE WHEN row_idx % 10 = 0 THEN NULL ELSE order_date END AS claim_date FROM wide_claims
       UNION ALL SELECT 'E' || row_idx, CAST(try_strptime(nullif(claim_date, ''), '%Y-%m-%d') AS DATE) FROM batch_rows""",
)
def _(f):
    wide = f.wide_claims.select(
        F.col("row_idx").cast("string").alias("id"), clean.claim_date(F.col("CLM_FROM_DT")).alias("claim_date")
    )
    batch = f.batch_rows.select(
        F.concat(F.lit("E"), F.col("row_idx").cast("string")).alias("id"),
        clean.claim_date(F.col("claim_date")).alias("claim_date"),
    )
    return wide.unionByName(batch)


@query(
    "x5_mixed_date_text",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'week ' || o_custkey ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
       FROM orders""",
)
def _(f):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (
        F.when(key % 5 == 0, F.date_format(day, "yyyyMMdd"))
        .when(key % 5 == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 5 == 2, F.date_format(day, "dd-MMM-yyyy"))
        .when(key % 5 == 3, F.date_format(day, "MM/dd/yyyy"))
        .otherwise(F.concat(F.lit("week "), F.col("o_custkey").cast("string")))
    )
    return f.table("orders").select("o_orderkey", clean.mixed_date_text(raw).alias("day"))


# Layouts whose fields tell the date; those that put the day first, read month first where both can be months; partial dates.
_PLAIN_LAYOUTS = (
    "yyyyMMdd", "yyyy-MM-dd", "dd-MMM-yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "MMM d, yyyy", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy",
    "MMMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "EEE, d MMM yyyy", "EEEE, MMMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'", "yyyy.MM.dd", "MM.dd.yyyy", "MM-dd-yyyy", "yyyy MMM dd",
    "yyyy-MMM-dd", "MMM-dd-yyyy", "MMM dd yyyy", "MM/dd/yyyy hh:mm a", "MM/dd/yyyy h:mm:ss a", "MMM d yyyy HH:mm",
    "yyyyMMddHHmmss", "yyyyMMdd'T'HHmmss", "M-d-yyyy", "M.d.yyyy", "yyyy-M-d", "yyyy/M/d", "MMM. d, yyyy", "ddMMMyyyy",
    "yyyyMMMdd", "yyyy MM dd", "EEE MMM dd HH:mm:ss yyyy", "MM/dd/yy", "dd-MMM-yy", "d'th of' MMMM yyyy", "HH:mm dd MMM yyyy",
)
_DAY_FIRST_LAYOUTS = ("dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "d/M/yyyy", "dd/MM/yy", "d.M.yyyy HH:mm")
_MONTH_LAYOUTS = ("yyyy-MM", "MMMM yyyy", "MM/yyyy", "MMM-yyyy")
_LAYOUTS = (*_PLAIN_LAYOUTS, *_DAY_FIRST_LAYOUTS, *_MONTH_LAYOUTS)
_NO_DATES = 3  # text that is no date: an impossible day, a foreign word, too many fields


@query(
    "x5_open_date_layouts",
    f"""SELECT o_orderkey, CASE
          WHEN n < {len(_PLAIN_LAYOUTS)} OR (n < {len(_PLAIN_LAYOUTS) + len(_DAY_FIRST_LAYOUTS)} AND day(o_orderdate) > 12) THEN strftime(o_orderdate, '%Y-%m-%d')
          WHEN n < {len(_PLAIN_LAYOUTS) + len(_DAY_FIRST_LAYOUTS)} THEN strftime(o_orderdate, '%Y-%d-%m')
          WHEN n < {len(_LAYOUTS)} THEN strftime(o_orderdate, '%Y-%m-01')
          WHEN n = {len(_LAYOUTS)} THEN strftime(o_orderdate, '%Y-%m-32')
          WHEN n = {len(_LAYOUTS) + 1} THEN 'week ' || strftime(o_orderdate, '%d %Y')
          ELSE strftime(o_orderdate, '%Y-%m-%d-7') END AS day
        FROM (SELECT o_orderkey, o_orderdate, o_orderkey % {len(_LAYOUTS) + _NO_DATES} AS n FROM orders)""",
)
def _(f):
    n, day = F.col("o_orderkey") % (len(_LAYOUTS) + _NO_DATES), F.col("o_orderdate").cast("timestamp")
    raw = F.when(n == len(_LAYOUTS), F.date_format(day, "yyyy-MM-'32'")).when(
        n == len(_LAYOUTS) + 1, F.date_format(day, "'week 'dd yyyy")).when(n == len(_LAYOUTS) + 2, F.date_format(day, "yyyy-MM-dd'-7'"))
    for i, layout in enumerate(_LAYOUTS):
        text = F.date_format(day, layout)
        # Every second use of a layout in capitals.
        raw = raw.when(n == i, F.when(F.col("o_custkey") % 2 == 0, F.upper(text)).otherwise(text))
    return f.table("orders").select("o_orderkey", clean.mixed_date_text(raw).alias("day"))


@query(
    "x6_iso_date",
    "SELECT row_idx, CAST(try_strptime(claim_date, '%Y-%m-%d') AS DATE) AS day FROM batch_rows",
)
def _(f):
    return f.batch_rows.select("row_idx", clean.iso_date(F.col("claim_date")).alias("day"))


@query(
    "x7_date_or_reject",
    """SELECT row_idx, CAST(try_strptime(claim_date, '%Y-%m-%d') AS DATE) AS day,
              claim_date <> '' AND try_strptime(claim_date, '%Y-%m-%d') IS NULL AS is_invalid FROM batch_rows""",
)
def _(f):
    raw = F.col("claim_date")
    return f.batch_rows.select(
        "row_idx", clean.batch_date(raw).alias("day"), clean.is_bad_date(raw).alias("is_invalid")
    )


@query(
    "x8_parse_bool",
    """SELECT p_partkey, p_partkey % 4 IN (0, 1) AS flag FROM part""",
)
def _(f):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, " True ").when(k == 1, "1").when(k == 2, "y")
    return f.table("part").select("p_partkey", clean.parse_bool(raw).alias("flag"))


@query("x9_parse_bool_with_y", "SELECT row_idx, is_principal = 'Y' AS flag FROM batch_rows")
def _(f):
    return f.batch_rows.select("row_idx", clean.parse_bool(F.col("is_principal"), accept_y=True).alias("flag"))


@query(
    "x10_yes_no",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END ELSE '' END AS flag
       FROM part""",
)
def _(f):
    flag = F.when(F.col("p_partkey") % 3 == 0, (F.col("p_size") % 2 == 0).cast("string")).when(
        F.col("p_partkey") % 3 == 1, "nan"
    )
    return f.table("part").select("p_partkey", clean.yes_no(flag).alias("flag"))


def _dirty_number():
    return (
        F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, "n/a")
        .when(F.col("p_partkey") % 4 == 2, "nan").otherwise(F.col("p_retailprice").cast("string"))
    )


@query(
    "x11_parse_float_int",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN p_retailprice ELSE 0.0e0 END AS price,
              CASE WHEN p_partkey % 4 = 3 THEN CAST(trunc(p_retailprice) AS BIGINT) ELSE 1 END AS whole FROM part""",
)
def _(f):
    return f.table("part").select(
        "p_partkey", clean.parse_float(_dirty_number()).alias("price"), clean.parse_int(_dirty_number(), 1).alias("whole")
    )


@query(
    "x12_to_number",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS value FROM part",
)
def _(f):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice").cast("string")).otherwise(F.col("p_name"))
    return f.table("part").select("p_partkey", clean.to_number(raw).alias("value"))


@query(
    "x13_x14_x15_year_month_and_days",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr, strftime(o_orderdate, '%Y-%m') AS month,
              CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-12-31') AS INTEGER) AS days FROM orders""",
)
def _(f):
    day = F.col("o_orderdate").cast("date")
    return f.table("orders").select(
        "o_orderkey", F.year(day).alias("yr"), clean.year_month(day).alias("month"),
        F.datediff(F.lit(PERIODS.reference_date), day).alias("days"),
    )


@query(
    "x16_null_skipping_bounds",
    """SELECT row_idx, least(order_date, CASE WHEN row_idx % 10 > 0 THEN DATE '1999-06-30' END) AS first_day,
              greatest(order_date, CASE WHEN row_idx % 10 > 0 THEN DATE '1999-06-30' END) AS last_day FROM wide_claims""",
)
def _(f):
    a = clean.month_name_date(F.col("CLM_THRU_DT"))
    b = F.when(clean.blank_to_null(F.col("CLM_FROM_DT")).isNotNull(), F.lit("1999-06-30").cast("date"))
    return f.wide_claims.select("row_idx", F.least(a, b).alias("first_day"), F.greatest(a, b).alias("last_day"))


@query(
    "x17_x18_x20_x21_score_shapes",
    """SELECT bene_id, hcc_v28, round(least(n / 5.0e0, 1.0e0), 4) AS saturated, round(1.0e0 - exp(-n / 15.0e0), 4) AS curve,
              round(exp(-d / 365.0e0), 4) AS decay, round(greatest(0.0e0, least(1.0e0, n / 2.0e0 - 0.4e0)), 4) AS clipped,
              CASE WHEN n / 8.0e0 >= 0.75 THEN 'HIGH' WHEN n / 8.0e0 >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS tier
       FROM (SELECT bene_id, hcc_v28, count(*) AS n, date_diff('day', max(event_date), DATE '2001-12-31') AS d
             FROM mapped GROUP BY ALL)""",
)
def _(f):
    n, d = F.col("n"), F.col("d")
    pairs = gaps.diagnoses(f.dx_timeline).groupBy(*gaps.PAIR).agg(
        F.count("*").alias("n"), F.datediff(F.lit("2001-12-31").cast("date"), F.max("event_date")).alias("d")
    )
    return pairs.select(
        *gaps.PAIR, F.round(scores.saturate(n, 5), 4).alias("saturated"), F.round(scores.exp_saturation(n), 4).alias("curve"),
        F.round(scores.exp_decay(d), 4).alias("decay"), F.round(scores.unit_clip(n / 2 - 0.4), 4).alias("clipped"),
        scores.tier(n / 8).alias("tier"),
    )


@query("x19_round_digits", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / 7.0e0, 4) AS r4, round(l_quantity / 7.0e0, 3) AS r3 FROM lineitem")
def _(f):
    q = F.col("l_quantity") / 7.0
    return f.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(q, 4).alias("r4"), F.round(q, 3).alias("r3")
    )


@query(
    "x20_clip_unit",
    """SELECT c_custkey, greatest(0.0e0, least(1.0e0, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal / 5000.0e0 ELSE 0.0e0 END)) AS clipped
       FROM customer""",
)
def _(f):
    raw = F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal") / 5000.0)
    return f.table("customer").select("c_custkey", scores.unit_clip(raw).alias("clipped"))


@query(
    "x22_synthetic_ids",
    """SELECT o_orderkey, 'BENE_' || printf('%05d', o_custkey) AS member_id, 'CLM_INP_' || printf('%07d', o_orderkey) AS claim_id,
              'INPATIENT_' || o_orderkey || '_' || CASE WHEN o_custkey % 3 = 0 THEN 'P' ELSE CAST(o_custkey % 3 AS VARCHAR) END AS event_id
       FROM orders""",
)
def _(f):
    return f.table("orders").select(
        "o_orderkey", clean.numbered_id("BENE_", F.col("o_custkey"), 5).alias("member_id"),
        clean.numbered_id("CLM_INP_", F.col("o_orderkey"), 7).alias("claim_id"),
        clean.slot_event_id(F.lit("INPATIENT"), F.col("o_orderkey").cast("string"), F.col("o_custkey") % 3).alias("event_id"),
    )


@query("x23_suspect_key", "SELECT 'SUS-' || bene_id || '-' || hcc_v28 || '-' || gap_type AS suspect_id FROM gaps_v2")
def _(f):
    return f.gaps_v2.select(
        clean.suspect_key(F.col("bene_id"), F.col("hcc_v28"), F.lower("gap_type")).alias("suspect_id")
    )


@query("x24_strip_float_suffix", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS code FROM part")
def _(f):
    return f.table("part").select(
        "p_partkey", clean.strip_float_suffix(F.col("p_size").cast("double").cast("string")).alias("code")
    )


@query(
    "x25_fixed_decimals",
    "SELECT o_orderkey, printf('%.2f', o_totalprice / 7.0e0) AS share, printf('%.3f', o_totalprice / 7.0e0) AS share3 FROM orders",
)
def _(f):
    x = F.col("o_totalprice") / 7.0
    return f.table("orders").select(
        "o_orderkey", clean.fixed_decimals(x, 2).alias("share"), clean.fixed_decimals(x, 3).alias("share3")
    )


@query(
    "x26_percent_zero_guard",
    """SELECT diagnosis_code, round(CASE WHEN t > 0 THEN n * 100.0e0 / t ELSE 0.0e0 END, 4) AS pct
       FROM (SELECT m.diagnosis_code, count(*) FILTER (d.is_principal) AS n, count(d.event_id) AS t
             FROM mapping m LEFT JOIN dx d USING (diagnosis_code) GROUP BY m.diagnosis_code)""",
)
def _(f):
    counts = f.dx.groupBy("diagnosis_code").agg(F.count_if("is_principal").alias("n"), F.count("*").alias("t"))
    rows = f.mapping.select("diagnosis_code").join(counts, "diagnosis_code", "left").na.fill(0, ["n", "t"])
    return rows.select("diagnosis_code", F.round(clean.percent(F.col("n"), F.col("t")), 4).alias("pct"))


@query(
    "x27_split_pipes",
    """SELECT suspect_id, count(*) AS codes, min(code) AS first_code, max(code) AS last_code
       FROM (SELECT suspect_id, unnest(string_split(supporting_diagnosis_codes, '|')) AS code FROM suspects) GROUP BY suspect_id""",
)
def _(f):
    codes = clean.split_pipes(F.concat(F.lit(" |"), F.regexp_replace("supporting_diagnosis_codes", r"\|", " | ")))
    return f.suspects.select(
        "suspect_id", F.size(codes).cast("bigint").alias("codes"), F.array_min(codes).alias("first_code"),
        F.array_max(codes).alias("last_code"),
    )


@query(
    "x28_collection_coercion",
    """SELECT suspect_id, array_to_string(string_split(supporting_diagnosis_codes, '|'), ',') AS codes FROM suspects""",
)
def _(f):
    codes = F.split("supporting_diagnosis_codes", r"\|")
    raw = F.when(F.length("suspect_id") % 2 == 0, F.to_json(codes)).otherwise(F.col("supporting_diagnosis_codes"))
    return f.suspects.select("suspect_id", F.concat_ws(",", clean.as_collection(raw)).alias("codes"))


@query(
    "x29_age",
    "SELECT bene_id, CAST(date_sub('year', birth_date, DATE '2000-12-31') AS INTEGER) AS age FROM members",
)
def _(f):
    return f.members.select("bene_id", clean.age_at(F.col("birth_date"), F.lit(PERIODS.reference_date)).alias("age"))


# --- scans, filters, projections ---------------------------------------------------


@query("s4_projected_scan", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(f):
    return f.table("lineitem").filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_partkey")


@query(
    "s5_partitioned_scan",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity
       FROM lineitem GROUP BY ALL""",
)
def _(f):
    return f.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity")
    )


@query("s6_head_n", "SELECT bene_id, sex, state FROM members ORDER BY bene_id LIMIT 50")
def _(f):
    return f.members.select("bene_id", "sex", "state").orderBy("bene_id").limit(50)


@query(
    "s10_rows_of_batch_members",
    "SELECT bene_id, event_date, code, claim_id FROM mapped WHERE bene_id IN (SELECT bene_id FROM batch_claims)",
)
def _(f):
    return gaps.diagnoses(f.dx_timeline).join(f.batch_claims.select("bene_id"), "bene_id", "left_semi").select(
        "bene_id", "event_date", "code", "claim_id"
    )


@query(
    "s15_insert_ignore",
    """SELECT DISTINCT bene_id, event_id, pde_id, event_date, drug_code FROM rx
       WHERE event_id NOT IN (SELECT event_id FROM rx WHERE event_date < DATE '2000-01-01')""",
)
def _(f):
    return ingest.insert_ignore(f.rx, f.rx.filter(F.col("event_date") < F.lit("2000-01-01").cast("date")), "event_id").select(
        "bene_id", "event_id", "pde_id", "event_date", "drug_code"
    )


@query("p1_drop_blank_keys", "SELECT row_idx, BENE_ID AS bene_id FROM wide_claims WHERE trim(BENE_ID) <> ''")
def _(f):
    return f.wide_claims.filter(clean.strip(F.col("BENE_ID")) != "").select("row_idx", F.col("BENE_ID").alias("bene_id"))


@query("p2_year_set", "SELECT event_id, event_date, code FROM mapped WHERE yr IN (1996, 1998, 1999, 2001)")
def _(f):
    return gaps.diagnoses(f.dx_timeline).filter(clean.in_years(F.col("event_date"), [1996, 1998, 1999, 2001])).select(
        "event_id", "event_date", "code"
    )


@query(
    "p3_mapped_diagnoses",
    "SELECT event_id, code, hcc_v28 FROM timeline WHERE event_type = 'diagnosis' AND hcc_v28 IS NOT NULL AND event_date IS NOT NULL",
)
def _(f):
    return gaps.diagnoses(f.timeline).select("event_id", "code", "hcc_v28")


@query(
    "p4_period_routing",
    """SELECT event_id, code, CASE WHEN yr IN (1998, 1999) THEN 'historical' WHEN yr = 2000 THEN 'current'
              WHEN yr = 2001 THEN 'latest' ELSE 'other' END AS period FROM mapped""",
)
def _(f):
    return gaps.diagnoses(f.dx_timeline).select(
        "event_id", "code", clean.period_of(F.col("event_date"), PERIODS).alias("period")
    )


@query("p9_calendar_year", "SELECT event_id, event_type, code FROM timeline WHERE event_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'")
def _(f):
    return review.filter_timeline(f.timeline, year=1999).select("event_id", "event_type", "code")


@query("p10_hcc_only", "SELECT event_id, code, hcc_v28 FROM timeline WHERE source = 'CARRIER' AND hcc_v28 <> ''")
def _(f):
    return review.filter_timeline(f.timeline, source=" CARRIER ", hcc_only=True).select("event_id", "code", "hcc_v28")


@query(
    "p12_prescription_projection",
    """SELECT bene_id, event_date, 'prescription' AS event_type, drug_code AS code, CAST(NULL AS VARCHAR) AS hcc_v28, 'PDE' AS source,
              pde_id AS claim_id, event_id, CAST(NULL AS BOOLEAN) AS is_principal FROM rx""",
)
def _(f):
    return tl.prescription_rows(f.rx)


@query("p13_member_projection", "SELECT bene_id, sex, CAST(c_nationkey AS VARCHAR) AS state FROM members JOIN customer ON bene_id = 'B' || printf('%08d', c_custkey)")
def _(f):
    key = F.col("c_custkey")
    return f.table("customer").select(
        clean.numbered_id("B", key, 8).alias("bene_id"),
        clean.strip_float_suffix(F.when(key % 2 == 0, "2.0").otherwise(" 1")).alias("sex"),
        clean.strip_float_suffix(F.col("c_nationkey").cast("double").cast("string")).alias("state"),
    )


@query(
    "p14_crosswalk_projection",
    """SELECT diagnosis_code, trim(description) AS description, coalesce(CAST(hcc_v28 AS VARCHAR), '') AS hcc_v28, payment_2026 FROM mapping""",
)
def _(f):
    from caregap.sources.reference import crosswalk_sheet

    size = F.col("p_size")
    sheet = f.table("part").select(
        F.concat(F.lit(" "), F.lower(code_id(F.col("p_partkey")))).alias("code"),
        F.concat(F.col("p_name"), F.lit("  ")).alias("description"),
        F.when(size <= 30, size.cast("double").cast("string")).alias("v28"),
        F.when(size % 2 == 0, "Yes").otherwise("No").alias("payment"),
    )
    return crosswalk_sheet(sheet)


# --- reshape -----------------------------------------------------------------------------


@query(
    "r1_long_diagnoses",
    """SELECT bene_id, source || '_' || claim_id || '_' || CASE WHEN slot = 0 THEN 'P' ELSE CAST(slot AS VARCHAR) END AS event_id,
              claim_id, event_date, source, code AS diagnosis_code, slot = 0 AS is_principal
       FROM long_claims WHERE trim(bene_id) <> '' AND first_slot""",
)
def _(f):
    return reshape.long_diagnoses(f.wide_claims, F.col("source"), WIDE_SLOTS)


@query(
    "r2_long_keep_repeats",
    """SELECT bene_id, claim_id, CAST(slot AS INTEGER) AS slot, code AS diagnosis_code, diagnosis_date, slot = 0 AS is_principal
       FROM (SELECT trim(w.BENE_ID) AS bene_id, CLM_ID AS claim_id, order_date AS diagnosis_date, slot,
                    CASE WHEN slot = 0 THEN coalesce(codes[1], ADMTG_DGNS_CD) ELSE codes[slot + 1] END AS code,
                    coalesce(codes[1], ADMTG_DGNS_CD) AS principal
             FROM wide_claims w, (SELECT unnest(range(26)) AS slot))
       WHERE code IS NOT NULL AND (slot = 0 OR principal IS NULL OR code <> principal)""",
)
def _(f):
    undotted = {c: F.replace(F.col(c), F.lit("."), F.lit("")) for c in f.wide_claims.columns if c.endswith("_CD") or "_CD" in c}
    return reshape.long_diagnoses_keep_repeats(f.wide_claims.withColumns(undotted), WIDE_SLOTS)


@query(
    "r2_claim_rows",
    """SELECT trim(BENE_ID) AS member_id, CLM_ID AS claim_id, source AS claim_type, order_date AS service_date FROM wide_claims""",
)
def _(f):
    return reshape.claim_rows(f.wide_claims, F.col("source"))


@query(
    "r3_slots_per_source",
    """SELECT source, count(*) AS diagnosis_rows FROM long_claims
       WHERE trim(bene_id) <> '' AND list_position((SELECT codes FROM wide_claims w WHERE w.CLM_ID = claim_id)[1:CASE source WHEN 'CARRIER' THEN 13 ELSE 26 END], code) = slot + 1
       GROUP BY source""",
)
def _(f):
    narrow = f.wide_claims.filter("source = 'CARRIER'")
    wide = f.wide_claims.filter("source <> 'CARRIER'")
    rows = reshape.long_diagnoses(narrow, "CARRIER", SOURCE_SLOTS["CARRIER"]).unionByName(reshape.long_diagnoses(wide, F.col("source"), WIDE_SLOTS))
    return rows.groupBy("source").agg(F.count("*").alias("diagnosis_rows"))


@query(
    "r4_principal_fallback",
    "SELECT row_idx, coalesce(codes[1], ADMTG_DGNS_CD) AS principal FROM wide_claims",
)
def _(f):
    return f.wide_claims.select(
        "row_idx",
        F.coalesce(clean.clean_code(F.col("PRNCPAL_DGNS_CD")), clean.clean_code(F.col("ADMTG_DGNS_CD"))).alias("principal"),
    )


@query("r5_date_fallback", "SELECT row_idx, order_date AS claim_date FROM wide_claims")
def _(f):
    raw = F.coalesce(clean.blank_to_null(F.col("CLM_FROM_DT")), F.col("CLM_THRU_DT"))
    return f.wide_claims.select("row_idx", clean.claim_date(raw).alias("claim_date"))


@query(
    "r6_prescriptions",
    """SELECT trim(BENE_ID) AS bene_id, 'PDE_' || PDE_ID AS event_id, PDE_ID AS pde_id, ship_date AS event_date,
              trim(PROD_SRVC_ID) AS drug_code FROM pde WHERE trim(BENE_ID) <> '' AND PDE_ID <> ''""",
)
def _(f):
    return reshape.prescriptions(f.pde).filter(F.col("pde_id").isNotNull())


@query(
    "r7_missing_fill_ids",
    """SELECT trim(BENE_ID) AS bene_id, 'PDE_AUTO_' || substr(sha256(BENE_ID || '|' || SRVC_DT || '|' || PROD_SRVC_ID), 1, 12) AS event_id,
              ship_date AS event_date FROM pde WHERE trim(BENE_ID) <> '' AND PDE_ID = ''""",
)
def _(f):
    return reshape.prescriptions(f.pde).filter(F.col("pde_id").isNull()).select("bene_id", "event_id", "event_date")


_TRAINING = "bene_id, event_date, hcc_v28, code, claim_id, source, is_principal"


@query("r11_two_key_dedup", f"""SELECT {_TRAINING}, event_id FROM (
         SELECT DISTINCT ON (event_id) {_TRAINING}, event_id FROM mapped WHERE CAST(claim_id AS BIGINT) % 3 > 0
         ORDER BY event_id, {_TRAINING})
       UNION ALL SELECT DISTINCT {_TRAINING}, '' AS event_id FROM mapped WHERE CAST(claim_id AS BIGINT) % 3 = 0""")
def _(f):
    rows = gaps.diagnoses(f.dx_timeline).withColumn(
        "event_id", F.when(F.col("claim_id").cast("bigint") % 3 == 0, "").otherwise(F.col("event_id"))
    )
    return ingest.dedup_training_events(rows)


@query(
    "r17_member_consolidation",
    """SELECT bene_id, arg_min(state, row_idx) AS state, arg_min(sex, row_idx) AS sex,
              string_agg(DISTINCT CAST(year AS VARCHAR), '|' ORDER BY CAST(year AS VARCHAR)) AS enrollment_years
       FROM yearly_members GROUP BY bene_id""",
)
def _(f):
    return reshape.consolidate_members(f.yearly_members, ["state", "sex"])


@query(
    "a20_enrollment_distribution",
    """SELECT CAST(year AS VARCHAR) AS measure, count(DISTINCT bene_id) AS members FROM yearly_members GROUP BY year
       UNION ALL SELECT 'in_2_or_more_years', count(*) FILTER (n > 1) FROM (SELECT count(DISTINCT year) AS n FROM yearly_members GROUP BY bene_id)
       UNION ALL SELECT 'in_all_3_years', count(*) FILTER (n = 3) FROM (SELECT count(DISTINCT year) AS n FROM yearly_members GROUP BY bene_id)""",
)
def _(f):
    return profile.enrollment(reshape.consolidate_members(f.yearly_members, ["state"]))


@query(
    "r18_round_robin",
    f"""SELECT o_orderkey, 'BENE_' || printf('%05d', (row_no - 1) % {COHORT} + 1) AS member_id,
               'CLM_INP_' || printf('%07d', row_no) AS synthetic_claim_id
        FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders)""",
)
def _(f):
    from caregap.operators.ranking import global_rank

    rows = global_rank(f.table("orders").select("o_orderkey"), [F.col("o_orderkey")], "row_no")
    return reshape.assign_round_robin(rows, "row_no", COHORT, "CLM_INP_").drop("row_no")


@query(
    "r19_cohort",
    f"""SELECT bene_id, 'BENE_' || printf('%05d', row_number() OVER (ORDER BY bene_id)) AS member_id
        FROM members ORDER BY bene_id LIMIT {COHORT}""",
)
def _(f):
    return reshape.cohort(f.members.select("bene_id"), "bene_id", COHORT).select("bene_id", "member_id")


# --- ingest ---------------------------------------------------------------------------------


@query(
    "r12_duplicate_rejections",
    """SELECT row_idx, bene_id, CASE WHEN row_number() OVER (PARTITION BY bene_id ORDER BY row_idx) > 1
              THEN 'Duplicate bene_id: ' || bene_id END AS reason FROM yearly_members""",
)
def _(f):
    return ingest.reject_duplicates(f.yearly_members, "bene_id").select("row_idx", "bene_id", "reason")


@query(
    "r13_batch_validation",
    """SELECT row_idx, bene_id, claim_id, CAST(try_strptime(raw_date, '%Y-%m-%d') AS DATE) AS claim_date, reason FROM validated""",
)
def _(f):
    return f.validated.select("row_idx", "bene_id", "claim_id", "claim_date", "reason")


@query(
    "r14_missing_key_rejections",
    "SELECT row_idx, CASE WHEN trim(BENE_ID) = '' THEN 'Missing bene_id' END AS reason FROM wide_claims",
)
def _(f):
    rows = f.wide_claims.select("row_idx", F.col("BENE_ID").alias("bene_id"))
    return ingest.reject_missing(rows, "bene_id").select("row_idx", "reason")


@query(
    "r15_batch_counters",
    """SELECT count(*) AS input_rows, count(*) FILTER (reason IS NULL) AS valid_rows,
              count(*) FILTER (reason IS NULL) AS inserted_rows, count(reason) AS rejected_rows FROM validated""",
)
def _(f):
    return ingest.batch_counters(f.validated)


@query(
    "r15_rejections_by_reason",
    """SELECT split_part(reason, ':', 1) AS reason, count(*) AS rejected_rows FROM validated WHERE reason IS NOT NULL GROUP BY 1""",
)
def _(f):
    return ingest.rejection_summary(f.validated)


@query(
    "q6_rejection_sample",
    "SELECT row_idx, reason FROM validated WHERE reason IS NOT NULL ORDER BY row_idx LIMIT 10",
)
def _(f):
    return ingest.rejection_sample(f.validated)


@query(
    "r16_source_stats",
    """SELECT w.source, raw_claims, skipped_rows, coalesce(diagnosis_rows, 0) AS diagnosis_rows
       FROM (SELECT source, count(*) FILTER (trim(BENE_ID) <> '') AS raw_claims,
                    count(*) FILTER (trim(BENE_ID) = '') AS skipped_rows FROM wide_claims GROUP BY source) w
       LEFT JOIN (SELECT source, count(*) AS diagnosis_rows FROM long_claims WHERE trim(bene_id) <> '' AND first_slot GROUP BY source) l
         ON l.source = w.source""",
)
def _(f):
    return ingest.source_stats(f.wide_claims, reshape.long_diagnoses(f.wide_claims, F.col("source"), WIDE_SLOTS))


@query(
    "r20_raw_payload",
    """SELECT row_idx, '{"bene_id":"' || bene_id || '","claim_date":"' || claim_date || '","source":"' || source || '"}' AS raw_payload
       FROM batch_rows""",
)
def _(f):
    rows = f.batch_rows.select("row_idx", "bene_id", "claim_date", "source")
    return ingest.with_payload(rows).select("row_idx", "raw_payload")
