import json

from pyspark.sql import functions as F

from caregap import schemas
from caregap.operators import ingest, lookup, reshape, timeline


def claims(spark, rows):
    return spark.createDataFrame(
        rows, "BENE_ID string, CLM_ID string, CLM_FROM_DT string, CLM_THRU_DT string, PRNCPAL_DGNS_CD string, "
        "ADMTG_DGNS_CD string, ICD_DGNS_CD1 string, ICD_DGNS_CD2 string, ICD_DGNS_CD3 string",
    )


def test_long_diagnoses_keep_lowest_slot(spark):
    wide = claims(spark, [
        ("B1", "C1", "", "02-Jan-2023", "e11.9", "A1", "E119", "I50.9", "i509"),
        ("B2", "C2", "03-Jan-2023", None, None, "A1", "I10", "nan", "I10"),
        (" ", "C3", "03-Jan-2023", None, "I10", None, None, None, None),
    ])
    got = sorted(
        (r.bene_id, r.event_id, r.diagnosis_code, str(r.event_date), r.is_principal)
        for r in reshape.long_diagnoses(wide, "INPATIENT", 3).collect()
    )
    assert got == [
        ("B1", "INPATIENT_C1_2", "I509", "2023-01-02", False),
        ("B1", "INPATIENT_C1_P", "E119", "2023-01-02", True),
        ("B2", "INPATIENT_C2_1", "I10", "2023-01-03", False),
    ]
    plan = reshape.long_diagnoses(wide, "INPATIENT", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_repeats_among_secondaries_stay(spark):
    wide = claims(spark, [("B1", "C1", "", "", None, "E11", "E11", "I10", "I10")])
    got = sorted((r.slot, r.diagnosis_code) for r in reshape.long_diagnoses_keep_repeats(wide, 3).collect())
    assert got == [(0, "E11"), (2, "I10"), (3, "I10")]


def test_missing_fill_ids_are_stable(spark):
    pde = spark.createDataFrame(
        [("B1", "", "02-Jan-2023", " N1 "), ("B1", "9", "02-Jan-2023", "N1"), ("", "8", "02-Jan-2023", "N1")],
        "BENE_ID string, PDE_ID string, SRVC_DT string, PROD_SRVC_ID string",
    )
    first, second = reshape.prescriptions(pde).collect(), reshape.prescriptions(pde).collect()
    assert sorted(first) == sorted(second) and len(first) == 2
    assert {r.event_id.startswith("PDE_AUTO_") for r in first} == {True, False}


def test_members_take_first_row_and_all_years(spark):
    yearly = spark.createDataFrame(
        [(2, "B1", 2024, "CA"), (1, "B1", 2023, "NY"), (3, "B1", 2023, "TX"), (4, " ", 2023, "TX")],
        "row_idx int, bene_id string, year int, state string",
    )
    assert [tuple(r) for r in reshape.consolidate_members(yearly, ["state"]).collect()] == [("B1", "NY", "2023|2024")]


def test_crosswalk_first_and_last(spark):
    raw = spark.createDataFrame(
        [(1, "E119", "a", "37", True), (2, "E119", "b", "", False), (3, " ", "c", "1", True)],
        "row_idx int, diagnosis_code string, description string, hcc_v28 string, payment_2026 boolean",
    )
    assert lookup.crosswalk(raw).first().asDict() == {
        "diagnosis_code": "E119", "description": "a", "hcc_v28": "37", "payment_2026": True}
    assert lookup.crosswalk(raw, last_wins=True).first().hcc_v28 is None


def test_batch_rules_in_order(spark):
    rows = spark.createDataFrame(
        [
            (1, "", "C1", "2023-01-01"), (2, "M1", "C1", "bad"), (3, "M1", "C1", "2023-01-01"), (4, "M9", "C4", "2023-01-01"),
            (5, "M1", "C4", "2023-01-01"), (6, "M1", None, ""), (7, "M1", None, "2023-01-02"), (8, "M1", "C8", "NULL"),
        ],
        "row_idx int, bene_id string, claim_id string, claim_date string",
    )
    members = spark.createDataFrame([("M1",)], "bene_id string")
    reasons = {r.row_idx: r.reason for r in ingest.validate_batch(rows, members).collect()}
    assert reasons == {
        1: "Missing bene_id",
        2: "Invalid claim date: bad",
        3: "Duplicate claim_id in batch: C1",
        4: "Unknown bene_id: M9",
        5: "Duplicate claim_id in batch: C4",
        6: None,
        7: None,
        8: None,
    }
    assert ingest.batch_counters(ingest.validate_batch(rows, members)).first().asDict() == {
        "input_rows": 8, "valid_rows": 3, "inserted_rows": 3, "rejected_rows": 5}


def test_duplicates_of_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("row_idx"), F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("k")
    )
    got = ingest.reject_duplicates(rows, "k").groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in got} == {None: 2001, "Duplicate k: HOT": 999}


def test_extra_fields_are_folded(spark):
    rows = spark.createDataFrame([("B1", {"bene_id": "over", "x": "1"})], "bene_id string, extra map<string,string>")
    assert json.loads(ingest.with_payload(rows).first().raw_payload) == {"bene_id": "over", "x": "1"}
    assert ingest.with_payload(rows.limit(0)).count() == 0


def test_one_whole_row_is_kept(spark):
    rows = spark.createDataFrame([("k", None, 1), ("k", "b", 2), ("k", "a", None)], "key string, x string, y int")
    assert [tuple(r) for r in ingest.insert_ignore(rows, rows.limit(0), "key").collect()] == [("k", "b", 2)]


def test_file_row_numbers_have_no_gaps(spark):
    rows = spark.range(1000).repartition(7).withColumn("serial", F.monotonically_increasing_id())
    got = ingest.file_row_numbers(rows.cache(), "serial").collect()
    assert sorted(r.row_idx for r in got) == list(range(1, 1001))

def test_insert_ignore_keeps_one_row_per_key(spark):
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "k string, v int")
    old = spark.createDataFrame([("b", 9)], "k string, v int")
    assert [tuple(r) for r in ingest.insert_ignore(new, old, "k").collect()] == [("a", 1)]


def test_bulk_load_types_and_rejections(spark):
    raw = spark.createDataFrame(
        [(1, "P1", " M1 ", "2023-01-05x"), (2, "P1", "M1", "2023-01-06"), (3, "P2", "", "2023-01-06"), (4, "P3", "M2", "soon")],
        "row_idx int, event_id string, bene_id string, event_date string",
    )
    loaded = ingest.bulk_load(raw, schemas.EVENTS_PRESCRIPTION, "event_id", ("bene_id",))
    got = {r.row_idx: (r.bene_id, r.event_date and str(r.event_date), r.drug_code, r.reason) for r in loaded.collect()}
    assert got == {
        1: ("M1", "2023-01-05", None, None),
        2: ("M1", "2023-01-06", None, "Duplicate event_id: P1"),
        3: (None, "2023-01-06", None, "Missing event_id or bene_id"),
        4: ("M2", None, None, None),
    }
    assert ingest.load_counters(loaded).first().asDict() == {"processed": 4, "inserted": 2, "rejected": 2}


def test_normalized_timeline(spark):
    raw = spark.createDataFrame(
        [(" A ", "2000-01-02 00:00", " Diagnosis", "X ", "37.0", "carrier", "c", "", "Y"), ("B", "x", "prescription", "N", "", "PDE", "", "e", "")],
        "bene_id string, event_date string, event_type string, code string, hcc_v28 string, source string, claim_id string, "
        "event_id string, is_principal string",
    )
    got = [tuple(str(v) for v in r) for r in timeline.normalized(raw).collect()]
    assert got == [
        ("A", "2000-01-02", "diagnosis", "X", "37", "CARRIER", "c", "None", "True"),
        ("B", "None", "prescription", "N", "None", "PDE", "None", "e", "False"),
    ]
