import json

import pytest

from caregap import schemas
from caregap.operators import lookup
from caregap.sources import files, reference, sinks


def test_upload_directory(spark, tmp_path):
    nested = tmp_path / "Upload"
    nested.mkdir()
    (nested / "INPATIENT.csv").write_text(
        "﻿BENE_ID|CLM_ID|CLM_FROM_DT|PRNCPAL_DGNS_CD|ICD_DGNS_CD1\nB1|C1|02-Jan-2023|e11.9|I50.9\n|C2|02-Jan-2023|I10|\n")
    (nested / "pde.csv").write_text("BENE_ID|PDE_ID|SRVC_DT|PROD_SRVC_ID\nB1|7|03-Jan-23|N1\n")
    rows, fills, stats = files.read_claims_directory(spark, str(tmp_path))
    assert sorted((r.claim_id, r.diagnosis_code, r.is_principal) for r in rows.collect()) == [
        ("INPATIENT_C1_1", "I509", False), ("INPATIENT_C1_P", "E119", True)]
    assert [(r.event_id, str(r.event_date)) for r in fills.collect()] == [("PDE_7", "2023-01-03")]
    assert [r.asDict() for r in stats.collect()] == [
        {"source": "INPATIENT", "raw_claims": 1, "skipped_rows": 1, "diagnosis_rows": 2}]


def test_upload_directory_needs_a_claims_file(spark, tmp_path):
    (tmp_path / "other.csv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="at least one of"):
        files.read_claims_directory(spark, str(tmp_path))


def test_members_over_years(spark, tmp_path):
    header = "BENE_ID|BENE_BIRTH_DT|SEX_IDENT_CD|STATE_CODE\n"
    (tmp_path / "a.csv").write_text(header + "B1|05-Mar-1940|1|NY\n")
    (tmp_path / "b.csv").write_text(header + "B1|05-Mar-1940|1|CA\nB2||2|TX\n")
    rows = files.members_from_files(spark, {2024: str(tmp_path / "b.csv"), 2023: str(tmp_path / "a.csv")}).collect()
    got = {r.bene_id: (r.state, str(r.birth_date), r.enrollment_years) for r in rows}
    assert got == {"B1": ("NY", "1940-03-05", "2023|2024"), "B2": ("TX", "None", "2024")}


def test_typed_table_and_batch_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("state,bene_id,birth_date\nNY,B1,1940-03-05\nCA,B2,never\n")
    got = {r.bene_id: (r.state, r.birth_date and str(r.birth_date), r.zip) for r in
           files.read_csv_table(spark, str(tmp_path / "m.csv"), schemas.MEMBERS).collect()}
    assert got == {"B1": ("NY", "1940-03-05", None), "B2": ("CA", None, None)}
    (tmp_path / "b.csv").write_text("﻿bene_id,claim_id,claim_date\nB1,C1,2023-01-01\n")
    batch = files.read_batch_csv(spark, str(tmp_path / "b.csv"))
    assert batch.first().bene_id == "B1" and "diagnosis_code" in batch.columns


def test_crosswalk_sheet_by_position(spark, tmp_path):
    (tmp_path / "x.csv").write_text(
        "c0,c1,c2,c3,c4,c5,c6,c7,c8,c9,c10\n e11 .9 ,Diabetes,,,,37.0,,,,,Yes\n,skip,,,,1,,,,,Yes\nI10,Hypertension,,,,,,,,,No\n")
    got = {r.diagnosis_code: (r.description, r.hcc_v28, r.payment_2026)
           for r in reference.read_crosswalk_sheet(spark, str(tmp_path / "x.csv")).collect()}
    assert got == {"E11.9": ("Diabetes", "37", True), "I10": ("Hypertension", "", False)}


def test_mapping_file_first_and_last(spark, tmp_path):
    (tmp_path / "m.csv").write_text("diagnosis_code,description,hcc_v28,payment_2026\nE119,a,37,True\nE119,b,38,False\n")
    assert reference.read_mapping(spark, str(tmp_path / "m.csv")).first().hcc_v28 == "37"
    assert reference.read_mapping(spark, str(tmp_path / "m.csv"), last_wins=True).first().hcc_v28 == "38"


def test_severity_contract(spark):
    ok = spark.createDataFrame([(" 1 ", "3")], "hcc_v28 string, severity_level string")
    assert lookup.severity_contract(ok).first().asDict() == {"hcc_v28": "1", "severity_level": 3.0}
    with pytest.raises(ValueError, match="missing columns"):
        lookup.severity_contract(ok.select("hcc_v28"))
    with pytest.raises(ValueError, match="numeric"):
        lookup.severity_contract(spark.createDataFrame([("1", "x")], "hcc_v28 string, severity_level string"))
    with pytest.raises(ValueError, match="one row"):
        lookup.severity_contract(spark.createDataFrame([("1", "1"), ("1", "2")], "hcc_v28 string, severity_level string"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", "b", ["x", "y"])], "run_id string, b string, c array<string>").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "csv"), ["c", "b"])
    text = [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert text == ["c,b", '"[""x"",""y""]",b']
    sinks.append_partitioned(df, str(tmp_path / "part"))
    sinks.append_partitioned(df.withColumn("run_id", df.b), str(tmp_path / "part"))
    assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / "part")).collect()) == ["b", "r1"]
    sinks.reload_table(df, str(tmp_path / "full"))
    sinks.reload_table(df, str(tmp_path / "full"))
    assert spark.read.parquet(str(tmp_path / "full")).count() == 1
    records = spark.createDataFrame([('{"bene_id":"B1"}',)], "input_payload string").coalesce(1)
    sinks.write_payloads(records, str(tmp_path / "json"))
    line = json.loads(spark.read.text(str(tmp_path / "json")).first().value)
    assert line["schema_version"] == "1.0" and line["candidate"] == {"bene_id": "B1"}


def test_review_export_and_decisions(spark, tmp_path):
    reviews = spark.createDataFrame(
        [("R1", "S1", "B1", "1", "EMERGING", 0.5, "SUPPORTED", 'said "ok", done', None)], schemas.REVIEW_DECISIONS).coalesce(1)
    sinks.export_reviews(reviews, str(tmp_path / "export"))
    text = [r.value for r in spark.read.text(str(tmp_path / "export")).collect()]
    assert text[0] == '"Review ID","Bene ID","HCC Code","Decision","Timestamp","Notes"'
    assert text[1] == '"R1","B1","1","SUPPORTED","","said ""ok"", done"'
    sinks.append_decisions(reviews, str(tmp_path / "d"))
    sinks.append_decisions(reviews, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
