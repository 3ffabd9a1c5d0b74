import datetime as dt

from pyspark.sql import functions as F

from caregap.functions import clean, scores


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def test_clean_code(spark):
    raw = [" e11.9 ", "nan", "None", "", None, "I50.9\t", "na"]
    assert values(spark, clean.clean_code, raw) == ["E119", None, None, None, None, "I509", "NA"]
    upload = lambda c: clean.clean_code(c, clean.NULL_CODES_UPLOAD)
    assert values(spark, upload, ["na", " e11.9"]) == [None, "E119"]
    assert values(spark, clean.clean_code_keep_dots, [" e 11.9 ", "null"]) == ["E11.9", None]


def test_month_name_dates(spark):
    raw = ["5-JAN-2023", "05-feb-51", "05-Mar-50", "2023-01-05", "31-Feb-2023", "", None, "x-Jan-2023", "01-Jan-ab"]
    want = [dt.date(2023, 1, 5), dt.date(1951, 2, 5), dt.date(2050, 3, 5), None, None, None, None, None, None]
    assert values(spark, clean.month_name_date, raw) == want


def test_claim_dates_pass_iso_through(spark):
    raw = ["2026-01-15T08:00", "15-Jan-2026", "NULL", "na", "soon", "2026-13-01", None]
    want = [dt.date(2026, 1, 15), dt.date(2026, 1, 15), None, None, None, None, None]
    assert values(spark, clean.claim_date, raw) == want


def test_mixed_dates_keep_unknown_text(spark):
    raw = ["20230105", "01/05/2023", "5 days ago", "NULL", ""]
    assert values(spark, clean.mixed_date_text, raw) == ["2023-01-05", "2023-01-05", "5 days ago", None, None]


def test_batch_dates(spark):
    raw = ["2024-02-30", "2024-02-29 10:00", "none", "", None, "tomorrow"]
    assert values(spark, clean.is_bad_date, raw) == [True, False, False, False, False, True]
    assert values(spark, clean.batch_date, raw) == [None, dt.date(2024, 2, 29), None, None, None, None]


def test_booleans_and_numbers(spark):
    assert values(spark, clean.parse_bool, ["Yes", "1", "y", None]) == [True, True, False, False]
    assert values(spark, lambda c: clean.parse_bool(c, True), ["Y ", "no"]) == [True, False]
    assert values(spark, clean.yes_no, ["TRUE", "0", "nan", None]) == ["Yes", "No", "", ""]
    assert values(spark, clean.parse_float, ["1.5", "nan", "", "x", None]) == [1.5, 0.0, 0.0, 0.0, 0.0]
    assert values(spark, lambda c: clean.parse_int(c, 7), ["3.9", "x"]) == [3, 7]
    assert values(spark, clean.hcc_order, ["12", "A1", None]) == [12, 999, 999]


def test_ids_are_never_cut(spark):
    assert values(spark, lambda c: clean.numbered_id("B", c, 3), [7, 1234], "bigint") == ["B007", "B1234"]


def test_collections(spark):
    raw = ['["a","b"]', "a| b ||", '{"a":1}', None, "x"]
    assert values(spark, clean.as_collection, raw) == [["a", "b"], ["a", "b"], [], [], ["x"]]


def test_age_before_and_on_birthday(spark):
    day = dt.date(2000, 6, 15)
    out = values(spark, lambda c: clean.age_at(c, F.lit(day)), [dt.date(1950, 6, 15), dt.date(1950, 6, 16)], "date")
    assert out == [50, 49]


def test_year_ranges_are_merged(spark):
    plan = spark.range(1).select(clean.in_years(F.lit("2000-01-01").cast("date"), [1998, 1999, 2001]).alias("x"))
    assert plan.first().x is False


def test_tiers_and_rounding(spark):
    assert values(spark, scores.tier, [0.75, 0.7499, 0.5, 0.1], "double") == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert values(spark, lambda c: clean.fixed_decimals(c, 2), [0.305, 1234.5], "double") == ["0.30", "1234.50"]
    assert values(spark, lambda c: scores.round_scaled(c, 2), [0.125, 0.375], "double") == [0.12, 0.38]
    argmax = lambda c: scores.argmax_label(F.array(c, c, F.lit(0.1)), ("LOW", "MEDIUM", "HIGH"))
    assert values(spark, argmax, [0.45, 0.05], "double") == ["LOW", "HIGH"]


def test_open_dates_by_their_fields(spark):
    cases = {
        "3rd March 2021": "2021-03-03", "Sept. 5, 2020 at 10:15 p.m.": "2020-09-05", "SATURDAY 05 JUNE 1999": "1999-06-05",
        "5/6/2020": "2020-05-06", "13/6/2020": "2020-06-13", "2020/25/03": None, "13/13/2020": None, "2020-02-30": None, "31.04.1999": None,
        "1/2/68": "2068-01-02", "1/2/69": "1969-01-02", "99-Feb-01": "1999-02-01", "01-99-Feb": "1999-02-01", "200305": "2020-03-05",
        "20200305T1011": "2020-03-05", "2020-03-05T10:11:12.5+02:00": "2020-03-05", "2020": "2020-01-01", "May 2020": "2020-05-01",
        "45": None, "3/45": None, "may may 2020": None, "1 2 3 2020": None, "12:30": None, "on the": None, "2020年3月5日": None, "5 maybe 2020": None,
        "x" * 50_000: None, "1-" * 5_000: None, "": None, "5/6": None, "2020-1-2-": "2020-01-02", "12345-01-02": None, "0000-01-01": None,
    }
    rows = spark.createDataFrame(list(cases.items()) + [(None, None)], "raw string, want string")
    got = rows.select("raw", "want", clean.open_date(F.col("raw")).cast("string").alias("got"))
    assert [(r.raw, r.got) for r in got.collect() if r.got != r.want] == []
