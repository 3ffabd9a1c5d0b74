"""Validation, rejection and deduplication on the way in.

"First row wins" never sorts a whole group in one task: the smallest row index
per key is a pre-aggregated minimum, and the mark travels back on the row index,
which is unique and therefore never skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caregap.functions import clean


def mark_first(df: DataFrame, key: Column, row_idx: str = "row_idx", flag: str = "is_first") -> DataFrame:
    """Flag the first row of each non-null key by a unique row index."""
    firsts = (
        df.select(key.alias("_key"), row_idx)
        .filter(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.min(row_idx).alias(row_idx))
        .select(row_idx, F.lit(True).alias(flag))
    )
    return df.join(firsts, row_idx, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def reject_duplicates(df: DataFrame, key: str, row_idx: str = "row_idx", also_required: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a ``reason``: missing key, duplicate key, or null for accepted rows."""
    needed = (key, *also_required)
    present = F.lit(True)
    for c in needed:
        present = present & (F.coalesce(clean.strip(F.col(c)), F.lit("")) != "")
    marked = mark_first(df, F.when(present, clean.strip(F.col(key))), row_idx)
    return marked.withColumn(
        "reason",
        F.when(~present, F.lit("Missing " + " or ".join(needed))).when(
            ~F.col("is_first"), F.concat(F.lit(f"Duplicate {key}: "), clean.strip(F.col(key)))
        ),
    ).drop("is_first")


def reject_missing(df: DataFrame, key: str) -> DataFrame:
    blank = F.coalesce(clean.strip(F.col(key)), F.lit("")) == ""
    return df.withColumn("reason", F.when(blank, F.lit(f"Missing {key}")))


def bulk_load(raw: DataFrame, schema: T.StructType, key: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """Text rows of a stored table as typed columns with a ``reason`` for rejected rows.

    With ``key`` the first row per key is kept; ``required`` names further columns
    that must not be blank. Absent columns read as null, blanks become null,
    unparsable dates become null, unparsable numbers 0.
    """
    rows = raw if "row_idx" in raw.columns else raw.withColumn("row_idx", F.monotonically_increasing_id() + 1)
    absent = {f.name: F.lit(None).cast("string") for f in schema if f.name not in rows.columns}
    rows = rows.withColumns(absent) if absent else rows
    checked = reject_duplicates(rows, key, also_required=required) if key else reject_missing(rows, required[0])
    parse = {"date": clean.iso_date, "boolean": _bool_or_null, "double": clean.parse_float, "bigint": clean.parse_int}
    typed = [parse.get(f.dataType.simpleString(), clean.blank_to_null)(F.col(f.name)).alias(f.name) for f in schema]
    return checked.select("row_idx", *typed, "reason")


def _bool_or_null(c: Column) -> Column:
    return F.when(clean.blank_to_null(c).isNotNull(), clean.parse_bool(c))


def load_counters(loaded: DataFrame) -> DataFrame:
    return loaded.agg(
        F.count("*").alias("processed"), F.count_if(F.col("reason").isNull()).alias("inserted"),
        F.count("reason").alias("rejected"),
    )


def validate_batch(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Batch claims with a ``reason`` per rejected row and the typed columns for accepted ones.

    Order: missing member id, repeated claim id, bad date, unknown member. A row
    with a bad date or unknown member still reserves its claim id.
    """
    bene, claim = clean.blank_to_null(F.col("bene_id")), clean.blank_to_null(F.col("claim_id"))
    dates = [clean.blank_to_null(F.col(c)) for c in ("claim_date", "event_date") if c in rows.columns]
    typed = rows.withColumns({"bene_id": bene, "claim_id": claim, "_raw_date": F.coalesce(*dates)})
    marked = mark_first(
        typed, F.when(F.col("bene_id").isNotNull() & F.col("claim_id").isNotNull(), F.col("claim_id"))
    )
    known = members.select("bene_id", F.lit(True).alias("_known"))
    reason = (
        F.when(F.col("bene_id").isNull(), "Missing bene_id")
        .when(
            F.col("claim_id").isNotNull() & ~F.col("is_first"),
            F.concat(F.lit("Duplicate claim_id in batch: "), F.col("claim_id")),
        )
        .when(clean.is_bad_date(F.col("_raw_date")), F.concat(F.lit("Invalid claim date: "), F.col("_raw_date")))
        .when(F.col("_known").isNull(), F.concat(F.lit("Unknown bene_id: "), F.col("bene_id")))
    )
    return (
        marked.join(known, "bene_id", "left")
        .withColumn("reason", reason)
        .withColumn("claim_date", clean.batch_date(F.col("_raw_date")))
        .drop("_raw_date", "_known", "is_first")
    )


def reason_kind(reason: Column) -> Column:
    """Reason without the value behind the colon."""
    return F.substring_index(reason, ":", 1)


def batch_counters(validated: DataFrame) -> DataFrame:
    ok = F.col("reason").isNull()
    return validated.agg(
        F.count("*").alias("input_rows"),
        F.count_if(ok).alias("valid_rows"),
        F.count_if(ok).alias("inserted_rows"),
        F.count_if(~ok).alias("rejected_rows"),
    )


def rejection_summary(validated: DataFrame) -> DataFrame:
    return (
        validated.filter(F.col("reason").isNotNull())
        .groupBy(reason_kind(F.col("reason")).alias("reason"))
        .agg(F.count("*").alias("rejected_rows"))
    )


def rejection_sample(validated: DataFrame, size: int = 10) -> DataFrame:
    """The first rejected rows in file order, beside the summary."""
    refused = validated.filter(F.col("reason").isNotNull()).select("row_idx", "reason")
    return refused.orderBy("row_idx").limit(size)


def source_stats(claims: DataFrame, exploded: DataFrame) -> DataFrame:
    """Raw claims, skipped rows (no member id) and exploded diagnosis rows per source."""
    blank = F.coalesce(clean.strip(F.col("BENE_ID")), F.lit("")) == ""
    raw = claims.groupBy("source").agg(
        F.count_if(~blank).alias("raw_claims"), F.count_if(blank).alias("skipped_rows")
    )
    rows = exploded.groupBy("source").agg(F.count("*").alias("diagnosis_rows"))
    return raw.join(rows, "source", "left").na.fill(0, ["diagnosis_rows"])


def with_payload(rows: DataFrame) -> DataFrame:
    """Keep the whole input row as the raw payload, with the fields of an ``extra`` map merged in."""
    fixed = [c for c in rows.columns if c not in ("extra", "row_idx")]
    base = F.map_from_arrays(
        F.array(*[F.lit(c) for c in fixed]), F.array(*[F.col(c).cast("string") for c in fixed])
    )
    if "extra" not in rows.columns:
        return rows.withColumn("raw_payload", F.to_json(base))
    extra = F.coalesce("extra", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(extra), k), F.lit(False)))
    return rows.withColumn("raw_payload", F.to_json(F.map_concat(kept, extra))).drop("extra")


def insert_ignore(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not stored yet, one row per key; the caller appends them.

    Of several rows one whole row is kept: the one with the fewest nulls, then the smallest.
    """
    rest = [c for c in new.columns if c != key]
    blanks = sum(F.col(c).isNull().cast("int") for c in rest)
    fresh = new.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(blanks, *rest)).alias("_row")).select(
        key, *[F.col(f"_row.{c}").alias(c) for c in rest]
    )
    return fresh.join(existing.select(key), key, "left_anti")


def insert_prescriptions(new: DataFrame, existing: DataFrame, members: DataFrame) -> DataFrame:
    """Fills of known members that are not stored yet."""
    known = new.join(members.select("bene_id"), "bene_id", "left_semi").select(*new.columns)
    return insert_ignore(known, existing, "event_id")


def dedup_training_events(events: DataFrame) -> DataFrame:
    """Two-key deduplication: by event id where given, else by the seven describing columns.

    Of each group the row with the fewest nulls, then the smallest, is kept, so the result does not depend on file order.
    """
    described = F.sha2(
        F.concat_ws(
            "\x1f",
            *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in
              ("bene_id", "event_date", "hcc_v28", "code", "claim_id", "source", "is_principal")],
        ),
        256,
    )
    event_id = clean.blank_to_null(F.col("event_id"))
    key = F.coalesce(F.concat(F.lit("E:"), event_id), F.concat(F.lit("C:"), described))
    cols = ["bene_id", "event_date", "hcc_v28", "code", "claim_id", "source", "is_principal", "event_id"]
    return (
        events.groupBy(key.alias("_key"))
        .agg(F.min_by(F.struct(*cols), F.struct(sum(F.col(c).isNull().cast("int") for c in cols), *cols)).alias("_row"))
        .select(*[F.col(f"_row.{c}").alias(c) for c in cols])
    )


def file_row_numbers(staged: DataFrame, serial: str, name: str = "row_idx") -> DataFrame:
    """1, 2, ... in file order from a stored ``monotonically_increasing_id``.

    That id counts inside each partition and jumps between them; the rows of the
    earlier partitions (one number per partition) close the gaps.
    """
    part = F.shiftright(serial, 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return (
        staged.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # one row per partition
        .withColumn(name, F.col("_start") + F.col(serial).bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_part", "_start", serial)
    )
