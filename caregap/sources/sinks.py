"""Writers: fixed column order, partitioned append, full reload, JSON lines and the review export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.functions import text

EXPORT_HEADERS = {
    "review_id": "Review ID", "bene_id": "Bene ID", "hcc_v28": "HCC Code", "decision": "Decision",
    "reviewer_timestamp": "Timestamp", "notes": "Notes",
}
DECISION_COLUMNS = (
    "suspect_id", "bene_id", "hcc_v28", "suspect_type", "priority_score", "decision", "notes", "reviewer_timestamp",
)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """CSV with a fixed column order; arrays become JSON text."""
    types = dict(df.dtypes)
    shown = [F.to_json(c).alias(c) if types[c].startswith(("array", "struct", "map")) else F.col(c) for c in columns]
    df.select(*shown).write.mode(mode).csv(path, header=True, quote='"', escape='"')


def append_partitioned(df: DataFrame, path: str, by: str = "run_id") -> None:
    """Append, one folder per value of ``by``."""
    df.write.mode("append").partitionBy(by).parquet(path)


def reload_table(df: DataFrame, path: str) -> None:
    """Full, repeatable reload."""
    df.write.mode("overwrite").parquet(path)


def write_payloads(records: DataFrame, path: str) -> None:
    """Versioned envelope, one JSON object per line: the header fields beside each candidate record."""
    header = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in text.ENVELOPE.items()]))
    # The record is JSON text already; it is embedded as it is instead of being parsed again.
    line = F.concat(F.regexp_replace(header, r"\}$", ',"candidate":'), F.col("input_payload"), F.lit("}"))
    records.select(line.alias("value")).write.mode("overwrite").text(path)


def export_reviews(reviews: DataFrame, path: str) -> None:
    """Audit export with display headers; quotes inside notes are doubled."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(h) for c, h in EXPORT_HEADERS.items()]
    reviews.select(*shown).write.mode("overwrite").csv(path, header=True, quoteAll=True, quote='"', escape='"')


def append_decisions(decisions: DataFrame, path: str) -> None:
    decisions.select(*DECISION_COLUMNS).write.mode("append").parquet(path)
