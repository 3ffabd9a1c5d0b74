"""Exact duplicates: group by a 128-bit content hash, compare the bytes, keep one stable id."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregap.llm.common import map_texts, texts_only

_FINGERPRINTS = "doc_id bigint, norm binary, h128 binary, sha256 string"


def _fingerprints(ids: pa.Array, texts: list[bytes | None]):
    norm = [(t or b"").lower() for t in texts]  # bytes.lower() touches A-Z only
    yield {
        "doc_id": ids,
        "norm": norm,
        "h128": [hashlib.md5(t, usedforsecurity=False).digest() for t in norm],
        "sha256": [hashlib.sha256(t).hexdigest() for t in norm],
    }


def duplicate_classes(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the row of its class that stays.

    Texts are equal when their bytes are equal after lower-casing A-Z; a null
    text counts as empty. ``keep`` is ``min`` or ``max``: the smallest or largest
    id of the class stays.

    Classes are groups on (hash, normalised bytes): Spark's grouping compares the
    bytes themselves, so two texts that share a 128-bit hash are two classes.
    Partial aggregation folds the copies of a hot class before the shuffle. The
    class is brought back to its documents by the pair of digests (128 and 256
    bits); that join has no further grouping above it, so a hot class can be split.

    Defined cases: a null id takes part in its class and stays only if no other
    row has an id; rows that repeat id and text all count in ``group_size`` and
    only the first of them has ``kept``; an empty table gives no rows; other
    columns of ``docs`` are not read.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    pick: dict[str, Column] = {"min": F.min("doc_id"), "max": F.max("doc_id")}
    rows = map_texts(texts_only(docs, id_col, text_col), _fingerprints, _FINGERPRINTS)
    classes = (
        rows.groupBy("h128", "norm", "sha256")
        .agg(pick[keep].alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h128", "sha256", "keep_id", "group_size")
    )
    # Rows with the same id and text are one entry with a number of copies.
    entries = rows.groupBy("doc_id", "h128", "sha256").agg(F.count(F.lit(1)).alias("copies"))
    return (
        entries.join(classes, ["h128", "sha256"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.col("sha256").alias("text_sha256"),
        )
    )


def drop_duplicates(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Ids must be unique here."""
    stay = duplicate_classes(docs, keep, id_col, text_col).filter("kept").select(F.col("doc_id").alias(id_col))
    return docs.join(stay, id_col, "left_semi")
