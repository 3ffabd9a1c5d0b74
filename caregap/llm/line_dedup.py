"""Repeated multi-line chunks, cut at content-defined line borders; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One line in MEAN_LINES ends a chunk, decided by a rolling hash over this line and the one before.
MEAN_LINES = 4
_FACTOR = 31


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def chunks(docs: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """(doc_id, version, no, start, n_lines, body) of the chunks with at least two lines that are not blank.

    ``docs`` has doc_id and text. A line ends a chunk when the rolling hash of the
    two lines up to it is 0 modulo ``mean_lines``, or when it is the last. Borders
    depend on nearby lines only, so a passage is cut alike wherever it stands.
    ``version`` tells texts under one id apart.
    """
    hashed = docs.filter("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("version"), F.split("text", "\n", -1).alias("lines")
    ).withColumn("hashes", F.transform("lines", _line_hash))
    last = F.size("lines") - 1

    def ends_chunk(i: Column) -> Column:
        rolling = F.get("hashes", i) + F.lit(_FACTOR) * F.coalesce(F.get("hashes", i - 1), F.lit(0))
        return (i == last) | (rolling % mean_lines == 0)

    cut = hashed.withColumn("ends", F.filter(F.sequence(F.lit(0), last), ends_chunk))

    def chunk(end: Column, no: Column) -> Column:
        start = F.coalesce(F.get("ends", no - 1) + 1, F.lit(0))
        part = F.slice("lines", start + 1, end - start + 1)
        return F.struct(
            no.alias("no"),
            start.alias("start"),
            (end - start + 1).alias("n_lines"),
            F.size(F.filter(part, lambda x: F.trim(x) != "")).alias("filled"),
            F.array_join(part, "\n").alias("body"),
        )

    found = cut.select("doc_id", "version", F.explode(F.transform("ends", chunk)).alias("c"))
    return found.select("doc_id", "version", "c.*").filter("filled > 1").drop("filled")


def repeated_lines(docs: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """(doc_id, version, gone): numbers of the lines to remove, for the documents that have some.

    Of equal chunks the one with the smallest (doc_id, chunk number) stays. Chunks
    are grouped on (digest, body), so the grouping compares their bytes; copies of a
    frequent chunk fold before the shuffle. The verdict returns to the places by
    digest, 64-bit hash and length, without texts; a chunk that stands in a third
    of all documents is a hot key of that join alone, which can be split. Only the
    line numbers of one document are gathered in a row.
    """
    found = chunks(docs, mean_lines).withColumns(
        {
            "digest": F.md5(F.col("body").cast("binary")),
            "hash": F.xxhash64("body"),
            "bytes": F.octet_length("body"),
            # One sortable number for (doc_id, no).
            "place": (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(12,0)") + F.col("no")).cast("decimal(38,0)"),
        }
    )
    key = ["digest", "hash", "bytes"]
    firsts = (
        found.groupBy(*key, "body")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .filter("first < last")
        .select(*key, "first")
    )
    again = found.select("doc_id", "version", "start", "n_lines", "place", *key).join(firsts, key).filter("place > first")
    return again.groupBy("doc_id", "version").agg(
        F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("n_lines") - 1))).alias("gone")
    )


def remove_repeated_lines(docs: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with ``text`` free of repeated chunks.

    Adds ``_n_lines`` and ``_n_removed``. Defined cases: a null text stays null with
    no lines; an empty text is one empty line; blank lines alone never make a
    chunk; a row with a null id stays as it is and its lines count for no other;
    rows with the same id and text are one document; of different texts under one
    id no chunk is removed on account of another at the same place; a text whose
    lines all stand elsewhere becomes empty; an empty table gives no rows.
    """
    cuts = repeated_lines(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), mean_lines)
    cuts = cuts.select(F.col("doc_id").alias("_cut_id"), F.col("version").alias("_version"), F.col("gone").alias("_gone"))
    joined = docs.join(cuts, (F.col("doc_id") == F.col("_cut_id")) & (F.xxhash64("text") == F.col("_version")), "left")
    # The lines are a column of their own: as an expression they would be cut again for every line that stays.
    joined = joined.withColumn("_lines", F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    return joined.withColumns(
        {
            "_n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("bigint"),
            "_n_removed": F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("bigint"),
            "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(
                F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
            ),
        }
    ).drop("_cut_id", "_version", "_gone", "_lines")


def line_report(docs: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """doc_id, text (what stays), n_lines, n_removed for every document."""
    return remove_repeated_lines(docs.select("doc_id", "text"), mean_lines).select(
        "doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed")
    )


ORACLE = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
    FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS m FROM lines),
cut AS (
    SELECT *, (m + {_FACTOR} * coalesce(lag(m) OVER w, 0)) % {MEAN_LINES} = 0 OR lead(i) OVER w IS NULL AS ends
    FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
    SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no
    FROM cut),
chunks AS (
    SELECT doc_id, no, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n, count(*) FILTER (trim(line) <> '') > 1 AS multi
    FROM numbered GROUP BY doc_id, no),
marked AS (SELECT *, multi AND row_number() OVER (PARTITION BY body, multi ORDER BY doc_id, no) > 1 AS gone FROM chunks)
SELECT d.doc_id,
       CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone), '') END AS text,
       coalesce(sum(n), 0)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN marked USING (doc_id) GROUP BY d.doc_id
"""
