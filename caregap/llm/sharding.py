"""Byte-balanced shards from global prefix sums, with DataFrame functions only."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caregap.llm.common import texts_only
from caregap.session import materialize

BUCKETS = 4096


def _prefix(df: DataFrame, key: Column, order: list[str], value: str, name: str) -> DataFrame:
    """``name`` = sum of ``value`` over all rows before this one in the order (bucket of ``key``, ``order``).

    ``key`` is a hash that differs from row to row, so its top bits deal the rows
    evenly into ``BUCKETS`` runs. Each run sums its own rows; the totals of the
    runs (``BUCKETS`` rows, whatever the input) give the offsets.
    """
    rows = df.withColumn("_bucket", F.shiftrightunsigned(key, 52).cast("int"))
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_bucket")
        .agg(F.sum(value).alias("_total"))
        .select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"), "_total")
    )
    return (
        rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_bucket")  # BUCKETS rows at most
        .withColumn(name, F.col("_offset") + F.col("_inside"))
    )


def _fill(level_of: list[int], rest: int) -> list[float]:
    """Bytes that each shard still takes so that all end at one level, given what it already has."""
    ordered = sorted(level_of)
    level = min((rest + s) / (k + 1) for k, s in enumerate(accumulate(ordered)))
    return [max(0.0, level - x) for x in level_of]


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Put every document into one of ``shards`` shards of near equal size.

    The size of a document is its UTF-8 bytes (null text: none) plus ``overhead``.
    The documents are laid out in one global order; the position of each is a
    prefix sum of sizes, from totals per run of the order, and shards are the
    pieces between equal cuts, so each is a contiguous piece of the layout.

    Equal texts stay together: the copies of a text form a unit that is never cut.
    A group larger than a shard cannot; it is split into units of about an eighth
    of a shard. A document above a thirty-second of a shard is a unit too. Units
    are laid out and cut first; the other documents then fill each shard up to the
    common level, again by prefix sum and cuts. Shards therefore differ by about
    one small document, unless units alone exceed the level.

    Only ids, sizes and hashes are shuffled, and texts are read once. The driver
    receives one number per shard.

    Defined cases: null text has size ``overhead`` and crc 0, and shares a group
    with empty texts; null or repeated ids are placed like others; an empty table
    gives no rows; other columns are not read.

    Returns doc_id, size, text_crc32, law, shard, slot (0, 1, ... in the shard),
    grown_shard (null: the law is not by key).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        texts_only(docs, id_col, text_col).select(
            "doc_id",
            (F.octet_length(text) + F.lit(overhead)).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        )
    )
    key = ["h", "text_crc32", "size"]
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = max(1, total // shards)
    groups = (
        rows.groupBy(*key)
        .count()
        .filter((F.col("count") > 1) | (F.col("size") * 32 > target))
        .withColumn("bytes", F.col("count") * F.col("size"))
        .select(
            *key,
            F.when(F.col("bytes") <= target, F.lit(1)).otherwise(F.ceil(F.col("bytes") * 8 / F.lit(target))).cast("bigint").alias("units"),
        )
    )
    # Stored before anything groups on the key again, so that the join can split a hot group.
    dealt = materialize(
        rows.join(groups, key, "left").withColumn(
            "unit", F.when(F.col("units").isNotNull(), F.pmod(F.xxhash64("doc_id", "h"), F.col("units")))
        )
    )

    copies = dealt.filter("unit IS NOT NULL")
    units = materialize(copies.groupBy(*key, "unit").agg(F.sum("size").alias("bytes")))
    copied = units.agg(F.sum("bytes")).first()[0] or 0
    middle = F.col("at") + F.col("bytes") / 2
    unit_shards = _prefix(units, F.col("h"), [*key, "unit"], "bytes", "at").select(
        *key, "unit", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(max(1, copied)))).cast("int").alias("shard")
    )
    unit_shards = materialize(unit_shards)
    has = {r.shard: r.bytes for r in unit_shards.join(units, [*key, "unit"]).groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    ends = list(accumulate(_fill([has.get(s, 0) for s in range(shards)], total - copied)))
    cuts = F.array(
        *[
            F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"), F.lit(s).alias("shard"))
            for s, (a, b) in enumerate(zip([0.0, *ends[:-1]], ends, strict=True))
            if b > a
        ]
    ) if total > copied else F.expr("CAST(array() AS array<struct<lo:double,hi:double,shard:int>>)")
    # Each run of the order meets only the cuts inside it, so a row compares with few of them.
    placed = _prefix(dealt.filter("unit IS NULL"), F.col("h"), [*key, "doc_id"], "size", "at").withColumn(
        "near", F.filter(cuts, lambda c: (c["hi"] >= F.col("_offset")) & (c["lo"] <= F.col("_offset") + F.col("_total")))
    )
    middle = F.col("at") + F.col("size") / 2
    singles = placed.withColumn("hit", F.filter("near", lambda c: (c["lo"] <= middle) & (middle < c["hi"]))).select(
        "doc_id", "size", "text_crc32", F.coalesce(F.get("hit", F.lit(0))["shard"], F.element_at("near", -1)["shard"]).alias("shard")
    )
    together = copies.join(unit_shards, [*key, "unit"]).select("doc_id", "size", "text_crc32", "shard")
    return _slots(singles.unionByName(together)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard 0, 1, ... without bringing a shard into one task."""
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(256)).cast("int"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "run").count().select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("place", F.row_number().over(inside) - 1).join(starts, ["shard", "run"]).withColumn(
        "slot", (F.col("start") + F.col("place")).cast("bigint")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as one folder per shard, in slot order. Ids must be unique here."""
    where = placed.select(F.col("doc_id").alias(id_col), "shard", "slot")
    clash = {"shard", "slot"} & {c.lower() for c in docs.columns}
    docs.drop(*clash).join(where, id_col).repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions(
        "shard", "slot"
    ).write.partitionBy("shard").parquet(path)
