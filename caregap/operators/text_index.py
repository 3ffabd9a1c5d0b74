"""Substring search over an index of three-letter terms; hits are checked against the texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caregap.operators import review
from caregap.session import materialize

GRAM = 3
# A posting block holds the places of at most this many rows, so its arrays are bounded.
BLOCK_BITS = 12
# Folders of terms and of rows: what a search can leave unread. Their numbers are all that reaches the driver.
TERM_FOLDERS = 64
ROW_FOLDERS = 256
# Stands between the columns of a row, so that no term reaches over two of them unless it holds this character.
BETWEEN = "\x1f"
POSTINGS = "gram string, block bigint, offsets array<int>, folder int"


def grams_of(text: Column) -> Column:
    """Distinct runs of three characters; linear in the text."""
    letters = F.split(text, "")
    rest = F.size(letters)
    second, third = (F.slice(letters, F.lit(i), rest) for i in (2, 3))
    pairs = F.zip_with(letters, second, lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(F.zip_with(pairs, third, lambda a, b: F.concat(a, b)), lambda g: g.isNotNull()))


def _folder_of(gram: str) -> int:
    return zlib.crc32(gram.encode()) % TERM_FOLDERS


class TextIndex:
    """Rows with an index on the lower-case text of some columns, as Parquet below one root.

    ``postings`` hold per term and block of 4,096 rows the sorted places of the rows
    that contain it; a search reads the folders and row groups of its terms,
    intersects the places block by block, and checks the exact condition on the
    rows found. A term below three characters has no grams: the rows are scanned.
    Defined cases: null columns hold nothing; equal rows are all returned; an empty
    table gives no rows; stored column names may be any, also those of the index.
    """

    def __init__(self, spark: SparkSession, root: str, columns: Sequence[str]):
        self.spark, self.root, self.columns = spark, root.rstrip("/"), list(columns)

    @classmethod
    def build(cls, rows: DataFrame, root: str, columns: Sequence[str]) -> TextIndex:
        index = cls(rows.sparkSession, root, columns)
        # Stored before it is used twice: row numbers stay the same whatever is computed again.
        placed = materialize(rows.select(F.monotonically_increasing_id().alias("place"), F.struct("*").alias("row")))
        block = F.shiftright("place", BLOCK_BITS)
        segment = F.pmod(F.xxhash64(block), F.lit(ROW_FOLDERS)).cast("int").alias("segment")
        # An empty table leaves no folder to read a schema from.
        placed.limit(0).write.parquet(f"{index.root}/layout")
        placed.select("place", "row", segment).hint("rebalance", "segment").write.partitionBy("segment").parquet(f"{index.root}/rows")
        text = F.concat_ws(BETWEEN, *[F.lower(F.col("row")[c].cast("string")) for c in index.columns])
        offset = F.col("place").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
        postings = (
            placed.select(block.alias("block"), offset.alias("offset"), F.explode(grams_of(text)).alias("gram"))
            .groupBy("gram", "block")
            .agg(F.array_sort(F.collect_set("offset")).alias("offsets"))
            .withColumn("folder", F.pmod(F.crc32("gram"), F.lit(TERM_FOLDERS)).cast("int"))
        )
        # Ranges of (folder, term): a common term may fill several files, and files know the terms they hold.
        postings.repartitionByRange("folder", "gram", "block").sortWithinPartitions("folder", "gram", "block").write.partitionBy(
            "folder").parquet(f"{index.root}/postings")
        return index

    def _rows(self) -> DataFrame:
        layout = self.spark.read.parquet(f"{self.root}/layout").schema
        return self.spark.read.schema(layout.add("segment", T.IntegerType())).parquet(f"{self.root}/rows")

    def postings(self, grams: Sequence[str]) -> DataFrame:
        """Posting blocks of some terms; nothing else is read."""
        stored = self.spark.read.schema(POSTINGS).parquet(f"{self.root}/postings")
        return stored.filter(F.col("folder").isin(sorted({_folder_of(g) for g in grams})) & F.col("gram").isin(sorted(grams)))

    def candidates(self, grams: Sequence[str]) -> DataFrame:
        """Places of the rows that contain all terms."""
        lists = self.postings(grams).groupBy("block").agg(F.collect_list("offsets").alias("lists")).filter(F.size("lists") == len(grams))
        common = F.aggregate("lists", F.get("lists", F.lit(0)), F.array_intersect)
        return lists.select("block", F.explode(common).alias("offset")).select(
            F.shiftleft("block", BLOCK_BITS).bitwiseOR(F.col("offset").cast("bigint")).alias("place"),
            F.pmod(F.xxhash64("block"), F.lit(ROW_FOLDERS)).cast("int").alias("segment"),
        )

    def _search(self, pieces: Sequence[str], condition: Column) -> DataFrame:
        grams = {p[i:i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)}
        rows = self._rows()
        if grams:
            found = materialize(self.candidates(sorted(grams)))
            segments = [r.segment for r in found.select("segment").distinct().collect()]
            rows = rows.filter(F.col("segment").isin(segments)).join(found.select("place"), "place", "left_semi")
        return rows.select("row.*").filter(condition)

    def contains(self, term: str) -> DataFrame:
        """Rows whose columns contain the term in any case: those of ``review.contains_any``."""
        return self._search([term.strip().lower()], review.contains_any(term, *self.columns))

    def ilike(self, term: str) -> DataFrame:
        """Rows one of whose columns matches the term with its wildcards: those of ``review.ilike_any``."""
        # The operator lower-cases both sides by Spark's rules.
        lower = self.spark.range(1).select(F.lower(F.lit(term.strip()))).first()[0]
        pieces = re.split(r"\\.|[%_\\]", lower, flags=re.DOTALL)
        return self._search(pieces, review.ilike_any(term, *self.columns))
