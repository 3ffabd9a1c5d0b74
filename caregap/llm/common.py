"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text that a Python worker turns into objects at once, and rows that Spark sends it at once.
SLICE_BYTES = 2 << 20
BATCH_ROWS = 1000
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns cannot clash with its own."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_texts(
    df: DataFrame,
    work: Callable[..., Iterator[dict[str, list | pa.Array]]],
    schema: str,
    slice_bytes: int = SLICE_BYTES,
    keys: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Run ``work`` over (doc_id, text) rows in Arrow slices of about ``slice_bytes`` of text.

    ``work`` gets the columns named by ``keys`` and the UTF-8 texts of a slice and
    yields columns. A slice always holds whole texts, so one long text makes one
    large slice and nothing else grows with it.
    """
    arrow_schema = _arrow_schema(df.sparkSession, schema)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(batch.num_rows, int(slice_bytes * batch.num_rows / max(1, batch.nbytes))))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                texts = part.column(len(keys)).cast(pa.binary()).to_pylist()
                for columns in work(*part.columns[: len(keys)], texts):
                    yield pa.RecordBatch.from_arrays(
                        [_array(columns[f.name], f.type) for f in arrow_schema], schema=arrow_schema
                    )

    return df.select(*keys, "text").mapInArrow(run, schema)


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of ``BATCH_ROWS``, unless the session has a setting of its own.

    Spark's default of 10,000 rows makes batches of tens of megabytes of text, once
    in the JVM and once in each worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)
