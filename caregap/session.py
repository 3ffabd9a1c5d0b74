"""Session settings the library relies on. No session is created here except for tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that fit the plans in this package. Each is set only where
# the session still has Spark's default, so cluster settings win.
_RUNTIME = {
    # Oracle comparison and the date rules both assume UTC.
    "spark.sql.session.timeZone": "UTC",
    # A hot member or code must be split even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # collect_set runs on bounded vocabularies only (codes, sources, dates), so
    # hash aggregation may hold many small groups before it falls back to sort.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    explicit = dict(spark.sparkContext.getConf().getAll())
    for key, value in _RUNTIME.items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints: the cluster's own, else (tests, local runs) a temporary one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="caregap-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and go on from the stored rows.

    The rows are written as a Parquet table in the checkpoint folder, which
    survives lost executors and lets each later use read only its columns. The
    table is deleted when the driver ends, or earlier by ``release``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    fs, hadoop_path = _file_system(spark, path)
    df.write.parquet(path)
    fs.deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Delete one table of ``materialize`` before the session ends; frames that read it are no longer usable."""
    for folder in {name.rsplit("/", 1)[0] for name in stored.inputFiles()}:
        fs, hadoop_path = _file_system(stored.sparkSession, folder)
        fs.delete(hadoop_path, True)


def release(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` stored in this session; frames that read them are no longer usable."""
    fs, hadoop_path = _file_system(spark, f"{ensure_checkpoint_dir(spark)}/tables")
    fs.delete(hadoop_path, True)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and keeps partitions and their row order."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def local_session(cpus: int | str = "*", app: str = "caregap", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return apply_defaults(spark)
