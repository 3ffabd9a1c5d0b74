"""Table folder of the incremental pipeline: run partitions and keyed tables in buckets, as Parquet."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caregap.session import materialize

# Buckets of a new keyed table; a table of many terabytes wants some thousands.
BUCKETS = 64


class StaleVersion(RuntimeError):
    """Another writer published a version of the table first."""


def _bucket(key: str, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


class TableStore:
    """Tables below one root.

    Append tables are written one partition folder per run, always with
    overwrite, so a repeated attempt replaces its own rows and nothing else.
    Keyed tables are cut into buckets by a hash of their key. A version is one small
    file that names the folder of each bucket; it is published only after all data are
    written, and never over another version, so neither a lost job nor a second
    writer exposes or loses half a table. The file system's rename must refuse an
    existing target (HDFS and local folders do).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def exists(self, path: str) -> bool:
        fs, hadoop_path = self._fs(path)
        return fs.exists(hadoop_path)

    def _children(self, path: str) -> list[str]:
        fs, hadoop_path = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(hadoop_path)] if fs.exists(hadoop_path) else []

    def partition_path(self, table: str, **keys: str) -> str:
        return "/".join([self.root, table, *[f"{k}={v}" for k, v in keys.items()]])

    def write_partition(self, df: DataFrame, table: str, **keys: str) -> None:
        df.drop(*keys).write.mode("overwrite").parquet(self.partition_path(table, **keys))

    def has_partition(self, table: str, **keys: str) -> bool:
        return self.exists(self.partition_path(table, **keys) + "/_SUCCESS")

    def read_partition(self, table: str, **keys: str) -> DataFrame:
        return self.spark.read.parquet(self.partition_path(table, **keys))

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        path = f"{self.root}/{table}"
        if not self._children(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)

    # --- keyed tables -----------------------------------------------------------------

    def _manifests(self, table: str) -> list[int]:
        return [int(name[2:]) for name in self._children(f"{self.root}/{table}/versions") if name.startswith("v=")]

    def _manifest(self, table: str, version: int) -> dict:
        fs, path = self._fs(f"{self.root}/{table}/versions/v={version}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest_version(self, table: str) -> int:
        return max(self._manifests(table), default=0)

    def snapshot(self, table: str) -> DataFrame | None:
        version = self.latest_version(table)
        return self._read_buckets(self._manifest(table, version)) if version else None

    def _read_buckets(self, manifest: dict, numbers: Iterable[int] | None = None) -> DataFrame:
        return self._read_folders(manifest["schema"], [f for b, f in manifest["folders"].items() if numbers is None or int(b) in numbers])

    def _read_folders(self, schema: dict, folders: list[str]) -> DataFrame:
        fields = T.StructType.fromJson(schema)
        return self.spark.read.schema(fields).parquet(*folders) if folders else self.spark.createDataFrame([], fields)

    @staticmethod
    def bucket_numbers(rows: DataFrame, key: str, count: int) -> set[int]:
        """Buckets that the rows' keys fall into: at most ``count`` numbers reach the driver."""
        return {r[0] for r in rows.select(_bucket(key, count)).distinct().collect()}

    def write_buckets(self, rows: DataFrame, table: str, key: str, count: int) -> dict[int, str]:
        """Write rows to a new folder and return the folder of each bucket; a version must name them to make them seen."""
        folder = f"{self.root}/{table}/data/{uuid.uuid4().hex}"
        # Keys spread evenly over buckets; the hint lets Spark cut a large bucket into several files and join small ones.
        rows.withColumn("_bucket", _bucket(key, count)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in self._children(folder) if n.startswith("_bucket=")}

    def upsert(
        self, changes: DataFrame, table: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
        buckets: int = BUCKETS,
    ) -> int:
        """Merge ``changes`` into a table kept by buckets of ``key``, and return the table's new version.

        Only buckets that a key of ``changes`` falls into are read, given to
        ``merge(stored, changes)`` and written; the others keep their files.
        ``merge`` must keep the key of every row (a null key is a bucket's key like
        any other); without it, or for a new table, the rows of ``changes`` are
        written as they are. The bucket count of the first version stays. A run
        without changes makes no version. If another writer finished a version in the
        meantime, ``StaleVersion`` is raised and nothing changes.
        """
        version = self.latest_version(table)
        old = self._manifest(table, version) if version else None
        count = old["buckets"] if old else buckets
        changes = materialize(changes)
        touched = self.bucket_numbers(changes, key, count)
        if not touched and old:
            return version
        merged = merge(self._read_buckets(old, touched), changes) if old and merge else changes
        left = self.write_buckets(merged, table, key, count)
        kept = {int(b): f for b, f in old["folders"].items() if int(b) not in touched} if old else {}
        stray = set(left) - touched
        if stray:
            raise ValueError(f"merge moved rows of {table} into buckets that were not read: {sorted(stray)}")
        self._commit(table, version + 1, {"buckets": count, "schema": merged.schema.jsonValue(), "folders": kept | left})
        return version + 1

    def _commit(self, table: str, version: int, manifest: dict) -> None:
        """Publish a version: a finished file gets its name, which fails where the name is taken."""
        fs, target = self._fs(f"{self.root}/{table}/versions/v={version}")
        _, draft = self._fs(f"{self.root}/{table}/versions/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), gateway.new_array(rename, 0))
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise StaleVersion(f"version {version} of {table} was written by another run") from error
            raise
