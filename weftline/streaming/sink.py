"""The symbol index as a durable table that a change feed keeps up to date."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.streaming.index import latest_files


class IndexTable:
    """Rows ``(path, ..., dirty)`` in a folder that all executors share, in buckets of files.

    A version is a manifest, which names a folder of rows for each bucket. A batch writes the buckets that it
    touches to new folders and then its manifest under a temporary name; renaming that to ``manifest/<batch>``
    is the switch, so readers see a batch whole or not at all. A batch whose manifest is there has been
    applied: replaying it changes nothing. Rows of a batch that died before its switch are never read.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.schema = StructType.fromDDL(f"{schema}, dirty boolean")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Batches that have been applied, in order."""
        files, path = self._path("manifest")
        return sorted(int(x.getPath().getName()) for x in files.listStatus(path) if x.getPath().getName().isdigit()) if files.exists(path) else []

    def _manifest(self) -> dict[int, str]:
        done = self.versions()
        rows = self.spark.read.schema("bucket int, rows string").parquet(f"{self.folder}/manifest/{done[-1]}").collect() if done else []  # a row for each bucket
        return {r["bucket"]: r["rows"] for r in rows}

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The index as of the last batch, or some of its buckets."""
        folders = [f"{self.folder}/{where}" for b, where in self._manifest().items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def apply(self, changes: DataFrame, batch: int, extract: Callable[[DataFrame], DataFrame]) -> None:
        """Bring the index up to date with ``changes(path, op, seq, ...)``; made for ``foreachBatch``.

        ``extract`` makes the rows of changed files: ``(path, ..., failed)``, where a file that can't be read gives one
        row with ``failed`` true. Such a file keeps its old rows, marked dirty; other changed files' rows
        replace theirs, clean; removed files' rows go.
        """
        if batch in self.versions():
            return
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int").alias("bucket")
        touched = [r["bucket"] for r in changes.select(bucket).distinct().collect()]  # bounded by the number of buckets
        manifest = self._manifest()
        if touched:
            latest = latest_files(changes)
            found = extract(latest)
            failed = found.where("failed").select("path", F.lit(True).alias("_failed")).distinct()
            fresh = found.where("not failed").drop("failed").withColumn("dirty", F.lit(False))
            marked = self.rows(touched).join(changes.select("path", F.lit(True).alias("_changed")).distinct(), "path", "left").join(failed, "path", "left")
            old = marked.where("_changed is null or _failed").withColumn("dirty", F.col("dirty") | F.col("_failed").isNotNull()).drop("_changed", "_failed")
            names = self.schema.fieldNames()
            where = f"rows/{batch}-{uuid.uuid4().hex}"
            old.select(names).unionByName(fresh.select(names)).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.folder}/{where}")
            files, path = self._path(where)
            written = {int(x.getPath().getName().split("=")[1]) for x in files.listStatus(path) if x.getPath().getName().startswith("bucket=")}
            manifest = {b: at for b, at in manifest.items() if b not in touched} | {b: f"{where}/bucket={b}" for b in written}
        temporary = f"manifest/_{batch}-{uuid.uuid4().hex}"
        self.spark.createDataFrame(list(manifest.items()), "bucket int, rows string").coalesce(1).write.parquet(f"{self.folder}/{temporary}")
        (files, source), (_, target) = self._path(temporary), self._path(f"manifest/{batch}")
        if not files.rename(source, target) and batch not in self.versions():
            raise RuntimeError(f"batch {batch} could not be switched in")
