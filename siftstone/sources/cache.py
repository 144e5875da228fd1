"""Tables kept under the digest of what they were computed from, for later sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators.stats import table_fingerprint


class TableCache:
    """Entries are Parquet folders folder/kind=KIND/key=KEY; the folder must be one that all executors share.

    An entry counts once its job has been committed, so one that was cut short is computed again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, kind: str, key: str = "") -> str:
        return f"{self.folder}/kind={kind}" + (f"/key={key}" if key else "")

    def _files(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def get(self, kind: str, key: str) -> DataFrame | None:
        """The entry, or None."""
        system, done = self._files(f"{self._path(kind, key)}/_SUCCESS")
        return self.spark.read.parquet(self._path(kind, key)) if system.exists(done) else None

    def put(self, df: DataFrame, kind: str, key: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(kind, key))
        return self.spark.read.parquet(self._path(kind, key))

    def fetch(self, df: DataFrame, column: str, kind: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """compute(df), kept under the digest of the values of column; read from there if they were seen before, in any order of rows."""
        key = table_fingerprint(df, column).first().fingerprint
        found = self.get(kind, key)
        return self.put(compute(df), kind, key) if found is None else found

    def clear(self, kind: str | None = None) -> None:
        """Deletes the entries of a kind, or all of them."""
        system, at = self._files(self._path(kind) if kind else self.folder)
        system.delete(at, True)

    def inventory(self) -> DataFrame:
        """kind, entries, files, bytes and mib. Only names and sizes of files are read; an empty cache has no rows."""
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "kind string, entries long, files long, bytes long, mib double")
        cut = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
        each = files.select(cut("kind").alias("kind"), cut("key").alias("key"), "length").groupBy("kind", "key").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
        return each.groupBy("kind").agg(F.count("*").alias("entries"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes")).withColumn("mib", F.col("bytes") / 1048576)
