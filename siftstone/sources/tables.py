"""Readers and writers of tables and texts, by file name, with checks of what a table must have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV, PARQUET = (".csv", ".tsv", ".txt"), (".parquet", ".pq")


def assert_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def _kind(path: str) -> str:
    name = path.rstrip("/").lower()
    if name.endswith(CSV):
        return "csv"
    if name.endswith(PARQUET):
        return "parquet"
    raise ValueError(f"{path}: the name must end in one of {', '.join(CSV + PARQUET)}")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] = (), schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header (commas, whatever its name) or Parquet. With a schema nothing is inferred."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.csv(path, header=True) if _kind(path) == "csv" else reader.parquet(path)
    return assert_columns(df, columns)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """single_file is for small reports only: it is written by one task."""
    out = (df.coalesce(1) if single_file else df).write.mode(mode)
    out.csv(path, header=True) if _kind(path) == "csv" else out.parquet(path)


def read_lines(spark: SparkSession, path: str, name: str = "smiles") -> DataFrame:
    """Trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias(name)).filter(F.length(name) > 0)


def write_lines(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL").write.mode(mode).text(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and value of each whole file whose name fits the pattern."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.input_file_name().alias("path"), "value")


def read_records(spark: SparkSession, path: str, separator: str = "$$$$\n") -> DataFrame:
    """Records that a separator line ends."""
    return spark.read.text(path, lineSep=separator).filter(F.length(F.trim("value")) > 0)


def read_metrics(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows of JSON metrics by model name; what one lacks is null. Paths that are not there are passed over, but one must be."""
    from pyspark.errors import AnalysisException

    from siftstone.operators.frames import union_tables

    found = []
    for model, path in paths.items():
        try:
            found.append(spark.read.json(path).withColumn("model", F.lit(model)))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return union_tables(found)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def only_new(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in done, for a run that goes on where one stopped."""
    return df.join(done.select(key), key, "left_anti")
