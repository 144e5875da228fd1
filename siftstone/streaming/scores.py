"""Scores, rules and parsed results on streams: they are projections without state, the same as on tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftstone.operators.docking import parse_results
from siftstone.operators.ranking import rank_candidates

FILE = "path string, modificationTime timestamp, length long, content binary"


def rank_stream(rows: DataFrame) -> DataFrame:
    return rank_candidates(rows)


def result_stream(spark: SparkSession, path: str, pattern: str = "*_dock.pdbqt") -> DataFrame:
    """Scores of result files as they arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).load(path)
    return parse_results(files.select("path", F.col("content").cast("string").alias("value")))


def new_stream(rows: DataFrame, key: str, done: DataFrame | None = None) -> DataFrame:
    """The first row of each key that comes and, if done is given, is not in that table.

    The keys seen are state of the stream: a query that is started again from its checkpoint passes over
    them. The state grows with the number of different keys (a state store on disk holds more of them).
    """
    fresh = rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")
    return fresh.dropDuplicates([key])


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str) -> StreamingQuery:
    """Takes all that has arrived and stops. sink: a folder for Parquet, or a function of each batch."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.format("parquet").start(sink) if isinstance(sink, str) else writer.foreachBatch(sink).start()
