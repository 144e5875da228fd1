"""A pyspark data source that reads pages of activity records as JSON files or over HTTP, one page for each partition."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "molecule_chembl_id string, canonical_smiles string, standard_value string, standard_units string, standard_type string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Kinds of measurement that are collected (fixed values).
KINDS = ("IC50", "Ki", "EC50")
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _parameter(f: Filter) -> tuple[str, str] | None:
    """The name and value that ask the server for a filter, or None if it has no such question."""
    column = getattr(f, "attribute", ())
    if len(column) != 1 or column[0] not in NAMES:
        return None
    name, value = column[0], getattr(f, "value", None)
    if isinstance(f, IsNull | IsNotNull):
        return f"{name}__isnull", str(isinstance(f, IsNull)).lower()
    if isinstance(f, In):
        values = list(value)
        return None if not values or any(not isinstance(v, str) or "," in v for v in values) else (f"{name}__in", ",".join(values))
    suffix = {EqualTo: "", StringStartsWith: "__startswith", StringEndsWith: "__endswith", StringContains: "__contains"}.get(type(f))
    return None if suffix is None or not isinstance(value, str) else (name + suffix, value)


class ActivityPages(DataSource):
    """Options: url (with {offset} and {limit}), query (added to each url: what the server is to filter by), limit (rows of a page), records (the field with the rows), and how many pages there are.

    Without pages, the server is asked for the number of rows (total: the dotted name of the field that
    says it). An answer without it is read to the end by one task, page after page until one is not full.
    pushdown: filters of the plan are asked of the server too (Spark needs spark.sql.python.filterPushdown.enabled
    for that); Spark checks them again, so a server that passes over a question does no harm.
    """

    @classmethod
    def name(cls) -> str:
        return "activity_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ActivityReader:
        return (AskingReader if self.options.get("pushdown", "false").lower() == "true" else ActivityReader)(self.options)


class ActivityReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.limit, self.records = options["url"], int(options.get("limit", 1000)), options.get("records", "activities")
        self.pages = int(options["pages"]) if "pages" in options else None
        self.total, self.query = options.get("total", "page_meta.total_count"), options.get("query", "")

    def _get(self, offset: int, limit: int) -> dict:
        with urlopen(self.url.format(offset=offset, limit=limit) + self.query, timeout=60) as answer:
            return json.load(answer)

    def partitions(self) -> list[InputPartition]:
        pages = self.pages
        if pages is None:
            found = self._get(0, 1)
            for part in self.total.split("."):
                found = found.get(part) if isinstance(found, dict) else None
            if found is None:
                return [InputPartition(None)]
            pages = -(-int(found) // self.limit)
        return [InputPartition(k) for k in range(pages)] or [InputPartition(-1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value == -1:  # the server has no rows
            return
        page = partition.value or 0
        while True:
            rows = self._get(page * self.limit, self.limit).get(self.records) or []
            for row in rows:
                yield tuple(None if row.get(c) is None else str(row[c]) for c in NAMES)
            if partition.value is not None or len(rows) < self.limit:
                return
            page += 1


class AskingReader(ActivityReader):
    """Asks the server for what the plan filters by."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if found := _parameter(f):
                self.query += f"{'&' if '?' in self.url + self.query else '?'}{found[0]}={quote(found[1], safe=',')}"
            yield f  # Spark checks it again


def read_activities(spark: SparkSession, url: str, kinds: Sequence[str] = KINDS, limit: int = 1000, **options: str) -> DataFrame:
    """All pages of the records of these kinds; the server is asked for them, and for filters that are put on the result. Turns filter pushdown of Python sources on in the session."""
    spark.conf.set(_PUSHDOWN, True)
    spark.dataSource.register(ActivityPages)
    rows = spark.read.format("activity_pages").options(url=url, limit=limit, pushdown=True, **options).load()
    return rows.filter(F.col("standard_type").isin(*kinds))


def collect_activities(spark: SparkSession, url: str, path: str, kinds: Sequence[str] = KINDS, limit: int = 1000, **options: str) -> DataFrame:
    """The table at path; if no finished one is there, it is read from the server first. A write that was cut short is done again."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        read_activities(spark, url, kinds, limit, **options).write.mode("overwrite").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)
