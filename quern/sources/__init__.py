"""Sources and sinks: Spark's formats by name, partitioned and bucketed tables, and a Python data source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMATS = {
    "parquet": {},
    "orc": {},
    "json": {},
    "csv": {"header": "true"},
    "xml": {"rowTag": "row", "rootTag": "rows"},
    "text": {},  # one column of strings, a line each
}


def write(df: DataFrame, fmt: str, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.format(fmt).options(**FORMATS[fmt]).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, fmt: str, path: str, schema: object) -> DataFrame:
    """Reads with a given schema: nothing is inferred, so no extra pass over the data."""
    return spark.read.format(fmt).options(**FORMATS[fmt]).schema(schema).load(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str) -> None:
    """A bucketed table in the warehouse: joins and groupings on ``key`` need no shuffle of it."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


class CalendarSource(DataSource):
    """A Python source of days: ``spark.read.format("calendar").option("start", "2024-01-01").option("days", 366)``."""

    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "day date, weekday int, month int, year int"

    def reader(self, schema: object) -> DataSourceReader:
        return _CalendarReader(self.options)


class _CalendarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.start, self.days, self.parts = options.get("start", "2024-01-01"), int(options.get("days", 366)), int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        step = -(-self.days // self.parts)
        return [_Range(a, min(a + step, self.days)) for a in range(0, self.days, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        import datetime

        first = datetime.date.fromisoformat(self.start)
        for i in range(partition.low, partition.high):
            day = first + datetime.timedelta(days=i)
            yield day, day.isoweekday(), day.month, day.year
