"""Physical layouts: partitioned tables pruned at run time by a joined dimension, and bucketed tables joined without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import shared_dir


def write_partitioned(df: DataFrame, by: list[str], rows_per_file: int = 1_000_000, path: str | None = None) -> str:
    """``df`` as Parquet files in a folder for each value of ``by``; returns the path.

    Rows are dealt by ``by`` before they are written, so that a folder gets few files; a value with most of the rows is
    split by AQE's rebalancing into as many tasks as its size needs.
    """
    path = path or f"{shared_dir(df.sparkSession)}/partitioned/{uuid.uuid4().hex}"
    df.hint("rebalance", *by).write.option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)
    return path


def pruned_join(fact: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    """Joins a table partitioned by ``on`` with a filtered dimension, reading only the folders of keys that the filter left.

    Spark evaluates the dimension first and hands its keys to the scan (dynamic partition pruning). It does so by itself
    where the dimension is broadcast, which is up to its own size limit; else it estimates whether a scan for the keys pays.
    """
    return fact.join(dimension, on)


def bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None) -> str:
    """``df`` as a table of the warehouse in ``buckets`` files' groups by the hash of ``key``, sorted within; returns its name.

    Rows are dealt by the same hash first, so that each bucket is written by one task as one file. Null keys are a bucket's
    like others.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
    return name


def co_bucketed_join(left: str, right: str, on: str, like: DataFrame, how: str = "inner") -> DataFrame:
    """Joins two tables with equal buckets by ``on``: tasks merge bucket with bucket, and neither side is shuffled or sorted by a hash."""
    spark = like.sparkSession
    return spark.table(left).hint("merge").join(spark.table(right), on, how)


def grouped(table: DataFrame, key: str, **made: Column) -> DataFrame:
    """Aggregates of a bucketed table by its key, without a shuffle."""
    return table.groupBy(key).agg(*[v.alias(k) for k, v in made.items()])


def exchanges(df: DataFrame) -> list[str]:
    """The shuffles in a query's plan as it is before it runs, to see whether a layout is used."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def prunes_at_run_time(df: DataFrame) -> bool:
    """Whether the plan hands a dimension's keys to a partitioned scan."""
    return "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()


def count_rows() -> Column:
    return F.count(F.lit(1))
