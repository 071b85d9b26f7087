"""Operators that take Python: per group, per pair of groups, per batch, row generators and stream state.

Use them where no built-in function fits; data reaches Python in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def standardised(df: DataFrame, by: list[str], value: str, out: str = "z") -> DataFrame:
    """``df`` with (value - mean) / population deviation of its group; 0 where the group has no spread. Null and NaN values don't count.

    Groups may have any size: their moments are combined before the shuffle and joined back.
    """
    number = F.nanvl(F.col(f"`{value}`").cast("double"), F.lit(None))
    keys = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(by)]
    moments = df.groupBy(*keys).agg(F.avg(number).alias("__mean"), F.stddev_pop(number).alias("__sd"))
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    z = F.when(F.col("__sd") > 0, (number - F.col("__mean")) / F.col("__sd")).otherwise(0.0)
    return df.join(moments, same).withColumn(out, z).drop("__mean", "__sd", *[f"__k{i}" for i in range(len(by))])


def paired_groups(left: DataFrame, right: DataFrame, by: list[str], run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over the rows of both sides for each key of either. A key's rows must fit in a task: combine them before."""
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, schema)


def map_batches(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: object) -> DataFrame:
    """``run`` over Arrow batches; it may return fewer or more rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield run(b)

    return df.mapInArrow(each, schema)


@F.udtf(returnType="place int, word string")
class Words:
    """A row for each word of a text, numbered from 1."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        for i, w in enumerate((text or "").split(), 1):
            yield i, w


class RunningTotals(StatefulProcessor):
    """Per key the rows and the sum of ``value`` so far, sent on with each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, total double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        n, total = self.seen.get() if self.seen.exists() else (0, 0.0)
        for pdf in rows:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        self.seen.update((n, total))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) after each batch in which the key has rows; the state lives in RocksDB, which the session must name."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(RunningTotals(), "key long, n long, total double", "Update", "None")
