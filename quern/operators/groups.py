"""Grouped operators: top rows, sessions, latest versions, slowly changing dimensions, gaps, cube-style counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.joins import slice_of


def top_per_group(df: DataFrame, by: list[str], order: list[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, with their rank from 1. Spark cuts each partition's groups to n rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def latest(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The row with the largest version of each key: a max_by of the whole row, combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    row = F.max_by(F.struct(*rest), F.struct(*version)).alias("__row")
    return df.groupBy(*key).agg(row).select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def sessions(df: DataFrame, by: list[str], time: str, gap: str, width: float = 86400.0) -> DataFrame:
    """``df`` with ``session``, numbered from 1 in each key; a new one begins after a pause of ``gap`` or more.

    Rows are numbered within slices of ``width`` seconds, and one row for each slice carries the last time and
    the number of sessions on, so that a key with most of the rows is spread over its slices. Null keys are a
    key; rows without a time come first and are one session.
    """
    rows = df.withColumn("__slice", slice_of(F.col(time), dict(df.dtypes)[time], width))
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    names = [f"__k{i}" for i in range(len(by))]
    ends = rows.groupBy(*keys, F.col("__slice").alias("__s")).agg(F.max(time).alias("__end"))
    ends = ends.withColumn("__before", F.lag("__end").over(Window.partitionBy(*names).orderBy("__s"))).drop("__end")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        same = F.col("__slice").eqNullSafe(F.col("__s"))
        for k, n in zip(by, names):
            same = same & F.col(k).eqNullSafe(F.col(n))
        return a.join(b, same).drop("__s", *names)

    w = Window.partitionBy(*by, "__slice").orderBy(time)
    last = F.coalesce(F.lag(time).over(w), F.col("__before"))
    marked = met(rows, ends).withColumn("__fresh", F.coalesce(F.col(time) - last >= F.expr(f"INTERVAL {gap}"), last.isNull() & (F.row_number().over(w) == 1)).cast("int"))
    marked = marked.withColumn("__in", F.sum("__fresh").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("__before", "__fresh")
    counts = marked.groupBy(*keys, F.col("__slice").alias("__s")).agg(F.max("__in").alias("__n"))
    before = Window.partitionBy(*names).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__sum", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return met(marked, counts).withColumn("session", F.col("__in") + F.col("__sum")).drop("__in", "__sum", "__slice")


def versions(df: DataFrame, key: list[str], time: str, watched: list[str]) -> DataFrame:
    """Type-2 history: a row for each run of equal ``watched`` values of a key, with valid_from and valid_to (null: open)."""
    w = Window.partitionBy(*key).orderBy(time, *watched)
    state = F.struct(*watched)
    starts = df.withColumn("__new", ~F.coalesce(F.lag(state).over(w).eqNullSafe(state), F.lit(False))).where("__new")
    return starts.select(*key, *watched, F.col(time).alias("valid_from"), F.lead(time).over(w).alias("valid_to"))


def salted_distinct_count(df: DataFrame, by: list[str], what: str, salts: int = 32) -> DataFrame:
    """Distinct ``what`` per group, exact, in two steps, so that a group with most rows is dealt over ``salts`` tasks."""
    parts = df.where(F.col(what).isNotNull()).select(*by, what, F.pmod(F.xxhash64(what), F.lit(salts)).alias("__salt"))
    parts = parts.groupBy(*by, "__salt").agg(F.count_distinct(what).alias("n"))
    return parts.groupBy(*by).agg(F.sum("n").alias("n"))
