"""Joins: as-of, interval, and equi-joins on skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_of(time: Column, kind: str, width: float) -> Column:
    """The number of the ``width``-wide slice that holds a number or (in seconds) a timestamp of Spark type ``kind``."""
    number = F.unix_micros(time.cast("timestamp")) / F.lit(1e6) if kind.startswith("timestamp") else time.cast("double")
    return F.floor(number / F.lit(width)).cast("long")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], prefix: str = "", order: list[str] | None = None, width: float = 86400.0) -> DataFrame:
    """Each left row with ``values`` of the last right row of the same key at or before its time (null if none).

    Both sides are put in one stream per key and slice of ``width`` (seconds for timestamps) and the last seen
    right row is carried forward, then from slice to slice over one row for each; no pairs are made. So a key
    with most of the rows is spread over its slices. Of right rows at the same time the last by ``order``
    counts. Null keys match null keys; null times match nothing.
    """
    carried = F.struct(*[F.col(v).alias(v) for v in values])
    tie = F.struct(*[F.col(c) for c in order or values])
    lefts = left.withColumn("__time", F.col(left_time)).withColumn("__side", F.lit(1))
    rights = right.where(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("__time"), F.lit(0).alias("__side"), carried.alias("__value"), tie.alias("__tie"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    both = both.withColumn("__slice", slice_of(F.col("__time"), dict(both.dtypes)["__time"], width))
    seen = Window.partitionBy(*by, "__slice").orderBy("__time", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__last", F.last("__value", ignorenulls=True).over(seen)).where("__side = 1")

    # One row for each key and slice; the slices before a row's own give what it begins with.
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    end = F.max_by("__value", F.when(F.col("__side") == 0, F.struct("__time", "__tie"))).alias("__end")
    slices = both.groupBy(*keys, F.col("__slice").alias("__s")).agg(end)
    before = Window.partitionBy(*[f"__k{i}" for i in range(len(by))]).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("__first", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    same = F.col("__slice").eqNullSafe(F.col("__s"))
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    found = found.join(starts, same, "left")
    last = F.when(F.col("__last").isNotNull(), F.col("__last")).otherwise(F.col("__first"))
    found = found.withColumn("__last", F.when(F.col("__time").isNotNull(), last))
    return found.select(*left.columns, *[F.col(f"__last.{v}").alias(prefix + v) for v in values])


def interval_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of a point and a span with start <= point < end, and equal ``by`` columns.

    Spans are sent to every bin of ``width`` that they touch, and points to their own, so that the join is an
    equi-join on the bin. Choose a width near the usual span. Numbers or timestamps; nulls match nothing.
    """
    by = by or []

    def bin_of(c: Column) -> Column:
        return F.floor(c.cast("double") / width).cast("long")

    kinds = dict(points.dtypes)
    time = kinds[point].startswith("timestamp")
    number = (lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6) if time else F.col
    p = points.withColumn("__bin", bin_of(number(point)))
    s = spans.where(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(bin_of(number(start)), bin_of(number(end)))))
    return p.join(s, ["__bin", *by]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("__bin")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salts: int = 16, hot_share: float = 0.01, how: str = "inner") -> DataFrame:
    """An equi-join (inner or left) in which hot keys of ``big`` are dealt over ``salts`` tasks.

    A key is hot if it holds more than ``hot_share`` of the rows; there are fewer than 1 / hot_share of them,
    so their list is broadcast. Only their rows of ``small`` are copied, one for each salt.
    """
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = counts.where(F.col("__n") > max(1, hot_share * total)).select(*on, F.lit(True).alias("__hot"))

    def mark(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), on, "left").withColumn("__hot", F.coalesce("__hot", F.lit(False)))

    dealt = mark(big).withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*big.columns), F.lit(salts))).otherwise(0).cast("int")).drop("__hot")
    copied = mark(small).withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return dealt.join(copied, [*on, "__salt"], how).drop("__salt")
