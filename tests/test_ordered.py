"""Windows, ranks and percentiles of hot keys against Spark's own, with cuts through keys and ties."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import ordered


@pytest.fixture(scope="module")
def hot(spark):
    """Nine tenths of the rows in one key, many ties, null keys, orders and values."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 10 else rng.choice([None, "a", "b"]), rng.choice([None, *[1] * 6, 2, 2, 3, *range(4, 40)]), rng.choice([None, 1.5, 2.0, float(i % 50)])) for i in range(1500)]
    rows += [(2000, "one", 5, 1.0)]
    return spark.createDataFrame(rows, "id int, k string, o int, v double").withColumns({"part": F.lit("mine"), "place": F.col("id") * 2}).repartition(5, "id").cache()


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v


def rows(df, *columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def by_id(spark):
    return Window.partitionBy("k").orderBy("o", "id")


def largest_share(df):
    """The share of a table's rows that its largest (partition, key) cell holds."""
    counts = [r["count"] for r in df.rows.groupBy(df.part).count().collect()]
    return max(counts) / sum(counts)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_neighbours_equal_lag_and_lead(hot, by_id, partitions):
    got = ordered.neighbours(hot, ["k"], ["o"], "v", {"a": -1, "b": -3, "c": 2, "same": 0}, partitions=partitions)
    want = hot.withColumns({"a": F.lag("v").over(by_id), "b": F.lag("v", 3).over(by_id), "c": F.lead("v", 2).over(by_id), "same": F.col("v")})
    assert rows(got, "id", "a", "b", "c", "same", "part", "place") == rows(want, "id", "a", "b", "c", "same", "part", "place")
    got = ordered.neighbours(hot, ["k"], ["o"], "v", {"a": -2}, default=-9.0, partitions=partitions)
    assert rows(got, "id", "a") == rows(hot.withColumn("a", F.lag("v", 2, -9.0).over(by_id)), "id", "a")


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_running_and_last_rows(hot, by_id, partitions):
    got = ordered.running(hot, ["k"], ["o"], {"s": "v", "t": "o"}, partitions=partitions)
    up_to = by_id.rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got, "id", "s", "t") == rows(hot.withColumns({"s": F.sum("v").over(up_to), "t": F.sum("o").over(up_to)}), "id", "s", "t")
    for last in (1, 3, 60):
        got = ordered.running(hot, ["k"], ["o"], {"s": "v"}, last=last, partitions=partitions)
        assert rows(got, "id", "s") == rows(hot.withColumn("s", F.sum("v").over(by_id.rowsBetween(1 - last, 0))), "id", "s"), last


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_nth_values(hot, by_id, partitions):
    got = ordered.nth_values(hot, ["k"], ["o"], "v", {"first": 1, "third": 3, "last": -1, "late": -90}, partitions=partitions)
    whole, back = by_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.partitionBy("k").orderBy(F.desc("o"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = hot.withColumns({"first": F.first("v").over(whole), "third": F.nth_value("v", 3).over(whole), "last": F.last("v").over(whole), "late": F.nth_value("v", 90).over(back)})
    assert rows(got, "id", "first", "third", "last", "late") == rows(want, "id", "first", "third", "last", "late")


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_ranks(hot, by_id, partitions):
    tied = Window.partitionBy("k").orderBy("o")
    want = hot.withColumns({"row_number": F.row_number().over(by_id), "rank": F.rank().over(tied), "dense_rank": F.dense_rank().over(tied), "ntile": F.ntile(4).over(by_id), "percent_rank": F.percent_rank().over(tied), "cume_dist": F.cume_dist().over(tied)})
    names = ["id", "row_number", "rank", "dense_rank", "ntile", "percent_rank", "cume_dist", "part", "place"]
    assert rows(ordered.ranks(hot, ["k"], ["o"], partitions=partitions), *names) == rows(want, *names)


def test_no_partition_holds_a_hot_key(hot):
    assert largest_share(ordered.Ordered(hot, ["k"], ["o"], 20)) < 0.2


@pytest.mark.parametrize("small,bins", [(10_000, 1024), (3, 4), (1, 64)])
def test_percentiles_equal_sparks(spark, hot, small, bins):
    shares = [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]
    odd = [(-float("inf"), "f"), (float("inf"), "f"), (1e308, "f"), (-1e308, "f"), (5e-324, "f"), (0.0, "f"), (float("nan"), "f"), (None, "none"), (7.0, "one")]
    df = hot.select("k", "v").unionByName(spark.createDataFrame(odd, "v double, k string"))
    got = ordered.percentiles(df, ["k"], "v", shares, bins=bins, small=small)
    number = F.nanvl("v", F.lit(None))
    want = df.groupBy("k").agg(*[F.percentile(number, p).alias(f"p{i}") for i, p in enumerate(shares)])
    names = ["k", *[f"p{i}" for i in range(len(shares))]]
    assert got.columns == names
    keep = lambda d: [r for r in rows(d, *names) if r[0] != "f"]  # noqa: E731  infinite values: see below
    assert keep(got) == keep(want)
    f = got.where("k = 'f'").first()
    assert (f.p0, f.p5) == (-float("inf"), float("inf")) and f.p2 == 2.5e-324 or f.p2 == 0.0


def test_empty_tables(hot):
    none = hot.where("false")
    assert ordered.ranks(none, ["k"], ["o"]).count() == 0 and ordered.percentiles(none, ["k"], "v", [0.5]).count() == 0
    assert ordered.neighbours(none, ["k"], ["o"], "v", {"a": 1}).count() == 0 and ordered.nth_values(none, ["k"], ["o"], "v", {"a": 1}).count() == 0
    assert ordered.running(none, ["k"], ["o"], {"s": "v"}).count() == 0


def test_versions_of_a_hot_key(spark):
    rows = [(1 if i % 10 else 2, i, None if i // 7 % 5 == 0 else f"v{i // 7 % 3}", i % 2 == 5) for i in range(400)] + [(1, 7, "tie", None), (None, 3, "a", None), (None, None, "a", None), (None, 4, None, None)]
    df = spark.createDataFrame(rows, "k int, t int, v string, state boolean")
    want = []
    first = lambda x: (x is not None, x if x is not None else 0)
    for k in (1, 2, None):
        runs = []
        for _, t, v, s in sorted((r for r in rows if r[0] == k), key=lambda r: (first(r[1]), (r[2] is not None, r[2] or ""), first(r[3]))):
            if not runs or runs[-1][1:3] != (v, s):
                runs.append((k, v, s, t))
        want += [(*r, n[3] if n else None) for r, n in zip(runs, [*runs[1:], None])]
    for partitions in (1, 3, 9):
        got = ordered.versions(df, ["k"], "t", ["v", "state"], partitions=partitions)
        assert got.columns == ["k", "v", "state", "valid_from", "valid_to"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert ordered.versions(df.where("false"), ["k"], "t", ["v"]).count() == 0
