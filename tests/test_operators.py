"""Operators, sources and streams on small tables with nulls, ties and late rows."""

import datetime as dt
import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern import functions as Q
from quern import sources, streaming
from quern.operators import custom, groups, joins
from quern.plans import frames

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_asof_join_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, None, 9), (4, "b", 3), (5, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 20), ("a", 5, 21), (None, 9, 30), ("a", None, 40)], "k string, t int, v int")
    assert rows(joins.asof_join(left, right, ["k"], "t", "t", ["v"]).select("id", "v")) == [(1, 21), (2, None), (3, 30), (4, None), (5, None)]


def test_asof_join_and_sessions_carry_over_slices(spark):
    lefts = [(i, "ab"[i % 2] if i % 5 else None, at(i * 37 % 4000) if i % 11 else None) for i in range(200)]
    rights = [(i, "ab"[i % 2] if i % 4 else None, at(i * 91 % 4000) if i % 13 else None) for i in range(60)]
    left, right = spark.createDataFrame(lefts, "id int, k string, t timestamp"), spark.createDataFrame(rights, "v int, k string, t timestamp")
    want = []
    for i, k, t in lefts:
        met = [(u, v) for v, kk, u in rights if kk == k and u is not None and t is not None and u <= t]
        want.append((i, max(met)[1] if met else None))
    for width in (600.0, 7200.0, 1e9):
        assert rows(joins.asof_join(left, right, ["k"], "t", "t", ["v"], width=width).select("id", "v")) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    plain = rows(groups.sessions(left, ["k"], "t", "60 MINUTES", width=1e9).select("id", "session"))
    assert len({r[1] for r in plain}) > 2
    for width in (600.0, 5000.0):
        assert rows(groups.sessions(left, ["k"], "t", "60 MINUTES", width=width).select("id", "session")) == plain


def test_batch_map_normalises(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r.digest for r in frames.batch_map(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: hashlib.md5(unicodedata.normalize("NFD", t).encode()).hexdigest() for i, t in texts.items()}


def test_bucketed_tables_join_without_a_shuffle(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7 % 100).alias("v"))
    for name in ("bucketed_a", "bucketed_b"):
        sources.write_bucketed(df, name, 4, "id")
    joined = spark.table("bucketed_a").hint("merge").join(spark.table("bucketed_b"), "id")
    assert joined.count() == 1000 and "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    for name in ("bucketed_a", "bucketed_b"):
        spark.sql(f"DROP TABLE {name}")


def test_null_semantics(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (None,)], "k int")
    assert rows(spark.sql("SELECT k FROM {a} WHERE k NOT IN (SELECT k FROM {b})", a=a, b=b)) == []
    assert rows(spark.sql("SELECT k FROM {a} WHERE NOT EXISTS (SELECT 1 FROM {b} WHERE {b}.k = {a}.k)", a=a, b=b)) == [(2,), (None,)]
    assert rows(a.intersect(b)) == [(1,), (None,)] and rows(a.subtract(b)) == [(2,)]
    g = spark.createDataFrame([("x", None), ("x", None), (None, 3)], "g string, v int").groupBy("g").agg(F.sum("v"), F.count("v"), F.max("v"))
    assert rows(g) == [("x", None, 0, None), (None, 3, 1, 3)]


def test_interval_join_equals_the_pairwise_join(spark):
    points = spark.range(200).select(F.col("id").alias("p"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    spans = spark.range(60).select(F.col("id").alias("s"), (F.col("id") * 13 % 97).cast("double").alias("a"), (F.col("id") * 13 % 97 + F.col("id") % 9).cast("double").alias("b"))
    got = joins.interval_join(points, spans, "x", "a", "b", 4.0).select("p", "s")
    want = points.join(spans, (F.col("x") >= F.col("a")) & (F.col("x") < F.col("b"))).select("p", "s")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_the_plain_join(spark, how):
    big = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 20).alias("k"))
    small = spark.createDataFrame([(0, "x"), (0, "y"), (3, "z")], "k long, v string")
    assert rows(joins.salted_join(big, small, ["k"], how=how).select("id", "k", "v")) == rows(big.join(small, "k", how).select("id", "k", "v"))


def test_groups(spark):
    df = spark.createDataFrame([("a", at(0), "x"), ("a", at(10), "x"), ("a", at(50), "y"), ("b", at(0), "x"), ("b", at(30), None)], "k string, t timestamp, s string")
    assert [r[1] for r in rows(groups.sessions(df, ["k"], "t", "30 MINUTES").select("t", "session").orderBy("t"))] == [1, 1, 1, 2, 2]
    assert rows(groups.versions(df, ["k"], "t", ["s"])) == [("a", "x", at(0), at(50)), ("a", "y", at(50), None), ("b", "x", at(0), at(30)), ("b", None, at(30), None)]
    assert rows(groups.latest(df, ["k"], ["t"])) == [("a", at(50), "y"), ("b", at(30), None)]
    assert rows(groups.salted_distinct_count(df, ["k"], "s")) == [("a", 2), ("b", 1)]
    assert groups.top_per_group(df, ["k"], ["t"], 1).count() == 2


def test_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], " a  b\n")], "a array<float>, b array<float>, t string")
    r = df.select(Q.dot("a", "b"), Q.cosine("a", "b"), Q.euclidean("a", "b"), Q.words("t")).first()
    assert r[0] == 24 and abs(r[1] - 0.96) < 1e-12 and abs(r[2] - 2**0.5) < 1e-12 and r[3] == ["a", "b"]


@pytest.mark.parametrize("fmt", sorted(sources.FORMATS))
def test_formats_round_trip(spark, tmp_path, fmt):
    df = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    df = df.select("n_name") if fmt == "text" else df
    sources.write(df, fmt, f"file://{tmp_path}/out")
    back = sources.read(spark, fmt, f"file://{tmp_path}/out", df.schema)
    assert back.exceptAll(df).isEmpty() and back.count() == df.count()


def test_partitioned_write_prunes(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    sources.write(df, "parquet", f"file://{tmp_path}/out", partition_by=["n_regionkey"])
    back = spark.read.parquet(f"file://{tmp_path}/out").where("n_regionkey = 1")
    assert "PartitionFilters: [isnotnull(n_regionkey" in back._jdf.queryExecution().toString()
    assert back.count() == df.where("n_regionkey = 1").count()


def test_python_source(spark):
    spark.dataSource.register(sources.CalendarSource)
    days = spark.read.format("calendar").option("start", "2024-02-27").option("days", 4).load()
    assert [str(r.day) for r in days.orderBy("day").collect()] == ["2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01"]


def test_late_rows_are_dropped(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    schema = "event_id long, ts timestamp"
    for i, batch in enumerate([[(1, at(0)), (2, at(100))], [(3, at(5)), (4, at(95))], [(5, at(300))]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        if i == 0:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    counted = streaming.tumbling_counts(stream, "1 hour", "10 minutes")
    got = rows(streaming.drain(spark, counted, "append", f"file://{tmp_path}"))
    assert got in ([(at(0), 1), (at(60), 2)], [(at(0), 2), (at(60), 2)])  # files of one second may come in either order


def test_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(f"file://{tmp_path}/in")
    assert streaming.drain(spark, streaming.drop_repeats(stream, ["event_id"]), "append", f"file://{tmp_path}").count() == 0


def test_standardised_values_without_whole_groups_in_python(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("a", float("nan")), ("b", 5.0), ("b", 5.0), (None, 2.0), (None, 6.0)], "k string, x double")
    got = custom.standardised(df, ["k"], "x")
    assert got.columns == ["k", "x", "z"] and "InPandas" not in got._jdf.queryExecution().toString()
    assert rows(got.select("k", "z")) == rows(spark.createDataFrame([("a", -1.0), ("a", 1.0), ("a", None), ("a", None), ("b", 0.0), ("b", 0.0), (None, -1.0), (None, 1.0)], "k string, z double"))


def test_paired_counts_take_a_row_a_key(spark, monkeypatch):
    sides = []
    paired = custom.paired_groups
    monkeypatch.setattr(custom, "paired_groups", lambda left, right, *a: sides.extend([left, right]) or paired(left, right, *a))
    assert frames.cogroup_map(spark, "/root/testdata/sf0.001").count() == 25
    assert all(s.count() == s.select("nation").distinct().count() for s in sides)


def test_no_sketch_stands_for_each_distinct_value(spark, tmp_path):
    rows = [("A", 1), ("A", 1), ("A", 2), ("A", None), ("N", None), (None, 3), (None, 3)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = frames.agg_approx_distinct(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=str) == [("A", 2, True), ("N", 0, True), (None, 1, True)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    sketched = [line.split("functions=")[0] for line in plan.splitlines() if "functions=" in line and "approx_count_distinct" in line.split("functions=")[1]]
    assert sketched and not any("l_partkey" in keys for keys in sketched), plan
