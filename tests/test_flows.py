"""Sources, layouts, pages, sketches and streams of many batches: that the mechanism is used, and odd input."""

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.functions import html
from quern.plans import flows
from quern.sources import files, layout
from quern.streaming import arrivals

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def grouped_file(spark, tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("groups")
    t = pa.table({"k": list(range(100)), "s": [f"v{i % 7}" if i % 5 else None for i in range(100)], "x": [float(i) for i in range(100)]})
    pq.write_table(t, folder / "a.parquet", row_group_size=10)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(files.RowGroupSource)
    return str(folder)


def test_filters_and_columns_are_pushed(spark, grouped_file):
    rows = spark.read.format("row_groups").option("path", grouped_file).option("rows", 10).option("columns", "k,s").load()
    assert rows.columns == ["k", "s"] and rows.rdd.getNumPartitions() == 10
    few = rows.where("k >= 42 and k < 58 and s is not null")
    assert few.rdd.getNumPartitions() == 2  # 40 to 59; the other row groups aren't read
    assert [r.k for r in few.orderBy("k").collect()] == [k for k in range(42, 58) if k % 5]
    assert sorted(r.k for r in rows.where("s in ('v1', 'v2') and k % 2 = 0").collect()) == [k for k in range(100) if k % 5 and k % 7 in (1, 2) and k % 2 == 0]
    assert rows.where("s like 'v3%' and k = 10").count() == 0 and rows.where("k = 1000").count() == 0 and rows.where("k <> 3").count() == 99
    reader = files.RowGroupReader({"path": grouped_file}, ["k"])
    left = list(reader.pushFilters([files.GreaterThan(("k",), 89), files.IsNotNull(("s",)), files.EqualTo(("a", "b"), 1)]))
    assert [f.attribute for f in left] == [("a", "b")] and len(reader.partitions()) == 1


def test_dimension_prunes_partitions(spark):
    df = flows.partition_pruned(spark, DATA)
    assert layout.prunes_at_run_time(df)
    assert 0 < df.select("source").distinct().count() < spark.read.parquet(f"{DATA}/documents.parquet").select("source").distinct().count()


def test_buckets_join_and_group_without_a_shuffle(spark):
    a = spark.range(1000).select(F.when(F.col("id") % 9 > 0, F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    names = [layout.bucketed(df, "k", 4) for df in (a, a.groupBy("k").agg(F.max("v").alias("m")))]
    joined = layout.grouped(layout.co_bucketed_join(*names, "k", a), "k", n=layout.count_rows(), m=F.max("m"))
    assert layout.exchanges(joined) == [] and layout.exchanges(a.groupBy("k").count())
    assert {tuple(r) for r in joined.collect()} == {tuple(r) for r in a.where("k is not null").groupBy("k").agg(F.count("k"), F.max("v")).collect()}
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def test_late_rows_are_those_that_the_stream_drops(spark):
    source = flows._late_events(spark, DATA)
    assert len(source.numbers) > 4
    got = source.run(lambda s: s.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "event_id").agg(F.count(F.lit(1)).alias("n")))
    late = source.late_rows("ts", "1 hour", "10 minutes")
    n = late.count()
    assert n > 0 and source.dropped() == n  # a row for each event, so that the metric counts rows
    kept = {r.event_id for r in got.collect()}
    assert not kept & {r.event_id for r in late.collect()} and len(kept) + n >= 1000


def test_timers_close_sessions_over_batches_and_restarts(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, "x", at(0), 0), (1, "y", at(20), 1), (1, "y", at(45), 1), (2, "x", at(44), 1), (1, "x", at(200), 2), (2, "x", at(201), 2), (3, "x", at(2000), 3)]
    name, before = arrivals.rocksdb(spark)
    try:
        found = arrivals.Arrivals(spark.createDataFrame(rows, "u int, kind string, ts timestamp, batch int")).run(lambda s: arrivals.closed_sessions(s, "u", "ts", "kind", 1800, "0 seconds"))
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp())
    assert sorted((r.key, (r.start_ms // 1000 - start) // 60, r.n, r.kinds) for r in found.collect()) == [(1, 0, 3, 2), (1, 200, 1, 1), (2, 44, 1, 1), (2, 201, 1, 1)]


def test_sketches_merge_within_their_bound(spark):
    """Small sketches, for which the estimate isn't exact: within four deviations of 1.04 / sqrt(4096)."""
    rows = spark.range(60_000).select((F.col("id") % 6).alias("day"), (F.col("id") * 7 % 23_000).alias("user"))
    days = rows.groupBy("day").agg(F.hll_sketch_agg("user", 12).alias("s"))
    for last in (0, 2, 5):
        about = days.where(F.col("day") <= last).agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n")).first().n
        true = rows.where(F.col("day") <= last).select("user").distinct().count()
        assert abs(about - true) <= 4 * 1.04 / 64 * true


@pytest.mark.parametrize(
    "page,want",
    [
        (None, (None, [], [], None)),
        ("", (None, [], [], "")),
        ("<TITLE id='a > b'>A &amp; B&#39;s\n &lt;x&gt;</TITLE><title>no</title>", ("A & B's <x>", [], [], "")),
        ("<head><script>var a='<title>x</title>'</script><title>T</title></head><body><!-- <h1>no</h1> --><h1>One <b>two</b></h1>te<b>x</b>t<p>end", ("T", ["One two"], [], "One two text end")),
        ("<a HREF='/x?a=1&amp;b=2'>L</a><a name=q>M</a><a href>N</a><a href=/y>O", (None, [], ["/x?a=1&b=2", "/y"], "LMNO")),
        ("<title>cut", ("cut", [], [], "")),
        ("<style>p{}</style><p>a<br>b</p><noscript>c</noscript>d & e &unknown; &eacute;", (None, [], [], "a b d & e &unknown; é")),
        ("<head><title>T</title><body>seen", ("T", [], [], "seen")),
    ],
)
def test_pages(page, want):
    assert html.outline_of(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("<title>A&amp</title><h1>x&amp y&copy</h1>z&ampx; &#38 &#38; &&amp;&", ("A&amp", ["x&amp y&copy"], [], "x&amp y&copy z&ampx; &#38 & &&&")),
        ("<a href='/x?a=1&copy=2&amp;b=3&amp'>L</a>", (None, [], ["/x?a=1&copy=2&b=3&amp"], "L")),
        ("<title>&copy;&COPY;&notit;&#xe9;&amp;copy;</title>", ("©©&notit;é&copy;", [], [], "")),
    ],
)
def test_entities_end_in_a_semicolon(page, want):
    assert html.outline_of(page) == want


def test_days_count_many_users_exactly(spark, tmp_path):
    """More users a day than an HLL sketch keeps exactly, scattered and negative ids, unknown users and times."""
    day = F.to_timestamp_ntz(F.lit("2024-01-01 12:00:00"))
    rows = spark.range(240_000).select(F.when(F.col("id") % 6 < 5, (F.col("id") % 70_001 - 35_000) * 1_000_003).alias("user_id"), (day + F.make_dt_interval(F.col("id") % 10)).alias("ts"))
    alone = spark.sql("SELECT CAST(NULL AS BIGINT) AS user_id, TIMESTAMP_NTZ '2024-03-01 00:00:00' AS ts UNION ALL SELECT 1, NULL")
    rows.unionByName(alone).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(flows.FLOWS["sketch_days"][1]).fetchall())
    assert sorted(map(tuple, flows.sketch_days(spark, str(tmp_path)).collect())) == want
    assert len(want) == 11 and max(n for _, n in want) > 40_000


def test_state_and_timers_grow_with_slices_instead_of_keys(spark):
    """2,000 keys in three batches, sessions that go on over a batch's end, null keys and kinds."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, "xyz"[m % 3], t0 + dt.timedelta(minutes=m), m // 200) for k in range(2000) for m in (k % 7, 20, 199 - k % 9, 201, 420)]
    rows += [(None, "x", t0, 0), (None, None, t0 + dt.timedelta(minutes=5), 0), (0, "x", t0 + dt.timedelta(days=9), 3)]
    name, before = arrivals.rocksdb(spark)
    try:
        source = arrivals.Arrivals(spark.createDataFrame(rows, "u int, kind string, ts timestamp, batch int"))
        found = source.run(lambda s: arrivals.closed_sessions(s, "u", "ts", "kind", 1800, "0 seconds"))
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    by, want = {}, []
    for k, kind, ts, _ in rows[:-1]:  # the last row's session is still open
        by.setdefault(k, []).append((ts, kind or ""))
    for k, times in by.items():
        last = dt.datetime.min
        for ts, kind in sorted(times):
            if ts - last >= dt.timedelta(minutes=30):
                want.append([k, 0, set()])
            want[-1][1] += 1
            want[-1][2] |= {kind} - {""}
            last = ts
    assert sorted(((r.key, r.n, r.kinds) for r in found.collect()), key=str) == sorted(((k, n, len(kinds)) for k, n, kinds in want), key=str)
    progress = [json.loads(p) if isinstance(p, str) else p for p in source.progress]
    held = [op["numRowsTotal"] for p in progress for op in p["stateOperators"]]
    assert 0 < max(held) <= 4 * 256
