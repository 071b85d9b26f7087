"""Queries that use the library's operators, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import functions as Q
from quern import sources, streaming
from quern.operators import custom, groups, joins
from quern.session import shared_dir, table


def join_asof(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    return joins.asof_join(clicks, views, ["user_id"], "ts", "ts", ["value"], "view_", ["event_id"]).select("event_id", "view_value")


def join_interval(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    views = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("begins"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("ends"))
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.interval_join(buys, views, "ts", "begins", "ends", width=6 * 3600.0, by=["user_id"]).select("event_id", "view_id")


def join_salted(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by the supplier's nation; lines of a hot supplier would be dealt over tasks."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    return joins.salted_join(lines, suppliers, ["l_suppkey"], how="left").groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    found = groups.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return found.withColumn("rank", F.col("rank").cast("long"))


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return groups.latest(table(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"])


def sessionize(spark: SparkSession, d: str) -> DataFrame:
    return groups.sessions(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "30 MINUTES").select("event_id", "session")


def history(spark: SparkSession, d: str) -> DataFrame:
    return groups.versions(table(spark, d, "events").select("user_id", "ts", "event_type"), ["user_id"], "ts", ["event_type"])


def distinct_salted(spark: SparkSession, d: str) -> DataFrame:
    return groups.salted_distinct_count(table(spark, d, "lineitem"), ["l_returnflag"], "l_partkey")


def vec_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    scored = rows.join(asked).select("vec_id", F.round(Q.cosine("embedding", "q"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(10)


def agg_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The exact distinct count, and whether the estimate of relative deviation 0.02 lies within four deviations of it.

    A sketch of distinct values is that of all values. Both counts therefore read (flag, part) once each, and sketches stand
    for flags only; Spark's plan for both at once over the lines would carry a sketch for each flag and part.
    """
    each = table(spark, d, "lineitem").select("l_returnflag", "l_partkey").distinct()
    counted = each.groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.02).alias("about"))
    return counted.select("l_returnflag", "parts", (F.abs(F.col("about") - F.col("parts")) <= 0.08 * F.col("parts")).alias("close"))


def udaf_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """A grouped pandas UDF: each customer's mean order price without the largest and the smallest. A customer's orders fit in a task."""

    @F.pandas_udf("double")
    def trimmed(prices: pd.Series) -> float:
        return float(prices.sort_values().iloc[1:-1].mean() if len(prices) > 2 else prices.mean())

    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(trimmed("o_totalprice"), 4).alias("price"))


def formats_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The parts' names and prices, written and read in each format."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    found = []
    for fmt in sources.FORMATS:
        path = f"{shared_dir(spark)}/formats-{uuid.uuid4().hex}"
        rows = parts.select(F.concat_ws("\t", "p_partkey", "p_name").alias("value")) if fmt == "text" else parts
        sources.write(rows, fmt, path)
        back = sources.read(spark, fmt, path, rows.schema)
        if fmt == "text":
            back = back.select(F.split_part("value", F.lit("\t"), F.lit(1)).cast(parts.schema["p_partkey"].dataType).alias("p_partkey"), F.split_part("value", F.lit("\t"), F.lit(2)).alias("p_name"))
            back = back.withColumn("p_retailprice", F.lit(None).cast("double"))
        found.append(back.withColumn("format", F.lit(fmt)))
    return reduce(DataFrame.unionByName, found)


def grouped_map(spark: SparkSession, d: str) -> DataFrame:
    found = custom.standardised(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal")
    return found.select("c_custkey", F.round("z", 6).alias("z"))


def cogroup_map(spark: SparkSession, d: str) -> DataFrame:
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        key = (a if len(a) else b)["nation"].iloc[0]
        return pd.DataFrame({"nation": [key], "customers": [a["n"].sum()], "suppliers": [b["n"].sum()]})

    # A row for each nation and side, so that a group has two rows at most.
    customers = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    suppliers = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return custom.paired_groups(customers, suppliers, ["nation"], run, "nation int, customers long, suppliers long")


def batch_map(spark: SparkSession, d: str) -> DataFrame:
    """Unicode normalisation, which Spark's functions don't offer, over Arrow batches."""
    rows = table(spark, d, "documents").select("doc_id", "text")

    def normal(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.set_column(1, "text", pc.utf8_normalize(b.column("text"), "NFD"))

    return custom.map_batches(rows, normal, rows.schema).select("doc_id", F.md5("text").alias("digest"))


def udtf_words(spark: SparkSession, d: str) -> DataFrame:
    spark.udtf.register("quern_words", custom.Words)
    return spark.sql("SELECT p_partkey, w.place, w.word FROM {part} p, LATERAL quern_words(p.p_name) w", part=table(spark, d, "part"))


def udf_vectorised(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def initials(names: pd.Series) -> pd.Series:
        return names.str.split(" ").map(lambda w: "".join(x[:1] for x in w))

    return table(spark, d, "part").select("p_partkey", initials("p_name").alias("initials"))


def sql_udf(spark: SparkSession, d: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quern_net(price DOUBLE, cut DOUBLE) RETURNS DOUBLE RETURN price * (1 - cut)")
    return spark.sql("SELECT l_orderkey, l_linenumber, l_partkey, quern_net(l_extendedprice, l_discount) AS net FROM {lineitem}", lineitem=table(spark, d, "lineitem"))


def stream_state(spark: SparkSession, d: str) -> DataFrame:
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        totals = custom.running_totals(streaming.as_stream(spark, d, "events"), "user_id", "value")
        last = groups.latest(streaming.drain(spark, totals, "update", shared_dir(spark)), ["key"], ["n"])
    finally:
        spark.conf.set(provider, before)
    return last.select(F.col("key").alias("user_id"), "n", F.round("total", 6).alias("total"))


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    counted = streaming.tumbling_counts(streaming.as_stream(spark, d, "events"), by=["event_type"])
    return streaming.drain(spark, counted, "complete", shared_dir(spark)).withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_session(spark: SparkSession, d: str) -> DataFrame:
    counted = streaming.session_counts(streaming.as_stream(spark, d, "events"), "user_id")
    return streaming.drain(spark, counted, "complete", shared_dir(spark)).withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    stream = streaming.drop_repeats(streaming.as_stream(spark, d, "events").select("event_id", "user_id", "ts"), ["event_id"])
    return streaming.drain(spark, stream, "append", shared_dir(spark)).select("event_id", "user_id")


def stream_interval_join(spark: SparkSession, d: str) -> DataFrame:
    views = streaming.as_stream(spark, d, "events").where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("begins"))
    buys = streaming.as_stream(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return streaming.drain(spark, streaming.interval_join(views, buys, "user_id", "begins", "ts", "6 HOURS"), "append", shared_dir(spark)).select("event_id", "view_id")


_PAIRS = """SELECT b.event_id, v.event_id AS view_id FROM events b JOIN events v ON b.user_id = v.user_id AND b.ts >= v.ts AND b.ts < v.ts + INTERVAL 6 HOUR
WHERE b.event_type = 'purchase' AND v.event_type = 'view'"""
_FRESH = "CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh"
_SESSIONS = f"SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, {_FRESH} FROM events)"

#: name: (query, DuckDB SQL; None where there is no exact result)
FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "join_asof": (
        join_asof,
        """SELECT c.event_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'click') c
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts""",
    ),
    "join_interval": (join_interval, _PAIRS),
    "join_salted": (
        join_salted,
        "SELECT s_nationkey AS nation, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    ),
    "top_per_group": (
        top_per_group,
        """SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
        FROM orders) WHERE rank <= 3""",
    ),
    "latest_per_key": (
        latest_per_key,
        "SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    ),
    "sessionize": (sessionize, f"SELECT event_id, session FROM ({_SESSIONS})"),
    "history": (
        history,
        """SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER w AS valid_to FROM
        (SELECT *, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)) WHERE before IS DISTINCT FROM event_type
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)""",
    ),
    "distinct_salted": (distinct_salted, "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag"),
    "vec_cosine_topk": (
        vec_cosine_topk,
        """SELECT e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))
        * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS score
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 10""",
    ),
    "agg_approx_distinct": (agg_approx_distinct, "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS close FROM lineitem GROUP BY l_returnflag"),
    "grouped_map": (
        grouped_map,
        """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 6) AS z FROM customer
        WINDOW w AS (PARTITION BY c_mktsegment)""",
    ),
    "cogroup_map": (
        cogroup_map,
        """SELECT nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers
        FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1) USING (nation)""",
    ),
    "batch_map": (batch_map, None),
    "udaf_trimmed": (
        udaf_trimmed,
        """SELECT o_custkey, round(CASE WHEN count(*) > 2 THEN (sum(o_totalprice) - min(o_totalprice) - max(o_totalprice)) / (count(*) - 2) ELSE avg(o_totalprice) END, 4) AS price
        FROM orders GROUP BY o_custkey""",
    ),
    "formats_round_trip": (
        formats_round_trip,
        f"""SELECT p_partkey, p_name, CASE WHEN format = 'text' THEN NULL ELSE p_retailprice END AS p_retailprice, format
        FROM part, (VALUES {", ".join(f"('{f}')" for f in sources.FORMATS)}) formats(format)""",
    ),
    "udtf_words": (
        udtf_words,
        "SELECT p_partkey, CAST(place AS INTEGER) AS place, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part)",
    ),
    "udf_vectorised": (udf_vectorised, "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1:1]), '') AS initials FROM part"),
    "sql_udf": (sql_udf, "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "stream_state": (stream_state, "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY user_id"),
    "stream_tumbling": (stream_tumbling, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_session": (stream_session, f"SELECT user_id, min(ts) AS start, count(*) AS n FROM ({_SESSIONS}) GROUP BY user_id, session"),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT event_id, user_id FROM events"),
    "stream_interval_join": (stream_interval_join, _PAIRS),
}
