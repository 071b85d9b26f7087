"""Queries for few and hot keys, fixpoints and near-duplicates, with their DuckDB SQL. They read ``documents`` and the star tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph, joins, ordered, similar
from quern.session import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


def hot_neighbours(spark: SparkSession, d: str) -> DataFrame:
    found = ordered.neighbours(_docs(spark, d), ["source"], ["n_chars", "doc_id"], "n_chars", {"before": -1, "after": 2})
    return found.select("doc_id", "before", "after")


def hot_running(spark: SparkSession, d: str) -> DataFrame:
    found = ordered.running(_docs(spark, d), ["lang"], ["doc_id"], {"chars": "n_chars"})
    return found.select("doc_id", "chars")


def hot_last_rows(spark: SparkSession, d: str) -> DataFrame:
    return ordered.running(_docs(spark, d), ["lang"], ["doc_id"], {"chars": "n_chars"}, last=3).select("doc_id", "chars")


def hot_nth(spark: SparkSession, d: str) -> DataFrame:
    found = ordered.nth_values(_docs(spark, d), ["source"], ["n_chars", "doc_id"], "doc_id", {"first_doc": 1, "second_doc": 2, "last_doc": -1})
    return found.select("n_chars", "source", "first_doc", "second_doc", "last_doc")


def hot_ranks(spark: SparkSession, d: str) -> DataFrame:
    found = ordered.ranks(_docs(spark, d).select("doc_id", "lang", "n_chars"), ["lang"], ["n_chars"])
    return found.select("doc_id", "row_number", "rank", "dense_rank", "ntile", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"))


def hot_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = ordered.percentiles(_docs(spark, d), ["lang"], "n_chars", [0.05, 0.5, 0.99])
    return found.select("lang", *[F.round(p, 4).alias(p) for p in ("p0", "p1", "p2")])


def hot_history(spark: SparkSession, d: str) -> DataFrame:
    """For each language the runs of documents from one source, in the order of ids."""
    return ordered.versions(_docs(spark, d), ["lang"], "doc_id", ["source"])


def hot_salted_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents joined with what the labels say of their source; the source that holds most documents is dealt over tasks."""
    docs = _docs(spark, d)
    toxic = docs.join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("labelled"), F.sum("toxic").alias("toxic"))
    met = joins.salted_join(docs.select("source", "doc_id", "n_chars"), toxic, ["source"], how="left")
    return met.select("doc_id", "source", "n_chars", "labelled", "toxic")


def recursive_reach(spark: SparkSession, d: str) -> DataFrame:
    """Customers reached from each nation's first customer, from one to the next if both had the same part shipped in one week."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.date_trunc("week", "l_shipdate").alias("week"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey", "week").distinct()
    a, b = bought.alias("a"), bought.alias("b")
    edges = a.join(b, (F.col("a.l_partkey") == F.col("b.l_partkey")) & (F.col("a.week") == F.col("b.week")) & (F.col("a.o_custkey") != F.col("b.o_custkey")))
    edges = edges.select(F.col("a.o_custkey").alias("src"), F.col("b.o_custkey").alias("dst"))
    starts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("start"))
    return graph.reachable(edges, starts).select("start", F.col("node").alias("customer"), "depth")


def dedup_near(spark: SparkSession, d: str) -> DataFrame:
    return similar.near_duplicates(table(spark, d, "documents").select("doc_id", "text"), words=5, similarity=0.8)


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: name: (query, DuckDB SQL)
HOT: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "hot_neighbours": (hot_neighbours, "SELECT doc_id, lag(n_chars) OVER w AS before, lead(n_chars, 2) OVER w AS after FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)"),
    "hot_running": (hot_running, "SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS chars FROM documents"),
    "hot_last_rows": (hot_last_rows, "SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS chars FROM documents"),
    "hot_nth": (
        hot_nth,
        """SELECT n_chars, source, first_value(doc_id) OVER w AS first_doc, nth_value(doc_id, 2) OVER w AS second_doc, last_value(doc_id) OVER w AS last_doc FROM documents
        WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    ),
    "hot_ranks": (
        hot_ranks,
        """SELECT doc_id, row_number() OVER w AS row_number, rank() OVER v AS rank, dense_rank() OVER v AS dense_rank, ntile(4) OVER w AS ntile, round(percent_rank() OVER v, 9) AS percent_rank,
        round(cume_dist() OVER v, 9) AS cume_dist FROM documents WINDOW w AS (PARTITION BY lang ORDER BY n_chars, doc_id), v AS (PARTITION BY lang ORDER BY n_chars)""",
    ),
    "hot_percentiles": (
        hot_percentiles,
        "SELECT lang, round(quantile_cont(n_chars, 0.05), 4) AS p0, round(quantile_cont(n_chars, 0.5), 4) AS p1, round(quantile_cont(n_chars, 0.99), 4) AS p2 FROM documents GROUP BY lang",
    ),
    "hot_history": (
        hot_history,
        """SELECT lang, source, doc_id AS valid_from, lead(doc_id) OVER w AS valid_to FROM
        (SELECT *, lag(source) OVER w AS before FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id, source)) WHERE before IS DISTINCT FROM source
        WINDOW w AS (PARTITION BY lang ORDER BY doc_id, source)""",
    ),
    "hot_salted_join": (
        hot_salted_join,
        """SELECT doc_id, source, n_chars, labelled, toxic FROM documents LEFT JOIN (SELECT source, count(*) AS labelled, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source) USING (source)""",
    ),
    "recursive_reach": (
        recursive_reach,
        """WITH RECURSIVE bought AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p, date_trunc('week', l_shipdate) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        edges AS MATERIALIZED (SELECT DISTINCT a.c AS src, b.c AS dst FROM bought a JOIN bought b ON a.p = b.p AND a.s = b.s AND a.c <> b.c),
        starts AS (SELECT min(c_custkey) AS start FROM customer GROUP BY c_nationkey),
        walk(start, customer, depth) USING KEY (start, customer) AS (SELECT start, start, CAST(0 AS BIGINT) FROM starts UNION
            SELECT w.start, e.dst, min(w.depth) + 1 FROM walk w JOIN edges e ON e.src = w.customer LEFT JOIN recurring.walk r ON r.start = w.start AND r.customer = e.dst WHERE r.start IS NULL GROUP BY w.start, e.dst)
        SELECT start, customer, depth FROM walk""",
    ),
    "dedup_near": (
        dedup_near,
        f"""WITH RECURSIVE tokens AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        shingled AS (SELECT doc_id, CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM tokens),
        classes AS MATERIALIZED (SELECT s, min(doc_id) AS rep FROM shingled GROUP BY s),
        each AS MATERIALIZED (SELECT rep, len(s) AS n, unnest(s) AS g FROM classes),
        links AS MATERIALIZED (SELECT u, v FROM (SELECT a.rep AS u, b.rep AS v, count(*) AS k, any_value(a.n) AS m, any_value(b.n) AS n FROM each a JOIN each b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2)
            WHERE k >= 0.8 * (m + n - k)),
        reach(x, y) AS (SELECT rep, rep FROM classes UNION SELECT r.x, l.v FROM reach r JOIN links l ON r.y = l.u),
        named AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
        SELECT doc_id, rep AS same_as, component FROM shingled JOIN classes USING (s) JOIN named ON x = rep""",
    ),
}
