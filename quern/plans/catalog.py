"""Queries as SQL, each with the DuckDB text that gives the same rows, names and types.

``{name}`` stands for a table. A query without a DuckDB text of its own is the same in both.
"""

from __future__ import annotations

import re

#: name: (Spark SQL, DuckDB SQL or None)
SQL: dict[str, tuple[str, str | None]] = {}


def _add(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    SQL[name] = (spark_sql, duck_sql)


# Scans, projections, filters
_add("scan", "SELECT n_nationkey, n_name, n_regionkey FROM {nation}")
_add("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity * 2 AS twice FROM {lineitem}")
_add("filter_between_in_like", "SELECT p_partkey, p_name, p_size FROM {part} WHERE p_size BETWEEN 10 AND 12 AND p_brand IN ('Brand#1', 'Brand#7') AND p_name LIKE '%widget'")
_add("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS tier FROM {orders}")

# Joins
_add("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
_add("join_left", "SELECT o_orderkey, l_linenumber, l_quantity FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey")
_add("join_full", "SELECT c_custkey, s_suppkey FROM {customer} FULL JOIN {supplier} ON c_custkey = s_suppkey")
_add("join_semi", "SELECT o_orderkey, o_custkey FROM {orders} LEFT SEMI JOIN {lineitem} ON o_orderkey = l_orderkey", "SELECT o_orderkey, o_custkey FROM {orders} SEMI JOIN {lineitem} ON o_orderkey = l_orderkey")
_add("join_anti", "SELECT o_orderkey, o_custkey FROM {orders} LEFT ANTI JOIN {lineitem} ON o_orderkey = l_orderkey", "SELECT o_orderkey, o_custkey FROM {orders} ANTI JOIN {lineitem} ON o_orderkey = l_orderkey")
_add("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
_add("join_theta", "SELECT a.n_nationkey AS a_key, b.r_regionkey AS b_key FROM {nation} a JOIN {region} b ON a.n_regionkey > b.r_regionkey")
_add("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_add("lateral_join", "SELECT c_custkey, t.best FROM {customer}, LATERAL (SELECT max(o_totalprice) AS best FROM {orders} WHERE o_custkey = c_custkey) t")
_add("subq_in", "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)")
_add("subq_not_exists", "SELECT p_partkey FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 49)")
_add("subq_corr_scalar", "SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
_add("subq_exists_or", "SELECT c_custkey FROM {customer} WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 495000)")

# Aggregations
_add("agg_group", "SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_orderstatus")
_add("agg_sum_int", "SELECT sum(l_linenumber) AS total FROM {lineitem}", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM {lineitem}")
_add("agg_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem}")
_add("agg_filter", "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS returned, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open_quantity FROM {lineitem}")
_add("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15")
_add("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_add("agg_cube", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
_add("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_add("agg_percentile", "SELECT o_orderstatus, round(percentile(o_totalprice, 0.5), 4) AS median FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM {orders} GROUP BY o_orderstatus")
_add("agg_stddev_corr", "SELECT round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 5) AS variance, round(corr(l_quantity, l_extendedprice), 6) AS r FROM {lineitem}")
_add("agg_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")
_add("agg_collect", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), '|') AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names FROM {nation} GROUP BY n_regionkey")
_add("agg_max_by", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS best FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM {orders} GROUP BY o_custkey")
_add("agg_bool", "SELECT bool_and(l_quantity > 0) AS every_one, bool_or(l_discount > 0.1) AS any_one FROM {lineitem}")
_add("agg_histogram", "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bin, count(*) AS n FROM {orders} GROUP BY 1")
_add("pivot", "SELECT * FROM (SELECT event_type, user_id % 3 AS shard FROM {events}) PIVOT (count(*) FOR event_type IN ('click' AS clicks, 'view' AS views, 'purchase' AS purchases))", "SELECT user_id % 3 AS shard, nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS clicks, nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS views, nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0) AS purchases FROM {events} GROUP BY 1")
_add("unpivot", "SELECT l_orderkey, l_linenumber, l_partkey, measure, amount FROM {lineitem} UNPIVOT (amount FOR measure IN (l_quantity, l_tax))", "SELECT l_orderkey, l_linenumber, l_partkey, measure, amount FROM (SELECT l_orderkey, l_linenumber, l_partkey, unnest(['l_quantity', 'l_tax']) AS measure, unnest([l_quantity, l_tax]) AS amount FROM {lineitem})")

# Windows, sorts, set operations
_add("win_rank", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
_add("win_dist", "SELECT o_orderkey, CAST(ntile(4) OVER w AS BIGINT) AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM {orders} WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)", "SELECT o_orderkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM {orders} WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)")
_add("win_lag_lead", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2, 0.0) OVER w AS after FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
_add("win_rows", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last_three FROM {events}")
_add("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_count FROM {events}")
_add("win_first_nth", "SELECT event_id, first_value(value) OVER w AS first_one, nth_value(value, 2) OVER w AS second_one FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_add("win_running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM {orders}")
_add("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_add("limit_offset", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 20")
_add("sort_nulls", "SELECT r_regionkey, nullif(r_name, 'ASIA') AS name FROM {region} ORDER BY name DESC NULLS LAST")
_add("union_all", "SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}")
_add("union", "SELECT n_nationkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region}")
_add("intersect", "SELECT c_custkey AS k FROM {customer} INTERSECT SELECT s_suppkey FROM {supplier}")
_add("except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT s_suppkey FROM {supplier}")
_add("intersect_all", "SELECT l_suppkey AS k FROM {lineitem} INTERSECT ALL SELECT l_partkey FROM {lineitem}")
_add("except_all", "SELECT l_partkey AS k FROM {lineitem} EXCEPT ALL SELECT p_partkey FROM {part}")
_add("recursive_cte", "WITH RECURSIVE walk(n, k) AS (SELECT CAST(0 AS BIGINT), min(c_custkey) FROM {customer} UNION ALL SELECT n + 1, k + 7 FROM walk WHERE n < 4) SELECT w.n, c.c_name FROM walk w JOIN {customer} c ON c.c_custkey = w.k")

# Scalar functions
_add("str_basic", "SELECT c_custkey, upper(c_mktsegment) AS up, CAST(length(c_name) AS BIGINT) AS n, substring(c_name, 1, 8) AS head, concat(c_name, '-', c_mktsegment) AS joined, replace(c_name, '#', ':') AS swapped, trim(concat(' ', c_name, ' ')) AS trimmed, lpad(c_mktsegment, 12, '.') AS padded, reverse(c_name) AS backwards FROM {customer}")
_add("str_split", "SELECT p_partkey, split_part(p_name, ' ', 2) AS noun FROM {part}")
_add("str_regexp", "SELECT p_partkey, regexp_extract(p_brand, '#([0-9]+)', 1) AS number, regexp_replace(p_name, '[aeiou]', '*') AS masked FROM {part}", "SELECT p_partkey, regexp_extract(p_brand, '#([0-9]+)', 1) AS number, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked FROM {part}")
_add("str_hash", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s FROM {customer}", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM {customer}")
_add("str_levenshtein", "SELECT c_custkey, CAST(levenshtein(c_mktsegment, 'BUILDING') AS BIGINT) AS distance FROM {customer}")
_add("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(quarter(o_orderdate) AS BIGINT) AS q FROM {orders}")
_add("date_trunc", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS timestamp_ntz) AS month FROM {orders}", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month FROM {orders}")
_add("date_diff", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(datediff(l_shipdate, o_orderdate) AS BIGINT) AS days FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey", "SELECT l_orderkey, l_linenumber, l_partkey, datediff('day', o_orderdate, l_shipdate) AS days FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey")
_add("date_add", "SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS later FROM {orders}")
_add("date_format", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS day FROM {orders}", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM {orders}")
_add("math_basic", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, round(c_acctbal, 1) AS r, round(sqrt(abs(c_acctbal)), 9) AS s, power(c_custkey % 7, 2) AS p, c_custkey % 11 AS m FROM {customer}")
_add("math_int_div", "SELECT c_custkey, c_custkey div 7 AS seventh FROM {customer}", "SELECT c_custkey, c_custkey // 7 AS seventh FROM {customer}")
_add("null_functions", "SELECT r_regionkey, coalesce(nullif(r_name, 'ASIA'), 'none') AS name, nullif(r_name, 'ASIA') IS NULL AS missing FROM {region}")
_add("decimal_cast", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(4, 2)) AS DECIMAL(17, 4)) AS cut FROM {lineitem}")
_add("json_get", "SELECT event_id, get_json_object(props, '$.k') AS k FROM {events}", "SELECT event_id, props ->> '$.k' AS k FROM {events}")
_add("map_struct", "SELECT r_regionkey, map_from_entries(collect_list(struct(n_name, n_nationkey)))['NATION_0'] AS first_key FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_regionkey", "SELECT r_regionkey, max(CASE WHEN n_name = 'NATION_0' THEN n_nationkey END) AS first_key FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_regionkey")
_add("arr_explode", "SELECT vec_id, explode(embedding) AS x FROM {embeddings}", "SELECT vec_id, unnest(embedding) AS x FROM {embeddings}")
_add("arr_hof", "SELECT vec_id, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), CAST(0 AS DOUBLE), (a, x) -> a + x), 6) AS norm FROM {embeddings}", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm FROM {embeddings}")
_add("arr_slice", "SELECT vec_id, CAST(size(slice(embedding, 1, 4)) AS BIGINT) AS n, slice(embedding, 1, 4)[0] AS x FROM {embeddings}", "SELECT vec_id, len(embedding[1:4]) AS n, embedding[1] AS x FROM {embeddings}")

# Text, pages, conversations
_add("dedup_exact", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM {documents} GROUP BY unhex(md5(text))", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM {documents} GROUP BY text")
_add("word_count", "SELECT doc_id, CAST(size(filter(split(text, '[ \\\\t\\\\n\\\\r]+'), w -> w <> '')) AS BIGINT) AS words FROM {documents}", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS words FROM {documents}")
_add("corpus_profile", "SELECT lang, source, count(*) AS docs, sum(n_chars) AS chars FROM {documents} GROUP BY lang, source", "SELECT lang, source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY lang, source")
_add("html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM {pages}")
_add("url_host", "SELECT page_id, parse_url(url, 'HOST') AS host FROM {pages}", "SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM {pages}")
_add("conv_assemble", "SELECT conv_id, array_join(transform(array_sort(collect_list(struct(turn, role, text))), t -> concat(t.role, ': ', t.text)), char(10)) AS whole FROM {conversations} GROUP BY conv_id", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS whole FROM {conversations} GROUP BY conv_id")
_add("label_join", "SELECT lang, toxic, quality, count(*) AS n FROM {documents} JOIN {labels} USING (doc_id) GROUP BY lang, toxic, quality")

# Time windows
_add("tumbling", "SELECT window.start AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM {events} GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM {events} GROUP BY 1, 2")
_add("sliding", "SELECT window.start AS start, count(*) AS n FROM {events} GROUP BY window(ts, '1 hour', '30 minutes')", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM {events}) GROUP BY 1")
_add("session", "SELECT user_id, session_window.start AS start, count(*) AS n FROM {events} GROUP BY user_id, session_window(ts, '30 minutes')", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {events})) GROUP BY user_id, s")

# Whole queries
_add("tpch_q1", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order FROM {lineitem} WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
_add("tpch_q3", "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10")
_add("tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
_add("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
_add("tpch_q12", "SELECT l_returnflag, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY l_returnflag")
_add("tpch_q14", "SELECT round(100.0 * sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM {lineitem} JOIN {part} ON l_partkey = p_partkey")
_add("tpch_q18", "SELECT o_orderkey, o_totalprice, sum(l_quantity) AS quantity FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice HAVING sum(l_quantity) > 200")


def duck(name: str) -> str:
    """The DuckDB text of a query, over views named as the tables."""
    ours, theirs = SQL[name]
    return re.sub(r"\{(\w+)\}", r"\1", theirs or ours)
