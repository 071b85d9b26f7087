"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (random signs and a fast Hadamard transform, three times) turns
a unit vector, and the nearest signed axis is its hash; a table's code joins some such
hashes, the last of which may know some of the coordinates only. Every vector lies in one bucket of each table. A query probes the buckets
whose axes lose least against its nearest ones, over all tables together. Buckets
and probes are dealt to slots by a hash; a slot's rows and probes meet in a task,
where each pair of a bucket is ranked once by its exact distance on the original
vectors. A query's best of all slots are its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import durable
from quern.llm.vectors import is_vector, rotate, signs, unit, with_parts, width


def code_shape(rows: float, axes: int) -> tuple[int, int]:
    """How many whole hashes of ``axes`` signed axes a code joins, and how many coordinates its last, partial hash has (0: none).

    The codes number about ``rows`` in all: a hash of c of a rotated vector's coordinates has 2 c values, so that the
    number of codes follows the rows in small steps instead of by a factor of ``axes``.
    """
    whole = max(0, math.floor(math.log(max(rows, 1.0)) / math.log(axes) + 1e-9))
    last = int(rows / axes**whole / 2)
    return (whole, min(last, axes // 2)) if whole or last else (0, 1)


def hash_axes(x: np.ndarray, diagonals: np.ndarray, last: int) -> list[np.ndarray]:
    """Per hash the value along each signed axis, (rows, axes), axis a before its negative; the last hash has ``last`` coordinates, if any."""
    z = [rotate(x, d) for d in diagonals]
    if last:
        z[-1] = z[-1][:, :last]
    return [np.concatenate([v, -v], axis=1) for v in z]


def _least(losses: list[np.ndarray], most: int) -> np.ndarray:
    """The ``most`` least sums of one of each of ``losses``."""
    total = np.zeros(1)
    for loss in losses:
        total = (total[:, None] + loss[None, :]).reshape(-1)
        if len(total) > most:
            total = np.partition(total, most - 1)[:most]
    return total


def pooled_probes(values: list[list[np.ndarray]], probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``probes`` buckets (tables, codes) of least squared loss over all tables; ``values`` of one query by table and hash.

    What the few best axes of every hash give bounds the largest loss that counts; sums above it are not followed.
    """
    losses = [[(v.max() - v) ** 2 for v in table] for table in values]
    few = 1
    while len(losses) * math.prod(min(few, len(loss)) for loss in losses[0]) < probes and few < max(map(len, losses[0])):
        few *= 2
    bound = np.concatenate([_least([np.sort(loss)[:few] for loss in table], probes) for table in losses])
    limit = np.partition(bound, probes - 1)[probes - 1] if len(bound) >= probes else np.inf
    codes, lost = [], []
    for table in losses:
        total, code = np.zeros(1), np.zeros(1, np.int64)
        for loss in table:
            axis = np.flatnonzero(loss <= limit)
            total = (total[:, None] + loss[axis][None, :]).reshape(-1)
            code = (code[:, None] * len(loss) + axis[None, :]).reshape(-1)
            keep = np.flatnonzero(total <= limit)
            if len(keep) > probes:
                keep = keep[np.argpartition(total[keep], probes - 1)[:probes]]
            total, code = total[keep], code[keep]
        codes.append(code)
        lost.append(total)
    keep = np.argsort(np.concatenate(lost), kind="stable")[:probes]
    return np.repeat(np.arange(len(codes)), [len(c) for c in codes])[keep], np.concatenate(codes)[keep]


def _top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k smallest scores, ties to the smaller id."""
    order = np.lexsort((ids, score, query))
    begins = np.flatnonzero(np.r_[True, np.diff(query[order]) != 0])
    nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    return order[nth < k]


def _nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int, pairs: int = 1 << 17) -> pd.DataFrame:
    """The k nearest of ``rows`` (id, vec, bucket) for each of ``queries`` (query_id, qvec, buckets) that share a bucket, but the query's own row."""
    ids, first, row_of = np.unique(rows["id"].to_numpy(), return_index=True, return_inverse=True)
    x = np.stack(rows["vec"].to_numpy()[first]).astype(np.float64)
    asked, y = queries["query_id"].to_numpy(), np.stack(queries["qvec"].to_numpy()).astype(np.float64)
    probed = np.concatenate(queries["buckets"].to_numpy())
    query_of = np.repeat(np.arange(len(asked)), queries["buckets"].map(len).to_numpy())
    met_any = np.isin(probed, rows["bucket"].to_numpy())
    probed, query_of = probed[met_any], query_of[met_any]
    order = np.argsort(rows["bucket"].to_numpy(), kind="stable")
    held = rows["bucket"].to_numpy()[order]
    low, high = (np.searchsorted(held, probed, side=s) for s in ("left", "right"))
    row_of, sizes = row_of[order], high - low
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + pairs, pairs), side="left") if len(sizes) else []
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for a, b in zip(np.unique([0, *cuts[1:]]), [*np.unique([0, *cuts[1:]])[1:], len(sizes)]):
        n = sizes[a:b]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a:b], n)
        met = np.unique(np.repeat(query_of[a:b], n) * len(ids) + row_of[at])
        q, r = met // len(ids), met % len(ids)
        other = asked[q] != ids[r]
        q, r = q[other], r[other]
        score = np.sqrt(((x[r] - y[q]) ** 2).sum(axis=1))
        q, r, score = (np.concatenate(z) for z in zip(best, (q, r, score)))
        _, once = np.unique(q * len(ids) + r, return_index=True)
        q, r, score = q[once], r[once], score[once]
        keep = _top(q, r, score, k)
        best = [q[keep], r[keep], score[keep]]
    return pd.DataFrame({"query_id": asked[best[0]], "vec_id": ids[best[1]], "score": best[2]})


_FOUND = "query_id long, vec_id long, score double"


def nearest_neighbours(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tables: int = 16,
    hashes: int | None = None,
    bucket_rows: float = 3.0,
    probes: int | None = None,
    seed: int = 5,
    block: int = 4096,
    slot_rows: int = 60_000,
    slot_probes: int = 200_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found rows by Euclidean distance, ties to the smaller id.

    ``queries`` are rows of the same form. Vectors that are null, zero or hold null or non-finite numbers take
    no part, nor do null ids; only vectors of a query's length are its candidates. A query's own id is no
    candidate. Of several vectors of one id the smallest (as an array) counts, so that repeated rows count once.
    Of ids with equal vectors only the k + 1 smallest can be neighbours, so the others are not indexed (exact,
    and it bounds copies). Columns besides id and vector are ignored. An empty table gives an empty result.

    One rule for every size: there are as many codes as rows / ``bucket_rows``, which a last hash of some of the
    coordinates makes up (``code_shape``; ``hashes`` asks for as many whole ones instead), and ``probes`` over all tables together are 15 times the root of the rows.
    Vectors stand once in each table; of a query only its bucket numbers are sent, and its vector once to a slot.
    Buckets of more than ``block`` rows or probes are cut into parts, and each part of the rows meets each part of the
    probes by itself. A task gets about ``slot_rows`` rows (of 64 numbers; fewer longer ones) and ``slot_probes`` probes.
    Queries with fewer than k rows found are searched once more, exactly, against all rows in blocks.
    """
    valid = F.col("id").isNotNull() & is_vector(F.col("vec"))
    base = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec")).where(valid)
    asked = queries.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec")).where(valid)
    base, asked = (x.groupBy("id").agg(F.min("vec").alias("vec")) for x in (base, asked))
    copies = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    base = base.withColumn("__copy", copies).where(F.col("__copy") <= k + 1).drop("__copy").withColumn("dim", F.size("vec"))
    base = durable(base, "vectors")
    count, dim = base.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not count:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    probes = probes or math.ceil(15 * count**0.5)
    asked = asked.repartition(asked.sparkSession.sparkContext.defaultParallelism)  # probes are costly

    def place(query: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if pdf.empty:
                    continue
                sizes = pdf["vec"].map(len).to_numpy()
                buckets = np.empty(len(pdf), object)
                for size in map(int, np.unique(sizes)):
                    at = np.flatnonzero(sizes == size)
                    whole, last = (hashes, 0) if hashes else code_shape(count / bucket_rows, 2 * width(size))
                    each = whole + (last > 0)
                    diagonals = signs(size, tables * each, seed).reshape(tables, each, 3, -1)
                    for some in np.array_split(at, math.ceil(len(at) / (64 if query else 1024))):
                        x = unit(np.stack(pdf["vec"].to_numpy()[some]).astype(np.float64))
                        values = [hash_axes(x, d, last) for d in diagonals]
                        if query:
                            for n, i in enumerate(some):
                                table, code = pooled_probes([[v[n] for v in t] for t in values], probes)
                                buckets[i] = code * tables + table
                            continue
                        codes = np.zeros((len(some), tables), np.int64)
                        for t, hashed in enumerate(values):
                            for v in hashed:
                                codes[:, t] = codes[:, t] * v.shape[1] + v.argmax(axis=1)
                        for i, row in zip(some, codes * tables + np.arange(tables)):
                            buckets[i] = row
                out = pdf[["id", "vec"]].copy()
                out["dim"] = sizes.astype(np.int32)
                out["buckets"] = buckets
                yield out

        return run

    schema = base.select("id", "vec").withColumn("dim", F.lit(0)).withColumn("buckets", F.array(F.lit(0).cast("long"))).schema
    index = durable(base.select("id", "vec").mapInPandas(place(False), schema), "index")
    probed = durable(asked.mapInPandas(place(True), schema), "probes")

    keys = ["dim", "code"]

    def per_bucket(df: DataFrame) -> DataFrame:
        return df.select("dim", F.explode("buckets").alias("code")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def dealt(df: DataFrame, own: DataFrame, others: DataFrame) -> DataFrame:
        """A row for each bucket and part; what is cut by ``own`` sizes is sent to each part of the ``others``."""
        rows = with_parts(df, own, keys, block).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        return with_parts(rows, others, keys, block).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    row_sizes, probe_sizes = durable(per_bucket(index), "row-sizes"), durable(per_bucket(probed), "probe-sizes")
    n_rows, n_probes = (d.agg(F.sum("n")).first()[0] or 0 for d in (row_sizes, probe_sizes))
    slots = math.ceil(max(1, n_rows * max(1, dim / 64) / slot_rows, n_probes / slot_probes))

    def in_slots(df: DataFrame, row_part: str, probe_part: str) -> DataFrame:
        bucket = F.xxhash64("dim", "code", row_part, probe_part)  # an accidental match only adds a comparison
        return df.withColumn("bucket", bucket).withColumn("slot", F.pmod("bucket", F.lit(slots))).drop("code", "mine", "theirs")

    placed = in_slots(dealt(index.select("id", "vec", "dim", F.explode("buckets").alias("code")), row_sizes, probe_sizes), "mine", "theirs")
    sent = in_slots(dealt(probed.select("id", "dim", F.explode("buckets").alias("code")), probe_sizes, row_sizes), "theirs", "mine")
    sent = sent.groupBy("id", "dim", "slot").agg(F.collect_list("bucket").alias("buckets"))
    sent = sent.join(probed.select("id", "vec"), "id").withColumnsRenamed({"id": "query_id", "vec": "qvec"})

    def rank(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return _nearest(queries, rows, k)

    def top(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = sent.groupBy("dim", "slot").cogroup(placed.groupBy("dim", "slot")).applyInPandas(rank, _FOUND)
    found = durable(top(found), "found")

    held = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    others = base.groupBy("dim").agg(F.count(F.lit(1)).alias("rows"))
    short = probed.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"), "dim").join(held, "query_id", "left").join(others, "dim")
    short = durable(short.where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.col("rows") - 1)).select("query_id", "qvec", "dim"), "short")
    if not short.isEmpty():
        blocks = max(1, math.ceil(count / block))
        every = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        parts = base.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("bucket", F.lit(0))
        more = top(every.withColumn("buckets", F.array(F.lit(0))).groupBy("dim", "part").cogroup(parts.groupBy("dim", "part")).applyInPandas(rank, _FOUND))
        found = found.join(short, "query_id", "left_anti").unionByName(more)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
