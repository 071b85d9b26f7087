"""Helpers shared by the operators: durable intermediate tables and components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import shared_dir


_made: list[list[str]] = []


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the planner the
    table's real size, so that Spark broadcasts it only under its own threshold.
    The table stays until the folder is cleared, or ``alone`` frees it.
    """
    path = f"{shared_dir(df.sparkSession)}/quern/{uuid.uuid4().hex}/{name}"
    if _made:
        _made[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns as a ``durable`` table, with all tables that it needed on the way deleted."""
    _made.append([])
    result = None
    try:
        result = durable(build(), name)
    finally:
        paths = _made.pop()
        for p in paths[:-1] if result is not None else []:
            jvm, conf = result.sparkSession._jvm, result.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(p).getParent()
            at.getFileSystem(conf).delete(at, True)
    return result


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names`` as names of further columns: each is lengthened until no column of ``taken`` has it, whatever the letter case."""
    held = {c.lower() for c in taken}
    found = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        found.append(name)
    return found


def spread(df: DataFrame) -> DataFrame:
    """``df`` on as many tasks as there are cores, if it has fewer than two for each: for costly Python on small tables."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of an undirected graph, as (node, component).

    ``edges`` holds two integer columns ``u`` and ``v``. The component is the
    smallest node that can be reached. Nodes without an edge are not returned;
    self loops and repeated edges count for nothing.

    Alternates the large-star and small-star steps of Kiveris et al. (2014).
    Each step takes a minimum per node, which is combined before the shuffle,
    and one join that AQE can split; no neighbour list is gathered, so a node
    may have any number of edges. Each round is a written table. Only a row
    count and a checksum reach the driver.
    """
    hi_lo = durable(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        mark = tuple(hi_lo.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = hi_lo.unionAll(hi_lo.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # As a table of its own, so that AQE may split the join's other side where a node has most edges.
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").select("u", "v", "m")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        hi_lo = durable(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = hi_lo.select(F.col("v").alias("node")).distinct()
    return hi_lo.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
