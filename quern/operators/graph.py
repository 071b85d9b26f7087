"""Fixpoints over edges: what can be reached, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.scratch import stored


def reachable(edges: DataFrame, starts: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(start, node, depth): every node that edges (src, dst) lead to from each start, and the fewest edges on the way.

    ``starts`` has a column ``start``; a start reaches itself at depth 0. The semi-naive fixpoint of a recursive query:
    each round joins only the nodes found in the round before with the edges, and drops those that are known by an
    anti-join, so that cycles end and no path is walked twice. Each round is a written table and the work of all rounds is
    the number of (start, edge) steps. Null nodes are reached by nothing. Only an emptiness test reaches the driver.
    """
    steps = stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    fresh = stored(starts.select("start").where("start is not null").distinct().select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("depth")), "reached")
    found = [fresh]
    for depth in range(1, max_rounds + 1):
        if fresh.isEmpty():
            break
        seen = found[0]
        for f in found[1:]:
            seen = seen.unionByName(f)
        tried = fresh.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        fresh = stored(tried.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")), "reached")
        found.append(fresh)
        if len(found) == 16:  # one table again, so that plans don't grow with the depth
            found = [stored(seen.unionByName(fresh), "reached")]
    else:
        raise RuntimeError(f"still new nodes after {max_rounds} rounds")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of undirected links (u, v) of any orderable type; the component is its smallest node.

    Nodes are hung on smaller and smaller neighbours (large and small stars by turns) until nothing moves. A node may have
    any number of links: minima are combined before the shuffle, and no list of neighbours is made.
    """
    pairs = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, before = stored(pairs, "links"), None
    for _ in range(max_rounds):
        mark = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            break
        before = tuple(mark)
        ways = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = stored(ways.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")), "lowest")
        large = stored(ways.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct(), "large")
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("w")), "lowest")
        small = large.join(lowest, "u")
        pairs = stored(small.select("u", F.col("w").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("w").alias("v"))).where("u <> v").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
