"""Sharding by Hilbert-curve order.

Several metadata dimensions are quantised to cells of near equal counts, the
cells are ordered along a Hilbert curve, and the ordered rows are cut into runs.
Rows near each other in all dimensions meet in one shard, so a shard's minima and
maxima prune files on any of the dimensions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import durable


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of rows of cell numbers, each below 2**bits (Skilling's method, 2004)."""
    x = [c.astype(np.int64) for c in np.asarray(cells).T]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            up = (x[i] >> b) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[i] = x[i] ^ swap
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap if i else x[0])
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> b) & 1 == 1, turn ^ ((1 << b) - 1), turn)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | (((c ^ turn) >> b) & 1)
    return out


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``__rank``, a row's place from 0 in this order, and ``__all``, the number of rows.

    A row's rank is its place in its partition of a range-partitioned sort plus the rows of the partitions
    before. Only the counts of the partitions are ordered in one task and sent to all.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = durable(ranged.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))), name)
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"), F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))
    found = ranged.join(F.broadcast(offsets), "__part").withColumn("__rank", F.col("__before") + F.col("__at"))  # a row for each partition
    return found.drop("__part", "__at", "__before")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the column ``name`` as a double of the same order: numbers as they are, other values by their rank among the distinct ones."""
    if isinstance(rows.schema[name].dataType, (T.NumericType, T.BooleanType, T.TimestampType)):
        return rows.withColumn(name, F.col(name).cast("double"))
    values = ranked(rows.select(F.col(name).alias("__value")).where("__value is not null").distinct(), ["__value"], "values")
    values = durable(values.select("__value", F.col("__rank").cast("double").alias("__number")), "numbers")
    return rows.join(values, F.col(name) == F.col("__value"), "left").withColumn(name, F.col("__number")).drop("__value", "__number")


def hilbert_shards(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: list[str] | None = None, n_shards: int = 24, bits: int = 4, keep: list[str] | None = None
) -> DataFrame:
    """(id, size, text_crc32, hilbert, shard, slot) for every row of ``df``; with ``keep`` also ``row``, a struct of these columns.

    Law ``rows``: shards 0 to ``n_shards - 1`` hold counts at most one apart, and ``slot`` numbers a shard's
    rows from 0 without gaps. Size is the text's UTF-8 bytes plus 8; a null text has none and crc32 0.
    ``dims`` are columns of ``df``, or ``size``; nulls lie in a dimension's first cell, and values that aren't
    numbers count by their rank. Rows of the same cell follow by the text's crc32 and then id, so equal texts of
    one cell stand together. Wholly equal rows keep separate slots. An empty table gives an empty result.

    The cuts between cells are approximate quantiles over all rows (2**bits - 1 numbers a dimension, whatever
    the input).
    """
    dims = ["lang", "source", "size"] if dims is None else dims
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    size = F.octet_length(body).cast("long") + 8
    values = [(size if d == "size" and d not in df.columns else F.col(f"`{d}`")).alias(f"__d{i}") for i, d in enumerate(dims)]
    carried = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    rows = durable(df.select(F.col(f"`{id_col}`").alias("__id"), size.alias("size"), F.crc32(body).alias("text_crc32"), *values, *carried), "rows")
    for i in range(len(dims)):
        rows = numbered(rows, f"__d{i}")

    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.agg(*[F.percentile_approx(f"__d{i}", steps, 10_000) for i in range(len(dims))]).first()
    cuts = [np.unique(np.array(c or [], dtype=float)) for c in cuts]

    @F.pandas_udf("long")
    def curve(*values: pd.Series) -> pd.Series:
        cells = [np.where(v.isna(), 0, np.searchsorted(c, v.to_numpy(dtype=float), side="right")) for v, c in zip(values, cuts)]
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    more = ["row"] if keep else []
    placed = rows.select("__id", "size", "text_crc32", curve(*[F.col(f"__d{i}") for i in range(len(dims))]).alias("hilbert"), *more)
    whole = ranked(placed, ["hilbert", "text_crc32", "__id"], "ranged")
    start = F.expr(f"(shard * __all + {n_shards - 1}) div {n_shards}")
    return whole.withColumn("shard", F.expr(f"__rank * {n_shards} div __all")).select(
        F.col("__id").alias(id_col), "size", "text_crc32", "hilbert", F.col("shard").cast("int").alias("shard"), (F.col("__rank") - start).alias("slot"), *more
    )


def shard_ranges(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Per shard of a table with the column ``shard`` its rows and each dimension's minimum and maximum: what a reader needs to skip shards.

    Nulls count as rows only; a shard of nulls has null bounds. Repeated rows all count. An empty table gives an empty result.
    """
    ranges = [f(F.col(f"`{d}`")).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *ranges)


def write_shards(df: DataFrame, path: str, **options: object) -> None:
    """Write ``df`` as one folder per shard, rows in slot order; options as of ``hilbert_shards``.

    Every row is written once, whatever its id: null and repeated ids, and wholly equal rows, are rows like
    others. Columns named shard or slot are replaced. A large shard spreads over several files.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    placed = hilbert_shards(df, keep=kept, **options)
    whole = placed.select(*[F.col("row").getField(c).alias(c) for c in kept], "shard", "slot")
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
