"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c are sqrt(2 - 2c) apart. A rotation keeps distances, so if
the rotated vectors are split into blocks, some block holds at most its share of the
squared distance. Each block is range-joined under its proportional budget: rows go
to the cell of a grid on the block's leading coordinates and visit the neighbour
cells within reach, block distances discard most pairs, and the rest is verified on
the original vectors. A pair counts in its first block within budget only, so the
union over the blocks holds each pair once and none is missed.

Equal vectors are joined as one row with a count. Cells send on sums and spanning
trees, never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import connected_components, durable
from quern.llm.vectors import is_vector, rotate, signs, unit, with_parts

BLOCK_DIMS = 8
GRID_DIMS = 2
SLACK = 1e-9  # above all rounding errors of the distances


def _blocks(rotated: np.ndarray) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, rotated.shape[1])) for a in range(0, rotated.shape[1], BLOCK_DIMS)]


def _reach(cosine: float, part: slice, dims: int) -> float:
    return float(np.sqrt((2 - 2 * cosine + SLACK) * (part.stop - part.start) / dims))


def cells_of(rotated: np.ndarray, cosine: float) -> list[list[dict]]:
    """Per row its home cell in each block and the neighbour cells that it visits; of two neighbours one visits the other."""
    out: list[list[dict]] = [[] for _ in range(len(rotated))]
    for j, part in enumerate(_blocks(rotated)):
        reach = _reach(cosine, part, rotated.shape[1])
        side = 2 * reach
        x = rotated[:, part][:, :GRID_DIMS]
        if x.shape[1] < GRID_DIMS:
            x = np.pad(x, ((0, 0), (0, GRID_DIMS - x.shape[1])))
        cell = np.floor(x / side).astype(np.int64)
        up = x >= (cell + 1) * side - reach - SLACK
        down = x <= cell * side + reach + SLACK
        for dx, dy, goes in ((0, 0, np.ones(len(x), bool)), (1, 0, up[:, 0]), (0, 1, up[:, 1]), (1, 1, up[:, 0] & up[:, 1]), (1, -1, up[:, 0] & down[:, 1])):
            for i in np.flatnonzero(goes):
                out[i].append(dict(block=j, cx=int(cell[i, 0]) + dx, cy=int(cell[i, 1]) + dy, visits=bool(dx or dy)))
    return out


def linked_pairs(x: np.ndarray, rotated: np.ndarray, block: int, cosine: float, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows ``left`` and ``right`` (i < j if ``same``) whose first block within budget is ``block`` and whose cosine reaches the limit."""
    parts = _blocks(rotated)
    budgets = np.array([_reach(cosine, p, rotated.shape[1]) ** 2 for p in parts])
    starts = [p.start for p in parts]
    y = rotated[:, parts[block]]
    norms, lengths = (y * y).sum(axis=1), np.sqrt((x * x).sum(axis=1))
    for at in range(0, len(left), 256):
        a = left[at : at + 256]
        near = norms[a][:, None] + norms[right][None, :] - 2 * (y[a] @ y[right].T) <= budgets[block] + SLACK
        i, j = np.nonzero(near)
        i, j = a[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 14):
            p, q = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
            apart = np.add.reduceat((rotated[p] - rotated[q]) ** 2, starts, axis=1) <= budgets
            first = apart[:, block] & ~apart[:, :block].any(axis=1)
            p, q = p[first], q[first]
            close = (x[p] * x[q]).sum(axis=1) / (lengths[p] * lengths[q]) >= cosine
            if close.any():
                yield p[close], q[close]


def joined_roots(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``root`` (each row's smallest linked row, itself a root) after the links of rows ``p`` and ``q``. Only roots are hooked, so earlier links stay."""
    while True:
        a, b = root[p], root[q]
        if (a == b).all():
            return root
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def embedding_near_dups(df: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", seed: int = 3, limit: int = 4096) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of ``df``.

    Rows link if their labels are equal and not null and the cosine of their vectors is at least ``cosine``,
    in double precision. Vectors that are null, zero or hold null or non-finite numbers link with nothing,
    nor do rows with a null id (null component and kept). ``n_links`` counts the other rows linked directly,
    copies included; ``component_id`` is the smallest id reachable, the row's own included; ``kept`` says
    whether it is the row's own. Rows that repeat an id count as vectors of their own. Other columns are ignored,
    and an empty table gives an empty result.

    A cell of more than ``limit`` rows is split into parts, and each two parts meet in a task of their own.
    """
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec"), F.col(f"`{label_col}`").alias("label"))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & is_vector(F.col("vec"))
    reps = durable(base.where(valid).groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            sizes = pdf["vec"].map(len).to_numpy()
            cells: list[list] = [[] for _ in range(len(pdf))]
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                turned = rotate(unit(np.stack(pdf["vec"].to_numpy()[at]).astype(np.float64)), signs(int(size), 1, seed)[0])
                for i, c in zip(at, cells_of(turned, cosine)):
                    cells[i] = c
            out = pdf.copy()
            out["dim"], out["cells"] = sizes.astype(np.int32), cells
            yield out

    cell_type = F.array().cast("array<struct<block:int,cx:long,cy:long,visits:boolean>>")
    placed = durable(reps.mapInPandas(place, reps.withColumn("dim", F.lit(0)).withColumn("cells", cell_type).schema), "placed")
    keys = ["label", "dim", "block", "cx", "cy"]
    sizes = placed.select("label", "dim", F.explode("cells").alias("c")).select("label", "dim", "c.*").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = placed.select("rep", "vec", "copies", "label", "dim", F.explode("cells").alias("c")).select("rep", "vec", "copies", "label", "dim", "c.*")
    rows = with_parts(rows, sizes, keys, limit).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other", "parts")

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        edges: list[tuple[int, int]] = []
        if len(pdf) > 1:
            x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            turned = rotate(unit(x), signs(x.shape[1], 1, seed)[0])
            home, part = ~pdf["visits"].to_numpy(), pdf["part"].to_numpy()
            low, high = key[-2], key[-1]
            h, v = [np.flatnonzero(home & (part == p)) for p in (low, high)], [np.flatnonzero(~home & (part == p)) for p in (low, high)]
            jobs = [(h[0], h[0], True), (v[0], h[0], False)] if low == high else [(h[0], h[1], False), (v[0], h[1], False), (v[1], h[0], False)]
            for left, right, same in jobs:
                for p, q in linked_pairs(x, turned, int(key[2]), cosine, left, right, same):
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    root = joined_roots(root, p, q)
            edges = [(int(ids[root[i]]), int(ids[i])) for i in np.flatnonzero(root != np.arange(len(root)))]
        counted = [(int(ids[i]), None, int(links[i])) for i in np.flatnonzero(links)]
        return pd.DataFrame(counted + [(u, w, 0) for u, w in edges], columns=["u", "v", "n"]).astype({"v": "Int64"})

    found = durable(rows.groupBy(*keys, "low", "high").applyInPandas(join, "u long, v long, n long"), "links")
    nodes = connected_components(found.where("v is not null").select("u", "v"))
    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    named = reps.join(nodes.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    named = named.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    linked = base.where(valid).join(named, ["label", "vec"]).select("id", "links", "component")
    alone = base.where(~valid).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )
