"""What the vector operators share: valid vectors, fast pseudo-rotations, splitting of hot groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import durable

#: A list of hot groups is broadcast up to this many rows; a longer one is joined by a shuffle.
BROADCAST_GROUPS = 100_000


def is_vector(c: Column) -> Column:
    """True for vectors that are not null, hold finite numbers only, and are not all zero."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(c, lambda x: x != 0), F.lit(False))


def width(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def signs(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` pseudo-rotations: three diagonals of random signs each."""
    return np.random.default_rng([seed, dim]).integers(0, 2, (count, 3, width(dim))) * 2.0 - 1.0


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Hadamard transform of rows. Sums and differences only, so a row's result doesn't depend on the others."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), diagonals.shape[1]))
    out[:, : x.shape[1]] = x
    for s in diagonals:
        out = hadamard(out * s)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def with_parts(rows: DataFrame, sizes: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``rows`` with ``parts``: into how many parts of about ``limit`` rows its group falls. ``sizes``: keys and n."""
    hot = durable(sizes.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("__parts")), "hot")
    side = F.broadcast(hot) if hot.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else hot
    return rows.join(side, keys, "left").withColumn("parts", F.coalesce("__parts", F.lit(1))).drop("__parts")
