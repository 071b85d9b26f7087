"""Repeated lines go, but for those of the first document that has them.

A line's key is the line without blanks at both ends and with A-Z in lower case. Three passes:

1. Each document's distinct keys are hashed to 64 bits, and the hashes (no texts) are dealt to slices. A slice's task
   keeps two Bloom filters: hashes seen once, and hashes that the first filter had before (seen twice). A key of two
   documents is in the second for certain. Its filter is folded to what few members need, and under ``filter_mb`` in
   all, which is the bound of what is broadcast. The first filters stay in their tasks, so their number has no bound.
2. Only lines that the twice-seen filter holds are suspected; they alone are shuffled, as keys with their document, and
   an aggregate over whole keys confirms those of two documents and finds the first.
3. Documents without a suspected line are finished where they are read. The others meet the keys that they lose.

A full filter makes more suspects, never fewer: the result is exact at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import durable, fresh

_HASHES = 4


def keys_of(text: str | None, least: int) -> list[bytes | None]:
    """The key of each line of a text, None if it has fewer than ``least`` code points. Blanks are those of ASCII."""
    found = []
    for line in (text or "").encode("utf-8", "replace").split(b"\n"):
        key = line.strip().lower()
        found.append(key if len(key) >= least and (key.isascii() or len(key.decode()) >= least) else None)
    return found


def hashed(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def places(hashes: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """The bits of each hash, a row for each hash function, in filters of ``size`` bits (powers of two)."""
    with np.errstate(over="ignore"):
        step = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) | np.uint64(1)
        rows = np.arange(_HASHES, dtype=np.uint64)[:, None] * step[None, :] + (hashes & np.uint64(0xFFFFFFFF))
    return (rows & (np.asarray(size, np.uint64) - np.uint64(1))).astype(np.int64)


class Slice:
    """Two filters over the hashes of a slice: seen once, and seen twice."""

    def __init__(self, size: int) -> None:
        self.size, self.once, self.twice = size, np.zeros(size, bool), np.zeros(size, bool)

    def add(self, hashes: np.ndarray) -> None:
        values, counts = np.unique(hashes, return_counts=True)
        at = places(values, self.size)
        again = (counts > 1) | self.once[at].all(axis=0)
        self.once[at.ravel()] = True
        self.twice[at[:, again].ravel()] = True

    def folded(self, most: int) -> np.ndarray:
        """The twice-seen filter with halves laid over each other until ``most`` bits hold it, and on while it stays an eighth full."""
        bits = self.twice
        full = int(bits.sum())
        while len(bits) > 64 and (len(bits) > most or len(bits) // 2 >= 8 * full):
            half = len(bits) // 2
            bits = bits[:half] | bits[half:]
        return bits


@dataclass
class Twice:
    """The twice-seen filters of all slices, in one array of bytes."""

    starts: np.ndarray
    sizes: np.ndarray
    packed: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        n = np.uint64(len(self.sizes))
        part = ((hashes >> np.uint64(32)) * n >> np.uint64(32)).astype(np.int64)
        at = places(hashes, self.sizes[part]) + self.starts[part]
        return ((self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def twice_seen(df: DataFrame, text_col: str, least: int, filter_mb: int, slice_keys: int) -> Twice:
    """The filter of keys that two documents may share; ``filter_mb`` bounds what comes to the driver and goes to the tasks."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [k for t in b.column(0).to_pylist() for k in {*keys_of(t, least)} - {None}]
            values, counts = np.unique(hashed(found), return_counts=True)  # of a batch two are as good as more
            yield pa.record_batch([pa.array(np.repeat(values, np.minimum(counts, 2)).view(np.int64))], ["h"])

    seen = durable(df.select(F.col(f"`{text_col}`")).mapInArrow(hashes, "h long"), "hashes")
    n = seen.count()
    slices = max(64, -(-n // slice_keys))
    size = 1 << max(6, (16 * n // slices).bit_length())
    most = 1 << max(6, (filter_mb * 8_000_000 // slices).bit_length() - 1)

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slice after slice, as the rows are sorted by it."""

        def told(part: int, now: Slice) -> pa.RecordBatch:
            bits = now.folded(most)
            return pa.record_batch([pa.array([part], pa.int64()), pa.array([len(bits)], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["part", "size", "bits"])

        part, now = -1, None
        for b in batches:
            parts, values = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, z in zip(cuts, cuts[1:]):
                if a < z:
                    if parts[a] != part:
                        if now is not None:
                            yield told(part, now)
                        part, now = int(parts[a]), Slice(size)
                    now.add(values[a:z])
        if now is not None:
            yield told(part, now)

    part = F.expr(f"shiftright(shiftrightunsigned(h, 32) * {slices}L, 32)").alias("part")
    dealt = seen.select(part, "h").repartition(slices, "part").sortWithinPartitions("part")
    rows = dealt.mapInArrow(filters, "part long, size long, bits binary").collect()  # filter_mb in all
    sizes, packed = np.full(slices, 64, np.int64), [bytes(8)] * slices
    for r in rows:
        sizes[r["part"]], packed[r["part"]] = r["size"], bytes(r["bits"])
    return Twice(np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(packed), np.uint8))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, out: str = "lines", filter_mb: int = 64, slice_keys: int = 1 << 20) -> DataFrame:
    """``df`` with ``out``: the text without lines that an earlier document has, and the lines before and dropped.

    A key of at least ``least`` code points that two or more documents hold loses all its lines except in the
    document with the smallest id, which keeps all of them. Other lines stay as they are, joined by line ends.
    Rows with the same id are one document, repeated rows too: each of them is returned. A null id is an id like
    others, larger than all. A null text stays null and counts as one empty line, as an empty text does. Lines and
    texts of any length count whole. An empty table gives an empty result. Columns pass through whatever their
    names; one named ``out`` is replaced.
    """
    doc, seen, gone = fresh([*df.columns, out], "doc", "seen", "gone")
    shared = df.sparkSession.sparkContext.broadcast(twice_seen(df, text_col, least, filter_mb, slice_keys))  # filter_mb at most

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, keys = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                own = {*keys_of(t, least)} - {None}
                owners += [i] * len(own)
                keys += own
            at = np.flatnonzero(shared.value.holds(hashed(keys)))
            chosen = [keys[i] for i in at.tolist()]
            yield pa.record_batch([b.column(0).take(pa.array(np.array(owners, np.int64)[at])), pa.array(chosen, pa.binary()), pa.array([xxhash.xxh3_128_digest(k) for k in chosen], pa.binary())], ["doc", "key", "mark"])

    @F.pandas_udf("struct<n:long,suspected:boolean>")
    def look(texts: pd.Series) -> pd.DataFrame:
        lines = [keys_of(t, least) for t in texts]
        keys = [k for line in lines for k in line if k is not None]
        held = iter(shared.value.holds(hashed(keys)).tolist())
        return pd.DataFrame([(len(line), any([next(held) for k in line if k is not None])) for line in lines], columns=["n", "suspected"])

    @F.pandas_udf("struct<text:string,n_lines:long,n_dropped:long>")
    def cut(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows = []
        for t, m in zip(texts, marks):
            lost = {bytes(x) for x in m} if m is not None else ()
            keep = [not (lost and k is not None and xxhash.xxh3_128_digest(k) in lost) for k in keys_of(t, least)]
            kept = "\n".join([x for x, stays in zip(t.split("\n"), keep) if stays]) if isinstance(t, str) else None
            rows.append((kept, len(keep), len(keep) - sum(keep)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    ids = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    form = ids.select("doc", F.lit(b"").alias("key"), F.lit(b"").alias("mark")).schema
    suspects = durable(ids.mapInArrow(suspected, form), "suspects")
    # Combined before the shuffle, so that a line of a third of all documents is a row for each task.
    met = suspects.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.bool_or(F.col("doc").isNull()).alias("none"))
    shared_keys = durable(met.where("first <> last or (none and first is not null)").select("key", "first"), "repeats")
    lost = suspects.join(shared_keys, "key").where(~F.col("doc").eqNullSafe(F.col("first")))
    lost = durable(lost.groupBy("doc").agg(F.collect_set("mark").alias("marks")), "lost")  # of one document's lines

    text = F.col(f"`{text_col}`")
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    read = df.withColumn(seen, look.asNondeterministic()(text))
    clean = read.where(~F.col(seen)["suspected"]).select(*others, F.struct(text.alias("text"), F.col(seen)["n"].alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).alias(out))
    marked = read.where(F.col(seen)["suspected"]).join(lost.withColumnsRenamed({"doc": doc, "marks": gone}), F.col(f"`{id_col}`").eqNullSafe(F.col(doc)), "left")
    return clean.unionByName(marked.select(*others, cut(text, F.col(gone)).alias(out)))
