"""Near-duplicate texts by minwise signatures with banding, estimated and then verified exactly.

A text is its set of word shingles, and equal sets are one class. A class has the minima of its shingles' hashes under
``bands`` * ``rows`` permutations. Sets of Jaccard similarity s share each minimum with probability s, so with 32 bands of
four they share a band with probability 1 - (1 - s**4)**32: 1 - 5e-8 at 0.8, 0.26 at 0.3. Classes that share a band are
candidates; the share of equal minima estimates the similarity, and estimates that are far too low (by 0.2, five
deviations) drop out. The rest are compared set with set.

Of a band that many classes share not all pairs are made. Its classes are first compared with four hubs. What is one
component then needs no more. The others meet by rare shingles: two sets of similarity s or more have a shingle in common
among the first n - ceil(s n) + 1 of each in any common order, so in the order of rarity the passage that a whole band
shares stands in few of these prefixes. Where many meet even so, they are cut into parts, each two parts are
multiplied as matrices of texts by shingles, which counts all their common shingles at once, and a task sends on no
more links than it has rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.graph import components
from quern.operators.scratch import fresh, stored
from quern.session import small_batches

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``words`` words; a shorter text is one shingle.

    Words stand between ASCII blanks, A-Z in lower case. A word's hash enters its shingles' by place.
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    with np.errstate(over="ignore"):
        sums = np.full(max(1, len(hashes) - size + 1), size, np.uint64)
        for i in range(size):
            sums = sums * _MIX + hashes[i : i + len(sums)]
            sums ^= sums >> np.uint64(29)
        return np.unique(sums * _MIX)


@cache
def _odd(n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(i.to_bytes(4, "little"), 7) & 0xFFFFFFFF | 1 for i in range(n)], np.uint32)[:, None]


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """The minima of the upper halves of the shingles' hashes under ``n`` permutations (multiplications by odd numbers, then a mix).

    Of 32 bits, as processors multiply and compare eight such numbers at once. Shingles that meet in them only raise an estimate.
    """
    odd, halves = _odd(n), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    mixes, shifts = np.empty((2, 32, min(1024, len(halves))), np.uint32)  # within the cache, whatever the text's length
    for z in range(0, len(halves), 1024):
        part = halves[z : z + 1024]
        for a in range(0, n, 32):
            several = odd[a : a + 32]
            mixed, shifted = mixes[: len(several), : len(part)], shifts[: len(several), : len(part)]
            np.multiply(part, several, out=mixed)
            np.right_shift(mixed, np.uint32(15), out=shifted)
            np.bitwise_xor(mixed, shifted, out=mixed)
            np.multiply(mixed, np.uint32(0x85EBCA6B), out=mixed)
            np.minimum(least[a : a + 32], mixed.min(axis=1), out=least[a : a + 32])
    return least


def spanning(components_: list, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of that similarity between rows ``left`` and ``right`` of different components: enough to join all that any link joins."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = values[counts > 1]
    both = np.zeros((len(left), len(right)), np.float32)
    places = [np.searchsorted(shared, s[np.isin(s, shared, assume_unique=True)]) for s in sets]
    for a in range(0, len(shared), 4096):
        dense = np.zeros((len(sets), min(4096, len(shared) - a)), np.float32)
        for i, p in enumerate(places):
            dense[i, p[(p >= a) & (p < a + 4096)] - a] = 1
        both += dense[left] @ dense[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    label = np.unique(np.array(components_, dtype=object), return_inverse=True)[1]
    alike = (both >= similarity * union) & (label[left][:, None] != label[right][None, :])
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.get(x, x) != x:
            x = above[x] = above.get(above[x], above[x])
        return x

    found = []
    for i, j in zip(*(at.tolist() for at in np.nonzero(alike))):
        a, b = root(int(label[left[i]])), root(int(label[right[j]]))
        if a != b:
            above[a] = b
            found.append((int(left[i]), int(right[j])))
    return found


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    a, b = sets.select(F.col("key").alias("u"), F.col("set").alias("a")), sets.select(F.col("key").alias("v"), F.col("set").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").where(both >= similarity * (F.size("a") + F.size("b") - both)).select("u", "v")


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree in at least this share of the minima."""
    a, b = classes.select(F.col("key").alias("u"), F.col("minima").alias("a")), classes.select(F.col("key").alias("v"), F.col("minima").alias("b"))
    same = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x))
    return pairs.join(a, "u").join(b, "v").where(same >= least * F.size("a")).select("u", "v")


def _by_rarity(open_: DataFrame, sets: DataFrame, similarity: float, small: int, part_rows: int, part_shingles: int) -> DataFrame:
    """Links among ``open_`` (key, component) between components: all that exact prefixes find, as a spanning set in hot groups."""
    each = stored(open_.join(sets, "key").select("key", "component", F.size("set").alias("size"), F.explode("set").alias("s")), "shingles")
    rare = stored(each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    ranked = each.join(rare, "s").groupBy("key", "component", "size").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("known"))
    # Shingles of one text alone come before the others and meet nothing.
    cut = (F.size("known") - F.ceil(similarity * F.col("size") - 1e-9) + 1).cast("int")
    prefix = ranked.withColumn("cut", cut).where("cut > 0").select("key", "component", "size", F.explode(F.slice("known", F.lit(1), F.col("cut"))).alias("k"))
    prefix = stored(prefix.select("key", "component", "size", "k.s"), "prefixes")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / part_rows), F.ceil(F.sum("size") / part_shingles)).cast("int").alias("parts")
    groups = prefix.groupBy("s").agg(F.count(F.lit(1)).alias("n"), parts, F.min("component").alias("a"), F.max("component").alias("z"))
    met = stored(prefix.join(stored(groups.where("a <> z").select("s", "n", "parts"), "groups"), "s"), "met")

    few = met.where(F.col("n") <= small)
    x, y = few.alias("x"), few.alias("y")
    sized = F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-9
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & sized)
    pairs = stored(pairs.select(F.col("x.key").alias("u"), F.col("y.key").alias("v")).distinct(), "pairs")

    many = met.where(F.col("n") > small).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.select("s", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "component", "key").join(sets, "key")

    def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (np.flatnonzero((rows["part"] == p).to_numpy()) for p in key[-2:])
        keys = rows["key"].tolist()
        found = spanning(rows["component"].tolist(), [np.asarray(s, np.int64) for s in rows["set"]], left, right, similarity)
        return pd.DataFrame([(keys[a], keys[b]) for a, b in found], columns=["u", "v"], dtype=object)

    return _verified(pairs, sets, similarity).unionByName(many.groupBy("s", "i", "j").applyInPandas(multiply, "u binary, v binary"))


def class_sets(texts: DataFrame, owners: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, set) of the classes ``wanted`` (key), from the ``texts`` (id, text) of their ``owners`` (owner).

    The sets are made in ``mapInArrow``, below which Spark moves no join: of a UDF's column the join with ``wanted`` would be
    moved down to all texts, and each text's set made for its key alone.
    """

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, words) for t in b.column(0).to_pylist()]
            keys = pa.array([hashlib.md5(s.tobytes()).digest() for s in found], pa.binary())
            yield pa.record_batch([keys, pa.array([np.sort(s.view(np.int64)) for s in found], pa.list_(pa.int64()))], ["key", "set"])

    again = texts.join(owners.select("owner").distinct(), F.col("id").eqNullSafe(F.col("owner")), "left_semi")
    sets = again.select("text").mapInArrow(as_sets, "key binary, set array<long>")
    return sets.dropDuplicates(["key"]).join(wanted, "key", "left_semi")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 4, small: int = 32, part_rows: int = 512, part_shingles: int = 1 << 19) -> DataFrame:
    """(id, same_as, component): the smallest id with the same shingles, and the smallest id that links of ``similarity`` reach.

    One row for each row of ``df``. Texts without a word have one shingle, the empty one, and are the same. Null ids count
    as larger than all others. Repeated rows come back repeated. Two texts with a similarity of ``similarity`` or more are
    in one component unless their signatures share no band (see above); texts below are never linked directly.
    """
    small_batches(df.sparkSession)
    named = fresh([id_col], "same_as", "component")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, hashes, minima = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, words)
                m = signature(s, bands * rows)
                keys.append(hashlib.md5(s.tobytes()).digest())
                hashes.append([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in m.reshape(bands, rows)])
                minima.append(m.view(np.int32))
            yield pa.record_batch([b.column(0), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(minima, pa.list_(pa.int32()))], ["id", "key", "bands", "minima"])

    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    form = texts.select("id", F.lit(b"").alias("key"), F.array().cast("array<long>").alias("bands"), F.array().cast("array<int>").alias("minima")).schema
    sketches = stored(texts.mapInArrow(sketch, form), "sketches")
    owner = F.min_by("id", F.struct(F.col("id").isNull(), "id")).alias("owner")
    classes = stored(sketches.groupBy("key").agg(owner, F.first("bands").alias("bands"), F.first("minima").alias("minima")), "classes")

    banded = classes.select("key", F.posexplode("bands").alias("band", "hash"))
    sizes = stored(banded.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    shared = stored(banded.join(sizes, ["band", "hash"]), "shared")
    few, many = shared.where(F.col("n") <= small), shared.where(F.col("n") > small)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.hash") == F.col("y.hash")) & (F.col("x.key") < F.col("y.key"))).select(F.col("x.key").alias("u"), F.col("y.key").alias("v"))
    quarter = F.pmod(F.xxhash64("key"), F.lit(4))
    hubs = stored(many.groupBy("band", "hash").agg(F.array_compact(F.array(*[F.min(F.when(quarter == i, F.col("key"))) for i in range(4)])).alias("hubs")), "hubs")
    stars = many.join(hubs, ["band", "hash"]).select("key", F.explode("hubs").alias("hub")).where("key <> hub")
    pairs = pairs.unionByName(stars.select(F.least("key", "hub").alias("u"), F.greatest("key", "hub").alias("v"))).distinct()
    pairs = stored(_likely(pairs, classes, similarity - 0.2), "likely")

    # Sets of the classes that are compared only, from the text of their first row.
    wanted = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).unionByName(many.select("key")).distinct()
    sets = stored(class_sets(texts, classes.join(wanted, "key"), wanted, words), "sets")
    links = stored(_verified(pairs, sets, similarity), "near")
    nodes = stored(components(links).withColumnRenamed("node", "key"), "nodes")

    labelled = many.select("band", "hash", "key").join(nodes, "key", "left").withColumn("component", F.coalesce("component", "key"))
    split = labelled.groupBy("band", "hash").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a <> z").select("band", "hash")
    open_ = stored(labelled.join(split, ["band", "hash"]).select("key", "component").distinct(), "open")
    if not open_.isEmpty():
        more = stored(_by_rarity(open_, sets, similarity, small, part_rows, part_shingles), "more")
        nodes = components(more.unionByName(nodes.select(F.col("key").alias("u"), F.col("component").alias("v")))).withColumnRenamed("node", "key")
    placed = classes.select("key", "owner").join(nodes, "key", "left").withColumn("component", F.coalesce("component", "key"))
    lowest = F.min_by("owner", F.struct(F.col("owner").isNull(), "owner")).alias("lowest")
    names = stored(placed.join(placed.groupBy("component").agg(lowest), "component").select("key", "owner", "lowest"), "names")
    return sketches.select("id", "key").join(names, "key").select(F.col("id").alias(id_col), F.col("owner").alias(named[0]), F.col("lowest").alias(named[1]))
