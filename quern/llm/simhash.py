"""SimHash near-duplicates, joined through pivot distance tables.

A fingerprint's row in the pivot distance table holds its Hamming distance to
each of 64 reference fingerprints. If two fingerprints differ in at most t bits,
no coordinate of their rows differs by more than t (the triangle inequality), so
a pair with a larger coordinate difference is discarded and only the survivors
are compared bit by bit.

To reach the pairs without comparing all rows with all rows, some references are
chosen so that their coordinates also make exact join keys. Reference 0 has no
bit set and reference j has just the j-th pair of bits set, so that
``(d0 - dj + 2) / 2`` is the number of ones in that pair. Four groups of eight
pairs are formed. Two differing bits touch at most two groups, so any linked
pair agrees on all sixteen counts of some two groups: six keys a fingerprint, of
about 24 bits of entropy each.

Distinct fingerprints only are joined; copies hang on theirs. A bucket with more
than ``bucket_limit`` fingerprints isn't compared pair by pair: each of its
fingerprints is sent to the points at distance 1 or less from it, and those that
meet at a point (65 at most, all within 2 bits of each other) are linked to the
smallest there. This finds the same components with a number of rows in
proportion to the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import connected_components, durable, fresh
from quern.session import small_batches

SEED = 42
MAX_BITS = 2
PAIRS = 32
GROUPS = 4


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: No bits, each pair of bits, then 31 fixed pseudo-random words.
REFERENCES = [0, *(_signed(3 << 2 * j) for j in range(PAIRS)), *(_signed(xxhash.xxh64_intdigest(bytes([i]), SEED)) for i in range(31))]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of a text's shingles of ``words`` words in order, repeats included; a shorter text is one shingle.

    ASCII letters count in lower case and only ASCII white space parts words. Null and texts without a word have none.
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # of bytes, so ASCII only
    if not tokens:
        return np.zeros(0, "<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends[min(words, len(tokens)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops)), dtype="<u8", count=len(stops))


def majority(hashes: np.ndarray) -> int:
    """The signed number whose bits are set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed 64-bit SimHash of one text's shingles."""
    return majority(shingle_hashes(text, words))


def with_fingerprint(df: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = 3, name: str = "fingerprint") -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if none are named) and the fingerprint of ``text`` as a long.

    Null texts and texts without a word have fingerprint 0; whole texts of any length are read, a block of
    hashes at a time. Rows stay as they are, repeated ones too; a column named as the fingerprint is replaced.
    An empty table gives an empty result.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns="__text")
            out[name] = np.array([fingerprint(t, words) for t in pdf["__text"]], dtype=np.int64)
            yield out

    chosen = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = chosen.drop("__text").withColumn(name, F.lit(0).cast("long")).schema
    return chosen.mapInPandas(run, schema)


def _bucket_keys() -> F.Column:
    count = [None] + [((F.element_at("dist", 1) - F.element_at("dist", j + 1) + 2) / 2).cast("long") for j in range(1, PAIRS + 1)]
    size = PAIRS // GROUPS
    keys = []
    for combo in combinations(range(GROUPS), GROUPS - MAX_BITS):
        members = [g * size + i + 1 for g in combo for i in range(size)]
        packed = F.lit(0).cast("long")
        for at, j in enumerate(members):
            packed = packed.bitwiseOR(F.shiftleft(count[j], 2 * at))
        keys.append(F.struct(F.lit(len(keys)).alias("combo"), packed.alias("key")))
    return F.array(*keys)


def pivot_table(fingerprints: DataFrame) -> DataFrame:
    """(fp, dist): the Hamming distances of each distinct fingerprint to the references."""
    dist = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(r).cast("long"))).cast("byte") for r in REFERENCES])
    return fingerprints.select("fp", dist.alias("dist"))


def fingerprint_links(distinct_fps: DataFrame, bucket_limit: int = 256) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` whose components are those of all links of 2 bits or less."""
    table = durable(pivot_table(distinct_fps), "pivots")
    slim = durable(table.select("fp", F.explode(_bucket_keys()).alias("b")).select("fp", "b.combo", "b.key"), "buckets")
    sizes = durable(slim.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    shared = durable(slim.join(sizes, ["combo", "key"]), "shared")

    cold = shared.where(F.col("n") <= bucket_limit).join(table, "fp")
    a, b = cold.alias("a"), cold.alias("b")
    apart = F.zip_with(F.col("a.dist"), F.col("b.dist"), lambda x, y: F.abs(x.cast("int") - y))
    linked = a.join(
        b,
        (F.col("a.combo") == F.col("b.combo"))
        & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & F.forall(apart, lambda d: d <= MAX_BITS)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS),
    ).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    hot = shared.where(F.col("n") > bucket_limit).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64)])
    points = hot.select("fp", F.explode(around).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("m"))
    stars = points.join(least, "point").where("fp <> m").select(F.col("m").alias("u"), F.col("fp").alias("v"))
    return linked.unionAll(stars).distinct()


def simhash_components(rows: DataFrame, key: str, bucket_limit: int = 256) -> DataFrame:
    """Adds ``component`` to rows that have a long column ``fp``: the smallest ``key`` of all rows reachable by links.

    Fingerprints link at 2 or fewer differing bits, equal ones included. Rows with a null key stay; they
    take no part in the minimum, so a component of null keys alone has a null name. Repeated rows stay, null
    fingerprints get a null component, and a column named component is replaced. An empty table gives an empty result.
    """
    rows = rows.drop("component")
    per_fp = durable(rows.groupBy("fp").agg(F.min(key).alias("least")), "fingerprints")
    nodes = connected_components(fingerprint_links(per_fp.select("fp"), bucket_limit))
    placed = per_fp.join(nodes, per_fp.fp == nodes.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    placed = durable(placed, "placed")
    named = placed.groupBy("c").agg(F.min("least").alias("component"))
    names = placed.join(named, "c").select(F.col("fp").alias("__fp"), "component")
    return rows.join(names, rows.fp == F.col("__fp"), "left").drop("__fp")


BANDS = 12
SAMPLE = 3
#: The bands' permutations multiply by these.
_ODD = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) | 1 for b in range(BANDS)], dtype=np.uint64)


def sampled_fingerprints(shingles: np.ndarray) -> list[int]:
    """One SimHash for each band, of the three shingles that the band's permutation puts first.

    Texts of Jaccard similarity s share a band's sample, and so its fingerprint, with probability of about s ** 3.
    """
    n = len(shingles)
    if n <= SAMPLE:
        return [majority(shingles)] * BANDS
    out: list[int] = []
    step = max(1, (1 << 20) // n)  # bands at a time, by memory
    for at in range(0, BANDS, step):
        mixed = shingles[None, :] * _ODD[at : at + step, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        first = shingles[np.argpartition(mixed, SAMPLE - 1, axis=1)[:, :SAMPLE]]
        ones = np.unpackbits(np.ascontiguousarray(first, "<u8").view(np.uint8).reshape(len(first), SAMPLE, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
        out += np.packbits((2 * ones > SAMPLE).astype(np.uint8), axis=1, bitorder="little").view("<i8")[:, 0].tolist()
    return out


def _buckets(texts: DataFrame, bucket_limit: int) -> DataFrame:
    """(band, sample, key, n): texts that share a sampled fingerprint, or (band -1) a component of linked whole-text ones."""
    fps = durable(texts.select("fp").distinct(), "text-fps")
    nodes = connected_components(fingerprint_links(fps, bucket_limit)).withColumnRenamed("node", "fp")
    whole = texts.select("key", "fp").join(nodes, "fp", "left").select("key", F.lit(-1).alias("band"), F.coalesce("component", "fp").alias("sample"))
    bands = texts.select("key", F.posexplode("samples").alias("band", "sample")).unionByName(whole)
    sizes = durable(bands.groupBy("band", "sample").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band-sizes")
    return durable(bands.join(sizes, ["band", "sample"]), "bands")


HUBS = 4


def _candidate_pairs(shared: DataFrame, small: int = 32) -> DataFrame:
    """Pairs (u, v) of text keys to verify: all of a small bucket, and in a large one each text with its hubs.

    Hubs are the texts that meet the most others over all bands, one in each of four hash classes. They only
    join the bulk of a large group; ``_prefix_links`` finds all its other links.
    """
    few = shared.where(F.col("n") <= small)
    x, y = few.alias("x"), few.alias("y")
    met = (F.col("x.band") == F.col("y.band")) & (F.col("x.sample") == F.col("y.sample")) & (F.col("x.key") < F.col("y.key"))
    pairs = x.join(y, met).select(F.col("x.key").alias("u"), F.col("y.key").alias("v"))

    weight = shared.groupBy("key").agg(F.sum("n").alias("weight"))
    many = durable(shared.where(F.col("n") > small).join(weight, "key"), "large")
    of_class = [F.pmod(F.xxhash64("key"), F.lit(HUBS)) == j for j in range(HUBS)]
    best = [F.max_by(F.when(c, F.col("key")), F.when(c, F.struct("weight", "key"))) for c in of_class]
    hubs = durable(many.groupBy("band", "sample").agg(F.array_compact(F.array(*best)).alias("hubs")), "hubs")
    stars = many.join(hubs, ["band", "sample"]).select("key", F.explode("hubs").alias("hub")).where("key <> hub")
    return pairs.unionByName(stars.select(F.least("key", "hub").alias("u"), F.greatest("key", "hub").alias("v"))).distinct()


def links_between(keys: list, components: list, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float, pivots: int = 16) -> list[tuple]:
    """Verified links that join the components of rows ``left`` and ``right``: a spanning set of all links between them.

    A set's fingerprint holds the parity of its shingles in each of some bins, so that two fingerprints differ
    in no more bits than the sets differ in shingles. The pivot distance table holds each row's Hamming
    distances to the fingerprints of some rows, and its size, which is its distance from the empty set. Pairs
    with a coordinate difference above what the similarity allows are discarded without loss, then pairs with
    such a Hamming distance; the survivors' sets are compared.
    """
    size = np.array([len(s) for s in sets])
    bins = 1 << max(10, int(size.max(initial=1)).bit_length())
    bits = np.stack([np.packbits((np.bincount(s.astype(np.uint64) % np.uint64(bins), minlength=bins) & 1).astype(np.uint8)).view(np.uint64) for s in sets])
    references = bits[np.linspace(0, len(bits) - 1, min(pivots, len(bits))).astype(int)]
    table = np.stack([size, *(np.bitwise_count(bits ^ r).sum(axis=1, dtype=np.int64) for r in references)], axis=1)
    label = np.unique(np.array(components), return_inverse=True)[1]
    share = (1 - similarity) / (1 + similarity)
    out = []
    for i in left.tolist():
        others = right[label[right] != label[i]]
        most = share * (size[others] + size[i]) + 1e-6
        near = np.abs(table[others] - table[i]).max(axis=1, initial=0) <= most
        others, most = others[near], most[near]
        near = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most
        for j in others[near].tolist():
            if label[i] == label[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similarity * (size[i] + size[j] - both):
                out.append((keys[i], keys[j]))
                label[label == label[j]] = label[i]
    return out


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least this Jaccard similarity."""
    left, right = sets.select(F.col("key").alias("u"), F.col("set").alias("a")), sets.select(F.col("key").alias("v"), F.col("set").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    alike = both >= similarity * (F.size("a") + F.size("b") - both)
    return pairs.join(left, "u").join(right, "v").where(alike).select("u", "v")


def _prefix_links(shared: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, small: int = 32, part_rows: int = 512, part_shingles: int = 1 << 19) -> DataFrame:
    """Links (u, v) among the texts of large buckets that aren't of one component of ``nodes`` yet, with none left out.

    Sets of n shingles and Jaccard similarity s or more have, in any common order of the shingles, one in
    common among the first n - ceil(s n) + 1 of each. Rare shingles go first, so that a passage which many
    texts share is in few prefixes. Texts meet by the shingles of their prefixes; a shingle whose texts are of
    one component is dropped. Few texts are paired at once. More are cut into parts by rows and shingles, and
    each two parts meet in a task of their own; what it sends on is linear.
    """
    many = shared.where(F.col("n") > small).select("band", "sample", "key").join(nodes, "key", "left").withColumn("component", F.coalesce("component", "key"))
    ends = many.groupBy("band", "sample").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    texts = many.join(ends, ["band", "sample"]).select("key", "component").distinct()
    each = durable(texts.join(sets, "key").select("key", "component", F.size("set").alias("size"), F.explode("set").alias("s")), "open-shingles")
    counts = durable(each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shingle-counts")
    ranked = each.join(counts, "s").groupBy("key", "component", "size").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("rare"))
    # Shingles of one text only stand before all others and meet nothing.
    first = (F.size("rare") - F.ceil(similarity * F.col("size") - 1e-9) + 1).cast("int")
    prefix = ranked.withColumn("first", first).where("first > 0").select("key", "component", "size", F.explode(F.slice("rare", F.lit(1), F.col("first"))).alias("r"))
    prefix = durable(prefix.select("key", "component", "size", "r.s"), "prefixes")
    pieces = F.greatest(F.ceil(F.count(F.lit(1)) / part_rows), F.ceil(F.sum("size") / part_shingles)).cast("int")
    groups = prefix.groupBy("s").agg(F.count(F.lit(1)).alias("n"), pieces.alias("parts"), F.min("component").alias("low"), F.max("component").alias("high"))
    groups = durable(groups.where("low <> high").select("s", "n", "parts"), "prefix-groups")
    met = durable(prefix.join(groups, "s"), "prefix-rows")

    few = met.where(F.col("n") <= small)
    x, y = few.alias("x"), few.alias("y")
    apart = (F.col("x.key") < F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
    sized = F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-9
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & apart & sized).select(F.col("x.key").alias("u"), F.col("y.key").alias("v")).distinct()

    rows = met.where(F.col("n") > small).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("s", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "component", "key").join(sets, "key")
    kind = sets.schema["key"].dataType.simpleString()

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = [np.flatnonzero((pdf["part"] == p).to_numpy()) for p in key[-2:]]
        found = links_between(pdf["key"].tolist(), pdf["component"].tolist(), [np.asarray(s, dtype=np.int64) for s in pdf["set"]], at[0], at[1], similarity)
        return pd.DataFrame(found, columns=["u", "v"], dtype=object)

    return verified(durable(pairs, "prefix-pairs"), sets, similarity).unionByName(rows.groupBy("s", "low", "high").applyInPandas(link, f"u {kind}, v {kind}"))


def pieces(batches: Iterator[pa.RecordBatch], text_bytes: int = 1 << 20, most: int = 256) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows in pieces of some ``text_bytes`` (a longer text is one alone) and ``most`` rows at most: the other columns, and the texts, which stand last.

    A task holds one piece's texts and results beside the batch, whatever rows Spark sends at once.
    """
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            full = np.searchsorted(ends, (ends[at - 1] if at else 0) + text_bytes, "right")
            stop = min(max(int(full), at + 1), at + most)
            part = b.slice(at, stop - at)
            yield part.select(list(range(b.num_columns - 1))), part.column(b.num_columns - 1).to_pylist()
            at = stop


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bucket_limit: int = 256) -> DataFrame:
    """One document of each near-duplicate group: the row with the smallest id; the columns stay as they are.

    Candidates are texts whose whole-text fingerprints differ in 2 bits or fewer (pivot distance tables), and,
    as near copies of similarity 0.8 lie about ten bits apart, texts with an equal sampled fingerprint (see
    ``sampled_fingerprints``; 12 bands find a pair of similarity 0.8 with probability 0.9998). Candidates are
    verified: they link if the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``similarity``. Groups are the components of the links. In a group of more than 32 texts that share a
    sample each text is first compared with four others; where that leaves several components, all links
    among the texts of such groups are found by prefixes and pivot distances (``_prefix_links``).

    Rows are told apart by id and a hash of the whole row. Null ids count as the largest. Of rows that are
    wholly equal one stays. Null texts count as empty; texts without a word form one group. Texts are compared
    whole. An empty table gives an empty result; extra columns of any name pass through.
    """
    small_batches(docs.sparkSession)
    own_row, kept_id, kept_row = fresh(docs.columns, "own_row", "kept_id", "kept_row")
    values = [F.col(f"`{c}`") for c in docs.columns]
    row_hash = F.xxhash64(F.array(*[v.isNull() for v in values]), *values)  # in which column a null stands counts
    slim = docs.select(F.col(f"`{id_col}`").alias("__id"), row_hash.alias("__row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    slim = slim.withColumn("key", F.unhex(F.md5(F.col("__text").cast("binary"))))

    form = slim.drop("__text").withColumn("fp", F.lit(0).cast("long")).withColumn("samples", F.array().cast("array<long>")).schema

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in pieces(batches):
            fps, samples = [], []
            for t in texts:
                h = shingle_hashes(t, words)
                fps.append(majority(h))
                samples.append(sampled_fingerprints(np.unique(h)))
            yield pa.record_batch([*rest.columns, pa.array(fps, pa.int64()), pa.array(samples, pa.list_(pa.int64()))], form.names)

    rows = durable(slim.select(*form.names[:-2], "__text").mapInArrow(sketch, form), "sketches")
    texts = durable(rows.groupBy("key").agg(F.first("fp").alias("fp"), F.first("samples").alias("samples")), "texts")
    shared = _buckets(texts, bucket_limit)
    pairs = durable(_candidate_pairs(shared), "pairs")

    wanted = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in pieces(batches):
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts]
            sets = [h if len(h) else np.zeros(1, np.int64) for h in sets]  # texts without a word are alike
            yield pa.record_batch([*rest.columns, pa.array(sets, pa.list_(pa.int64()))], ["key", "set"])

    owner = rows.groupBy("key").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__row")).alias("o"))
    one = owner.join(wanted, "key").select(F.col("o.__id").alias("__id"), F.col("o.__row").alias("__row"), "key")
    source = slim.drop("key").alias("s").join(one.alias("o"), F.col("s.__id").eqNullSafe(F.col("o.__id")) & (F.col("s.__row") == F.col("o.__row")))
    sets = source.select("o.key", "s.__text").mapInArrow(shingle_sets, "key binary, set array<long>")
    sets = durable(sets.dropDuplicates(["key"]), "sets")
    edges = durable(verified(pairs, sets, similarity), "near")
    nodes = durable(connected_components(edges).withColumnRenamed("node", "key"), "first-nodes")
    more = durable(_prefix_links(shared, nodes, sets, similarity), "prefix-links")
    if not more.isEmpty():
        nodes = connected_components(more.unionByName(nodes.select(F.col("key").alias("u"), F.col("component").alias("v")))).withColumnRenamed("node", "key")
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    firsts = rows.groupBy("key").agg(F.min(order).alias("k")).join(nodes, "key", "left")
    kept = firsts.groupBy(F.coalesce("component", "key").alias("c")).agg(F.min("k").alias("k")).select(F.col("k.id").alias(kept_id), F.col("k.row").alias(kept_row))
    kept = durable(kept, "kept")
    tagged = docs.withColumn(own_row, row_hash)
    found = tagged.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(kept_id)) & (F.col(own_row) == F.col(kept_row)), "left_semi")
    once = found.dropDuplicates([own_row, id_col])  # wholly equal rows, of which each task keeps one before the shuffle
    return once.select(*values)
