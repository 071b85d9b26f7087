"""Spelling variants: words one edit apart, and the common form that a rare one stands for.

Two words are one insertion, deletion or replacement of a code point apart exactly if their common prefix and common
suffix together reach the longer one's length less one. Words become padded matrices of code points, one aligned to the
left and one to the right, and blocks of rows are compared with blocks: a pass over the columns gives both lengths for
all pairs of a tile at once.

Which blocks meet follows from a pigeonhole: of two such words, the shorter one of m code points, the first m div 2 or the
last m - m div 2 are the same. So a word goes to four groups, by its first and its last half, once as the shorter and once
as the longer word, and rows are tiled in the order of their groups. A pair counts in its first half's group alone if both
hold it. Groups beyond ``tile`` words are cut into parts, and each pair of parts is a tile of its own, so that a hot half is
spread over tasks. A tile's finds are summed up to a row for each word before they leave the task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import durable

_UPPER = {c: c + 32 for c in range(65, 91)}


def lowered(word: str) -> str:
    """A-Z in lower case, other letters as they are."""
    return word.lower() if word.isascii() else word.translate(_UPPER)


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = "[A-Za-zÀ-ÿ]+", least_size: int = 6, edit: Callable[[object, list[str]], list[str]] | None = None, held: int = 200_000) -> DataFrame:
    """(word, n) over all texts, for words of at least ``least_size`` code points.

    ``edit`` gets an id and the distinct words of its text and returns what they count as. A task sums up to
    ``held`` words before it sends them on. Null texts have no words.
    """
    runs = re.compile(pattern)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array([*total], pa.string()), pa.array([*total.values()], pa.int64())], ["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own: Counter[str] = Counter()
                for w, n in Counter(runs.findall(t or "")).items():
                    own[lowered(w)] += n
                words = [*own]
                for w, n in zip(edit(i, words) if edit else words, own.values()):
                    if len(w) >= least_size:
                        total[w] += n
                if len(total) > held:
                    yield told()
                    total.clear()
        yield told()

    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _matrix(words: list[str], right: bool) -> np.ndarray:
    """Code points, a row for each word, padded by zeros behind or in front."""
    width = max(map(len, words))
    rows = np.array([w.rjust(width, "\0") if right else w.ljust(width, "\0") for w in words], dtype=f"<U{width}")
    return np.frombuffer(rows.tobytes(), np.uint32).reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows, how many columns are the same from the first on."""
    alive = np.ones((len(a), len(b)), bool)
    size = np.zeros((len(a), len(b)), np.int16)
    for j in range(min(a.shape[1], b.shape[1])):
        alive &= a[:, j, None] == b[None, :, j]
        if not alive.any():
            break
        size += alive
    return size


class Tile:
    """A stretch of words with the groups and parts that they stand in."""

    def __init__(self, words: list[str], groups: np.ndarray, short: np.ndarray, front: np.ndarray, parts: np.ndarray) -> None:
        self.words, self.groups, self.short, self.front, self.parts = words, groups, short, front, parts
        self.sizes = np.array([len(w) for w in words], np.int16)
        self.left = _matrix(words, False)
        self.right = _matrix(words, True)[:, ::-1]

    def near(self, other: Tile) -> tuple[np.ndarray, np.ndarray]:
        """Pairs one edit apart, of this tile and another; each pair once if the other is this tile."""
        longer = np.maximum(self.sizes[:, None], other.sizes[None, :])
        shorter = np.minimum(self.sizes[:, None], other.sizes[None, :])
        ok = (self.groups[:, None] == other.groups[None, :]) & (shorter == self.short[:, None]) & (longer - shorter <= 1)
        ok &= (self.parts[:, None] != other.parts[None, :]) | (self.parts[:, None] < 0)
        if self is other:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        a, b = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
        if not len(a):
            return a, b
        ok = ok[np.ix_(a, b)]
        first, last = _common(self.left[a], other.left[b]), _common(self.right[a], other.right[b])
        ok &= first + last >= longer[np.ix_(a, b)] - 1
        ok &= self.front[a][:, None] | (first < (self.short[a] // 2)[:, None])  # else their first halves' group has the pair
        x, y = np.nonzero(ok)
        return a[x], b[y]


def near_words(words: DataFrame, tile: int = 2048, rows: int = 256) -> DataFrame:
    """(word, n_near, best n, best) for words with one or more near words; best is the near word of largest n, ties to the smallest.

    ``words`` holds (word, n) with distinct words.
    """
    size = F.length("word")
    short = F.explode(F.array(size, size - 1)).alias("m")
    sides = words.select("word", "n", short).where("m > 0").select(
        "word", "n", "m", F.explode(F.array(F.struct(F.lit(True).alias("front"), F.expr("substring(word, 1, cast(m div 2 as int))").alias("half")), F.struct(F.lit(False).alias("front"), F.expr("right(word, cast(m - m div 2 as int))").alias("half")))).alias("s")
    )
    keyed = durable(sides.select("word", "n", F.col("m").cast("int").alias("m"), "s.front", "s.half"), "halves")
    group = ["m", "front", "half"]
    counts = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    # A group of one word has no pair. As a table, so that its size decides how it is joined.
    counts = durable(counts.where("size > 1").select(*group, F.expr(f"cast((size + {tile - 1}) div {tile} as int)").alias("parts")), "groups")
    met = keyed.join(counts, group)
    own = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).otherwise(0)
    met = met.withColumn("part", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = met.select("word", "n", *group, "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
    spread = words.sparkSession.sparkContext.defaultParallelism * 4
    shuffled = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(max(spread, shuffled), *group, "i", "j").sortWithinPartitions(*group, "i", "j", "word")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        numbers = {"last": None, "n": 0}

        def told() -> pa.RecordBatch:
            kept = [*found.values()]
            columns = [pa.array([*found], pa.string()), pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.string())]
            found.clear()
            return pa.record_batch(columns, ["word", "n_near", "best_n", "best"])

        def add(word: str, n: int, near: str) -> None:
            have = found.get(word)
            if have is None:
                found[word] = [1, n, near]
            else:
                have[0] += 1
                if n > have[1] or (n == have[1] and near < have[2]):
                    have[1:] = n, near

        def tiles() -> Iterator[tuple[Tile, np.ndarray]]:
            """Stretches of rows in order; rows of one group and pair of parts have one number."""
            for b in batches:
                for a in range(0, b.num_rows, rows):
                    c = dict(zip(b.schema.names, (x.to_pylist() for x in b.slice(a, rows).columns)))
                    groups = []
                    for key in zip(c["m"], c["front"], c["half"], c["i"], c["j"]):
                        if key != numbers["last"]:
                            numbers["last"], numbers["n"] = key, numbers["n"] + 1
                        groups.append(numbers["n"])
                    parts = [p if i != j else -1 for p, i, j in zip(c["part"], c["i"], c["j"])]
                    t = Tile(c["word"], np.array(groups), np.array(c["m"], np.int16), np.array(c["front"], bool), np.array(parts))
                    yield t, np.array(c["n"], np.int64)

        open_: list[tuple[Tile, np.ndarray]] = []  # tiles that end in the group with which this one begins: one group's, ``tile`` rows of each part
        for t, n in tiles():
            open_ = [(o, m) for o, m in open_ if o.groups[-1] == t.groups[0]]
            for o, m in [*open_, (t, n)]:
                for x, y in zip(*(at.tolist() for at in o.near(t))):
                    add(o.words[x], int(n[y]), t.words[y])
                    add(t.words[y], int(m[x]), o.words[x])
            open_.append((t, n))
            if len(found) > 200_000:
                yield told()
        yield told()

    pairs = ordered.mapInArrow(compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def spelling_variants(words: DataFrame, ratio: int = 5, tile: int = 2048) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for all ``words``, which hold (word, n) with distinct words.

    A word's form is its near word of largest n, ties to the smallest in code-point order, if that n is at least
    ``ratio`` (over 1) times the word's own; else null. The root is found by following forms to the last: n grows on
    the way, so that there are no cycles. Words without a near word have n_near 0. An empty table gives an empty
    result; null words are left out.
    """
    words = durable(words.where("word is not null").select("word", "n"), "words")
    found = durable(near_words(words, tile), "near")
    joined = words.join(found, "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    joined = durable(joined.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    roots = durable(joined.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each step doubles how far roots have come; n grows by the ratio, so ways are short
        step = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("on")), "root", "left")
        step = durable(step.select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
