"""Toxicity by the nearest labelled examples.

Texts become TF-IDF vectors over all words of the labelled examples. A term's weight is
(1 + log count) * idf * sqrt(G + 0.1): the idf is of all documents, and G is the term's
G statistic against the labels of all training rows (supervised term weighting, Debole
and Sebastiani 2003), so that terms which tell the labels apart pull examples nearer; no
term is left out. The examples, toxic and clean, are in an inverted index whose
postings are cut into blocks with their largest weights. A search bounds each block's
cosine, visits blocks from the highest bound down and stops when no bound reaches the
k-th best, so the neighbours are exact. Neighbours vote with weights that fall with the
distance, and the share of votes is calibrated by isotonic regression on the examples,
each searched without itself. The nearest examples are the evidence.

A score depends on the text alone: equal texts have equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import durable, spread
from quern.session import small_batches

#: Of a text in lower case and UTF-8: letters and whatever isn't ASCII make words, all else is a blank.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A text's words in lower case, in order: runs of ASCII letters and of characters beyond ASCII."""
    return (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one stretch after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class BlockMaxIndex:
    """Exact top-k cosine over unit sparse vectors, by postings with block maxima."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = 64) -> None:
        # Examples with the same strongest terms stand together, so that a block's maxima bound it closely.
        order = sorted(range(len(ids)), key=lambda i: (vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:4]].tolist(), ids[i]))
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.labels = np.array([labels[i] for i in order], dtype=np.int64)
        self.n_blocks = -(-len(order) // block)
        terms = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weights = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        places = np.repeat(np.arange(len(order)), np.array([len(vectors[i][0]) for i in order], dtype=np.int64))
        by_term = np.argsort(terms, kind="stable")
        self.places, self.weights, terms = places[by_term], weights[by_term], terms[by_term]
        # A run is what one term has in one block.
        blocks = self.places // block
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])
        at = np.flatnonzero(new)
        self.run_at, self.run_block = np.append(at, len(terms)), blocks[at]
        self.run_most = np.maximum.reduceat(self.weights, at) if len(at) else np.zeros(0)
        self.first = np.searchsorted(terms[at], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int, int]]:
        """The k best (cosine, id, label) of positive cosine, ties to the smaller id."""
        sizes = self.first[terms + 1] - self.first[terms]
        runs, w = _ranges(self.first[terms], sizes), np.repeat(weights, sizes)
        if not len(runs):
            return []
        bounds = np.bincount(self.run_block[runs], w * self.run_most[runs], self.n_blocks)
        order = np.argsort(-bounds, kind="stable")
        best_p, best_s = np.zeros(0, np.int64), np.zeros(0)
        least, at, step = 0.0, 0, 8
        while at < len(order):
            now = order[at : at + step]
            now = now[(bounds[now] > 0) & (bounds[now] >= least - 1e-9)]
            if not len(now):
                break
            wanted = np.zeros(self.n_blocks, bool)
            wanted[now] = True
            inside = wanted[self.run_block[runs]]
            r = runs[inside]
            long = self.run_at[r + 1] - self.run_at[r]
            posts = _ranges(self.run_at[r], long)
            scores = np.round(np.bincount(self.places[posts], np.repeat(w[inside], long) * self.weights[posts], len(self.ids)), 9)
            found = np.flatnonzero(scores > 0) if not least else np.flatnonzero(scores >= least)
            p, s = np.concatenate((best_p, found)), np.concatenate((best_s, scores[found]))
            keep = np.lexsort((self.ids[p], -s))[:k]
            best_p, best_s = p[keep], s[keep]
            if len(keep) == k:
                least = best_s[-1]
            at += step
            step *= 8
        return list(zip(best_s.tolist(), self.ids[best_p].tolist(), self.labels[best_p].tolist()))


@dataclass
class ToxicityModel:
    """What scoring needs; its size is bounded by the words it holds: those of ``max_examples`` texts, ``max_bytes`` in all."""

    number: dict[bytes, int]
    weight: np.ndarray
    index: BlockMaxIndex
    prior: float
    k: int
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))
    no_term: float = 0.0

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.numbered(Counter(words_of(text)))

    def numbered(self, found: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array([self.number.get(w, -1) for w in found], dtype=np.int64)
        order = np.argsort(terms, kind="stable")[(terms < 0).sum() :]
        return terms[order], np.array(list(found.values()), dtype=float)[order]

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[terms]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def vote(self, near: list[tuple[float, int, int]]) -> float:
        """The share of toxic votes; a vote weighs 1 / (0.05 + 1 - cosine), and the prior has one vote of weight 1."""
        weights = [1 / (1.05 - min(1.0, s)) for s, _, _ in near]
        return (self.prior + sum(w for w, n in zip(weights, near) if n[2])) / (1 + sum(weights))

    def calibrated(self, raw: float | None) -> float:
        if raw is None:
            return self.no_term
        return float(np.interp(raw, *self.knots))

    def judge(self, text: str | None, evidence: int = 3) -> tuple[float, list[tuple[float, int, int]]]:
        terms, counts = self.counts(text)
        near = self.index.search(terms, self.vector(terms, counts), self.k)
        return self.calibrated(self.vote(near) if near else None), near[:evidence]


def isotonic(good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (share of votes, rate) from counts in equal bins: adjacent violators are pooled, and a pool's rate stands at its mean bin.

    Between knots the rate is linear, from (0, 0) to (1, 1), so that more votes never score less and mostly score more.
    """
    pools: list[list[float]] = []
    for at, (g, n) in enumerate(zip(good.tolist(), total.tolist())):
        if n:
            pools.append([g, n, n * (at + 0.5) / len(good)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    return np.array([0.0, *(x / n for _, n, x in pools), 1.0]), np.array([0.0, *(g / n for g, n, _ in pools), 1.0])


def g_statistic(n: np.ndarray, n1: np.ndarray, whole: float, toxic: float) -> np.ndarray:
    """The G statistic of terms in ``n`` of ``whole`` rows, ``n1`` of them among the ``toxic`` rows."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    if not 0 < toxic < whole:
        return np.zeros(len(n))
    clean = whole - toxic
    rest = whole - n
    g = part(n1, n * toxic / whole) + part(n - n1, n * clean / whole) + part(toxic - n1, rest * toxic / whole) + part(clean - n + n1, rest * clean / whole)
    return np.maximum(2 * g, 0.0)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5. Null ids aren't held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def _word_counts(texts: pd.Series) -> pd.DataFrame:
    found = [Counter(words_of(t)) for t in texts]
    return pd.DataFrame({"words": [list(c) for c in found], "counts": [list(c.values()) for c in found]})


def _within(counted: DataFrame, max_examples: int, max_bytes: int) -> DataFrame:
    """(__id, __of) of the examples that fit, in the order of their ids' hashes; only ``max_examples`` ids and sizes are ordered."""
    held = F.expr("aggregate(words, 0L, (held, word) -> held + length(word) + 16)")
    sizes = counted.select("__id", "__of", held.alias("bytes")).where(F.col("bytes") <= max_bytes // 64).distinct()
    first = sizes.orderBy(F.xxhash64("__id"), "__id", "__of").limit(max_examples)
    so_far = F.sum("bytes").over(Window.orderBy(F.xxhash64("__id"), "__id", "__of"))
    return first.withColumn("so_far", so_far).where(F.col("so_far") <= max_bytes).select("__id", "__of")


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_examples: int = 2048,
    k: int = 15,
    bins: int = 40,
    max_bytes: int = 128 << 20,
) -> ToxicityModel:
    """Learns from the labelled documents that aren't held out.

    ``max_examples`` labelled rows, chosen by a hash of the id, are the examples: they make the index, its words
    the terms, and the calibration. Their distinct words, each with 16 bytes more, come to ``max_bytes`` in all at
    most, and those of one example to a 64th of that: a labelled text beyond it is no example, and the choice ends where the bytes do.
    So the driver, and each task's copy of the model, hold a bounded size whatever the texts' lengths. Document frequencies cover all of ``docs``, and the terms' association with
    the labels all training rows. Null labels and ids are left out; of several labels of an id the largest
    counts, and of several documents of an id each different text is an example. Null texts count as empty. Without labels
    every score is 0; with labels of one kind it comes from that kind's votes.
    """
    small_batches(docs.sparkSession)
    marked = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__y")).where("__id is not null and __y is not null")
    marked = durable(marked.where(~held_out("__id")).groupBy("__id").agg(F.max("__y").alias("__y")), "labels")
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))

    # Only ids meet the labels here, and only the chosen ones meet the texts: max_examples rows.
    chosen = texts.select("__id").join(marked, "__id").orderBy(F.xxhash64("__id"), "__id").limit(max_examples)
    chosen = durable(chosen.distinct(), "chosen")
    count_words = F.pandas_udf(_word_counts, "struct<words:array<binary>,counts:array<int>>")
    counted = texts.join(F.broadcast(chosen), "__id").select("__id", "__y", count_words("__text").alias("found")).select("__id", "__y", "found.*")
    counted = durable(counted.withColumn("__of", F.xxhash64("words", "counts")), "labelled-words")
    sample = durable(counted.join(F.broadcast(_within(counted, max_examples, max_bytes)), ["__id", "__of"]).dropDuplicates(["__id", "__of"]), "examples")

    rows = sample.orderBy("__id", "__of").toArrow()  # max_examples texts' words, max_bytes in all
    words = rows["words"].combine_chunks()
    number = {w: i for i, w in enumerate(sorted(words.flatten().unique().to_pylist()))}
    model = ToxicityModel(number, np.ones(len(number)), BlockMaxIndex([], [], [], len(number)), 0.0, k)

    numbers = docs.sparkSession.sparkContext.broadcast(number)  # the examples' words, max_bytes in all

    @F.pandas_udf("array<int>")
    def term_numbers(rows: pd.Series) -> pd.Series:
        known = numbers.value
        return pd.Series([[known[w] for w in set(words_of(t)) if w in known] for t in rows], dtype=object)

    vectors = durable(spread(texts).select("__id", term_numbers("__text").alias("terms")), "terms")
    n_docs = vectors.count()
    df = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row for each term
    known = vectors.join(marked, "__id")
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("__y")).first()
    seen = known.select("__y", F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("n1")).toArrow()  # a row for each term
    in_docs, in_marked, in_toxic = (np.zeros(len(number)) for _ in range(3))
    in_docs[df["t"].to_numpy()] = df["n"].to_numpy()
    in_marked[seen["t"].to_numpy()], in_toxic[seen["t"].to_numpy()] = seen["n"].to_numpy(), seen["n1"].to_numpy()
    model.prior = (toxic or 0) / n if n else 0.0
    model.weight = (np.log((1 + n_docs) / (1 + in_docs)) + 1) * np.sqrt(g_statistic(in_marked, in_toxic, float(n), float(toxic or 0)) + 0.1)

    pairs = [model.numbered(dict(zip(w.as_py(), c.as_py()))) for w, c in zip(rows["words"], rows["counts"])]
    model.index = BlockMaxIndex(rows["__id"].to_pylist(), rows["__y"].to_pylist(), [(t, model.vector(t, c)) for t, c in pairs], len(number))
    del rows, words, pairs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def without_itself(ids: pd.Series, words: pd.Series, counts: pd.Series) -> pd.Series:
        m, out = shared.value, []
        for i, w, n in zip(ids, words, counts):
            t, c = m.numbered(dict(zip(w, n)))
            near = m.index.search(t, m.vector(t, c), k + 1)
            near = [x for x in near if x[1] != i][:k]
            out.append(m.vote(near) if near else None)
        return pd.Series(out, dtype="float64")

    raw = sample.repartition(32).select("__y", F.nanvl(without_itself("__id", "words", "counts"), F.lit(None)).alias("raw"))
    binned = raw.groupBy(F.when(F.col("raw").isNotNull(), F.least(F.floor(F.col("raw") * bins), F.lit(bins - 1))).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("n1")).collect()  # bins + 1 rows
    good, total = np.full(bins, 0.0), np.full(bins, 0.0)
    model.no_term = model.prior
    for r in binned:
        if r["bin"] is None:
            model.no_term = r["n1"] / r["n"]
        else:
            good[r["bin"]], total[r["bin"]] = r["n1"], r["n"]
    centre = (np.arange(bins) + 0.5) / bins  # each bin also counts one example at its own rate, so that bins without examples have one
    model.knots = isotonic(good + centre, total + 1)
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``df`` with the struct ``out``: score (0 to 1) and evidence, the three nearest examples (cosine, id, label).

    Texts that share no word with an example, null and empty ones among them, have the share of toxic labels
    among such examples (all examples, if there are none) as their score, and no evidence. Rows stay as they
    are, repeated ones too; whole texts of any length count. A column named ``out`` is replaced. An empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by max_bytes

    @F.pandas_udf("struct<score:double,evidence:array<struct<cosine:double,id:long,label:int>>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        held = 0
        for texts in batches:
            found = []
            for t in texts:
                t = t if isinstance(t, str) else ""
                if t not in cache:
                    if len(cache) >= 2_000 or held + len(t) > 4 << 20:
                        cache.clear()
                        held = 0
                    cache[t] = shared.value.judge(t)
                    held += len(t)
                found.append(cache[t])
            yield pd.DataFrame({"score": [s for s, _ in found], "evidence": [[dict(cosine=c, id=i, label=y) for c, i, y in e] for _, e in found]})

    return spread(df).withColumn(out, judge(F.col(f"`{text_col}`")))
