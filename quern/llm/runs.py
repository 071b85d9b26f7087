"""Periodic runs of words: stretches that repeat a shorter piece several times.

The suffixes of a text's words are sorted by prefix doubling, and classes of suffixes are united by decreasing length of
the common prefix (LCP) of neighbours, as Kruskal's algorithm unites trees. Each class keeps its positions in order. When
two positions p < q of a class become neighbours in that order while the LCP is n, the n words from p on and from q on are
the same; if q - p is at most n, they overlap or touch, and the words from p to q + n have the period q - p. That seeds
a run. Every run is seeded from its first word: that position and the one a period on meet as neighbours, since a
position between them would give the run a smaller period. So a seed that no word before it extends is a run, and its
length and smallest period are exact without a further search.

A run of ``least`` words or more and ``times`` periods or more has two equal stretches of a certain size (16 words for 24
and 3), so uniting ends there, and texts in which no such stretch comes twice are passed by after a look at rolling hashes.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Run = tuple[int, int, int]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, in order."""
    return (text or "").encode("utf-8", "replace").split()


def shortest_repeat(least: int, times: int) -> int:
    """The number of words that stand twice in any run of at least ``least`` words and ``times`` periods."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def repeating(hashes: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """For texts of ``sizes`` words each, whether some ``width`` words may stand twice; no text that has them is missed."""
    n, found = len(hashes), np.zeros(len(sizes), bool)
    if n < width + 1:
        return found
    with np.errstate(over="ignore"):
        sums, span = hashes.astype(np.uint64), 1
        while span * 2 <= width:
            sums, span = sums[: len(sums) - span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + sums[span:], span * 2
        last = width - span
        sums = sums[: n - width + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + sums[last : last + n - width + 1]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        whole = owner[: n - width + 1] == owner[width - 1 :]  # not over the end of a text
        owner = owner[: n - width + 1][whole]
        keys = sums[whole] * np.uint64(0xD6E8FEB86659FD93) + owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    order = np.argsort(keys)
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    found[owner[order[same]]] = True
    return found


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes of a row of numbers, and the LCP of each with the next."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
    levels, span = [rank], 1
    while span < n and int(rank.max()) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:].astype(np.int64) + 1
        rank = np.unique(rank.astype(np.int64) * (n + 1) + after, return_inverse=True)[1].astype(np.int32)
        levels.append(rank)
        span *= 2
    order = np.argsort(rank, kind="stable")
    left, right, size = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(left, right) < n)
        # Equal ranks mean equal words: of two windows at least one would have the end of the text elsewhere.
        same = inside[levels[k][left[inside]] == levels[k][right[inside]]]
        for at in (left, right, size):
            at[same] += 1 << k
    return order, size


def seeds(order: np.ndarray, lcps: np.ndarray, lowest: int) -> Iterator[tuple[int, int, int]]:
    """(p, q, LCP) of positions that become neighbours in their class at a distance of at most the LCP."""
    links = np.flatnonzero(lcps >= lowest)
    links = links[np.argsort(-lcps[links], kind="stable")]
    above: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def root(x: int) -> int:
        top = x
        while above.get(top, top) != top:
            top = above[top]
        while above.get(x, x) != top:
            above[x], x = top, above[x]
        return top

    for p, q, n in zip(order[links].tolist(), order[links + 1].tolist(), lcps[links].tolist()):
        a, b = root(p), root(q)
        big, small = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        above[b] = a
        last = len(small) - 1
        for j, x in enumerate(small):
            i = bisect_left(big, x)
            # Neighbours in the united order are those with no other of the smaller class between.
            if i and x - big[i - 1] <= n and (not j or small[j - 1] < big[i - 1]):
                yield big[i - 1], x, n
            if i < len(big) and big[i] - x <= n and (j == last or small[j + 1] > big[i]):
                yield x, big[i], n
        if len(small) * 8 < len(big):
            for x in small:
                insort(big, x)
        else:
            big = sorted(big + small)
        members[a] = big


def runs_of(words: list[bytes], least: int = 24, times: int = 3) -> list[Run]:
    """All runs of a row of words as (start, length, period), by start and period."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    lowest = shortest_repeat(least, times)
    if len(ids) <= lowest:
        return []
    found = []
    for p, q, n in seeds(*suffixes(ids), lowest):
        period, size = q - p, q - p + n
        if size >= least and size >= times * period and (not p or words[p - 1] != words[q - 1]):
            found.append((p, size, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        edges[start + period] += 1
        edges[start + size] -= 1
    return [w for w, held in zip(words, np.cumsum(edges).tolist()) if not held]


def all_runs(texts: list[list[bytes]], least: int, times: int, together: int = 500_000) -> list[list[Run]]:
    """The runs of each text; the look at repeats is taken over many texts at once."""
    found: list[list[Run]] = []
    lowest, a = shortest_repeat(least, times), 0
    while a < len(texts):
        z, n = a, 0
        while z < len(texts) and (z == a or n + len(texts[z]) <= together):
            n += len(texts[z])
            z += 1
        part = texts[a:z]
        hashes = np.fromiter((hash(w) for t in part for w in t), np.int64, n).view(np.uint64)
        again = repeating(hashes, np.array([len(t) for t in part], np.int64), lowest)
        found += [runs_of(t, least, times) if r else [] for t, r in zip(part, again.tolist())]
        a = z
    return found


def periodic_runs(df: DataFrame, text_col: str = "text", least: int = 24, times: int = 3, out: str = "periodic") -> DataFrame:
    """``df`` with ``out``: the number of words, all runs (start, length, smallest period; by start and period) and the collapsed text.

    Words stand between ASCII blanks and are numbered from 0. A run is a stretch of at least ``least`` words and
    ``times`` periods that no neighbouring word extends. The collapsed text has the words, joined by a blank,
    without those that a run repeats. Null and empty texts have no words and an empty collapsed text. Whole
    texts of any length are read, each by itself, so repeated rows have the same result and an empty table an empty
    one. Other columns pass through whatever their names; one named ``out`` is replaced. Nothing is shuffled.
    """

    @F.pandas_udf("struct<n:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        words = [words_of(t if isinstance(t, str) else None) for t in texts]
        runs = all_runs(words, least, times)
        rest = [b" ".join(collapsed(w, r) if r else w).decode() for w, r in zip(words, runs)]
        return pd.DataFrame({"n": [len(w) for w in words], "runs": pd.Series(runs, dtype=object), "collapsed": rest})

    others = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    return df.select(*others, scan(F.col(f"`{text_col}`")).alias(out))
