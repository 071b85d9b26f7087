"""Periodic runs, spelling variants and line dedup against brute force, and on odd rows."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import lines, runs, spelling


def brute_runs(words, least, times):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - a + q >= max(least, times * q):
                found[a, i - a + q] = min(q, found.get((a, i - a + q), q))
    covered = lambda a, z, q: any(p < q and b <= a and b + y >= a + z for (b, y), p in found.items())
    return sorted(((a, z, q) for (a, z), q in found.items() if not covered(a, z, q)), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (9, 3), (5, 4)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(300):
        kind = rng.randrange(3)
        words = [bytes([97 + rng.randrange(1 + rng.randrange(3))]) for _ in range(rng.randrange(90))]
        if kind:
            piece = words[: 1 + rng.randrange(12)] or [b"x"]
            words = words[: rng.randrange(1 + len(words))] + piece * rng.randrange(9) + piece[: rng.randrange(1 + len(piece))] + words[::-1][: rng.randrange(30)]
        assert runs.runs_of(words, least, times) == brute_runs(words, least, times), words
        assert runs.all_runs([words, [], words], least, times) == [runs.runs_of(words, least, times), [], runs.runs_of(words, least, times)]


def test_shortest_repeat_is_a_bound():
    assert runs.shortest_repeat(24, 3) == 16
    for least, times in ((24, 3), (10, 2), (7, 5)):
        assert runs.shortest_repeat(least, times) == min(max(least, times * q) - q for q in range(1, 200))


def test_repeats_are_looked_for_within_texts_only():
    texts = [np.arange(40), np.arange(40), np.array([*range(20), *range(20)]), np.zeros(3)]
    got = runs.repeating(np.concatenate(texts).astype(np.uint64), np.array([len(t) for t in texts]), 16)
    assert got.tolist() == [False, False, True, False]


def test_periodic_runs_on_odd_rows(spark):
    long = "w " * 200_000
    rows = [(None, None, 1), (1, "", 2), (1, " \n ", 3), (2, "a b c " * 9, 4), (2, "a b c " * 9, 4), (3, long, 5), (4, "x\x0by\x1cz  é", 6)]
    df = spark.createDataFrame(rows, "doc_id int, text string, periodic int").withColumnsRenamed({"periodic": "runs"}).withColumn("n", F.lit(7))
    got = sorted(runs.periodic_runs(df).collect(), key=lambda r: r.runs)
    assert got[0].asDict()["doc_id"] is None and all(r.n == 7 for r in got)
    assert [(r.periodic.n, [tuple(x) for x in r.periodic.runs], r.periodic.collapsed) for r in got] == [
        (0, [], ""), (0, [], ""), (0, [], ""), (27, [(0, 27, 3)], "a b c"), (27, [(0, 27, 3)], "a b c"), (200_000, [(0, 200_000, 1)], "w"), (3, [], "x y\x1cz  é")]
    assert runs.periodic_runs(df.withColumn("periodic", F.lit("mine"))).first().periodic.n is not None
    assert runs.periodic_runs(df.where("false")).count() == 0


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(words, ratio):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("tile,ratio", [(2048, 5), (7, 2)])
def test_variants_equal_brute_force(spark, tile, ratio):
    rng = random.Random(tile)
    words = {}
    for _ in range(500):
        base = rng.choice(["aaaaaa", "interval", "straße", "mamama", "aaabbb"])
        w = list(base)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = rng.choice("abéß")
        words["".join(w)] = rng.choice([1, 2, 5, 25, 125, 125, 700])
    df = spark.createDataFrame([*words.items()], "word string, n long")
    got = spelling.spelling_variants(df, ratio=ratio, tile=tile)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute_variants(words, ratio)


def test_variants_of_no_words_and_null_words(spark):
    df = spark.createDataFrame([(None, 3), ("a", 1), ("b", 5), ("ab", 25)], "word string, n long")
    assert sorted(map(tuple, spelling.spelling_variants(df).collect())) == [("a", "ab", "ab", 1, 2, 25), ("ab", None, "ab", 25, 2, None), ("b", "ab", "ab", 5, 2, 25)]
    assert spelling.spelling_variants(df.where("false")).count() == 0


def test_word_counts_over_texts(spark):
    rows = [(1, "Straße STRASSE straße×x kurz"), (1, "Straße"), (2, None), (None, ""), (3, "abcdefg " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("word", F.lit("mine"))
    got = {r.word: r.n for r in spelling.word_counts(df, held=2).collect()}
    assert got == {"straße": 2, "strasse": 1, "straße×x": 1, "abcdefg": 50_000}
    edit = lambda i, ws: [w[1:] if i == 3 else w for w in ws]
    assert {r.word: r.n for r in spelling.word_counts(df, edit=edit).collect()}["bcdefg"] == 50_000
    assert spelling.word_counts(df.where("false")).count() == 0


def brute_lines(rows, least):
    blanks = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[x.strip(blanks).translate(low)].add(i)
    order = lambda i: (i is None, i or 0)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        keys = [x.strip(blanks).translate(low) for x in parts]
        stay = [len(k) < least or len(held[k]) < 2 or min(held[k], key=order) == i for k in keys]
        out.append((i, "\n".join(x for x, s in zip(parts, stay) if s) if t is not None else None, len(parts), len(parts) - sum(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("filter_mb", [64, 0])
def test_line_dedup_equals_brute_force(spark, filter_mb):
    """With hardly any filter nearly every line is suspected, and the result is the same."""
    rng = random.Random(5)
    pool = ["Shared line number one", " shared LINE number one\t", "short", "ÄÖÜ shared äöü", " not a blank ", "", "x" * 9, "é" * 10, "Y" * 10] + [f"line of its own {i}" for i in range(40)]
    rows = [(i if i % 7 else None, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9))) if i % 11 else None) for i in range(120)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (200, "\n"), (201, ""), (202, "long shared line " * 20_000), (203, "long shared line " * 20_000 + "\nend of it, alone")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"doc": F.lit("mine"), "seen": F.lit(1), "gone": F.lit(2), "Lines": F.lit(3), "suspected": F.lit(4)})
    got = lines.dedup_lines(df.drop("Lines"), filter_mb=filter_mb)
    assert got.columns == ["doc_id", "text", "doc", "seen", "gone", "suspected", "lines"]
    found = got.collect()
    assert all((r.doc, r.seen, r.gone, r.suspected) == ("mine", 1, 2, 4) for r in found)
    assert sorted([(r.doc_id, r.lines.text, r.lines.n_lines, r.lines.n_dropped) for r in found], key=str) == brute_lines(rows, 10)
    assert "Lines" not in lines.dedup_lines(df, filter_mb=filter_mb).columns
    assert lines.dedup_lines(df.where("false")).count() == 0


def test_filters_miss_no_repeat_and_fold():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    s = lines.Slice(1 << 16)
    s.add(values[:3000])
    s.add(values[2500:])
    for most in (1 << 16, 1 << 12, 64):
        bits = s.folded(most)
        assert len(bits) <= most
        f = lines.Twice(np.array([0]), np.array([len(bits)]), np.packbits(bits, bitorder="little"))
        assert f.holds(values[2500:3000]).all()
    bits = s.folded(1 << 16)
    f = lines.Twice(np.array([0]), np.array([len(bits)]), np.packbits(bits, bitorder="little"))
    assert f.holds(np.concatenate([values[:2500], values[3000:]])).mean() < 0.05
