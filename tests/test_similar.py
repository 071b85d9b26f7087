"""Near-duplicates against all pairs, with hot bands; reachability and components against plain walks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import graph, similar


def groups_of(links, nodes):
    above = {n: n for n in nodes}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def texts(rng):
    """Copies, near copies, a long passage that many share (similarity of about 0.6 and 0.75), odd texts."""
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(150)]
    out = []
    for i in range(60):
        out.append(passage + [word() for _ in range(rng.choice([25, 40, 60]))])
    for base in rng.sample(out, 25):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            copy[rng.randrange(len(copy))] = word()
        out.append(copy)
    for i in range(40):
        base = [word() for _ in range(rng.choice([3, 5, 12, 80]))]
        out += [base, base[: rng.randrange(1, len(base) + 1)], [*base, word()]]
    return [" ".join(t) for t in out] + ["", " \n", None, "One two", "one  TWO", "z " * 30_000, "z " * 29_999 + "y"]


@pytest.mark.parametrize("small,part_rows", [(32, 512), (3, 7)])
def test_near_duplicates_equal_all_pairs(spark, small, part_rows):
    rows = list(enumerate(texts(random.Random(1)), 1))
    rows += [(None, rows[0][1]), (9000, rows[5][1]), (9000, rows[5][1])]
    sets = [set(similar.shingle_set(t, 5).tolist()) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = groups_of(links, range(len(rows)))
    ids = [i for i, _ in rows]
    least = lambda chosen: min((x for x in chosen if x is not None), default=None)
    want = [(ids[k], least(ids[j] for j in range(len(rows)) if sets[j] == sets[k]), least(ids[j] for j in range(len(rows)) if group[j] == group[k])) for k in range(len(rows))]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"key": F.lit("mine"), "id": F.lit(0)})
    got = similar.near_duplicates(df, small=small, part_rows=part_rows)
    assert got.columns == ["doc_id", "same_as", "component"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert len(links) > 50 and similar.near_duplicates(df.where("false")).count() == 0


def test_sets_are_made_of_compared_texts_only(spark, tmp_path, monkeypatch):
    """Each text is sketched once; a second time only those in a candidate pair."""
    seen, made = str(tmp_path / "seen"), similar.shingle_set

    def noted(text, words):
        with open(seen, "a") as f:
            f.write("x\n")
        return made(text, words)

    monkeypatch.setattr(similar, "shingle_set", noted)
    rng = random.Random(3)
    rows = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(200)]
    rows += [rows[0] + " more", rows[1]]
    got = similar.near_duplicates(spark.createDataFrame(list(enumerate(rows, 1)), "doc_id int, text string"))
    assert {r.doc_id: r.component for r in got.collect() if r.doc_id != r.component} == {201: 1, 202: 2}
    assert len(open(seen).readlines()) == len(rows) + 2


def test_signatures_of_parts():
    """A union's signature is the least of its parts', whatever blocks of shingles and permutations it is made in."""
    shingles = np.unique(np.random.default_rng(4).integers(0, 2**64, 5000, np.uint64))
    for n in (1, 31, 128, 200):
        want = np.minimum(similar.signature(shingles[::2], n), similar.signature(shingles[1::2], n))
        assert (similar.signature(shingles, n) == want).all() and (similar.signature(shingles, 200)[:n] == want).all()
    assert similar.signature(shingles[:1], 3).dtype == np.uint32


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.8, 0.95):
        both = rng.integers(0, 2**63, int(4000 * share)).astype(np.uint64)
        rest = [rng.integers(0, 2**63, (4000 - len(both)) // 2).astype(np.uint64) for _ in range(2)]
        a, b = (similar.signature(np.unique(np.concatenate([both, r])), 512) for r in rest)
        assert abs((a == b).mean() - share) < 0.09


def test_reachable_and_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(110)] + [(i, i + 1) for i in range(200, 240)] + [(7, 7), (None, 3), (3, None)] + [(500, i) for i in range(300, 400)]
    edges = spark.createDataFrame(pairs, "src int, dst int")
    ways = {}
    for a, b in pairs:
        if a is not None and b is not None:
            ways.setdefault(a, set()).add(b)
    want = []
    for s in (0, 7, 200, 500, 999):
        depth, edge = {s: 0}, [s]
        while edge:
            edge = sorted({y for x in edge for y in ways.get(x, ()) if y not in depth})
            depth |= {y: max(depth.values()) + 1 for y in edge}
        want += [(s, n, k) for n, k in depth.items()]
    starts = spark.createDataFrame([(0,), (7,), (7,), (200,), (500,), (999,), (None,)], "start int")
    assert sorted(map(tuple, graph.reachable(edges, starts).collect())) == sorted(want)
    links = edges.where("src is not null and dst is not null").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    plain = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    want = groups_of(plain, {x for p in plain for x in p})
    assert {r.node: r.component for r in graph.components(links).collect()} == want
    assert graph.components(links.where("false")).count() == 0 and graph.reachable(edges.where("false"), starts).count() == 5
