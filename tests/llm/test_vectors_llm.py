"""ANN and embedding near-dedup against brute force, and their odd rows."""

import numpy as np
import pytest

from quern.llm import ann, embedding_dedup, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string, id int"


def brute_links(rows, cosine):
    ids = [r[0] for r in rows]
    links = {i: set() for i in ids}
    for a in rows:
        for b in rows:
            if a[0] is None or b[0] is None or a[0] >= b[0] or a[2] is None or a[2] != b[2] or not ok(a[1]) or not ok(b[1]) or len(a[1]) != len(b[1]):
                continue
            x, y = (np.array(np.float32(v), dtype=np.float64) for v in (a[1], b[1]))
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a[0]].add(b[0])
                links[b[0]].add(a[0])
    return links


def ok(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def component(links, i):
    seen, todo = {i}, [i]
    while todo:
        for j in links[todo.pop()] - seen:
            seen.add(j)
            todo.append(j)
    return min(seen)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for i in range(300):
        base = rng.standard_normal(16) if i % 3 == 0 or not out else np.array(out[-1][1]) + rng.standard_normal(16) * 0.25
        out.append((i, [float(np.float32(x)) for x in base], int(rng.integers(0, 3)) if i % 50 else None, "x", i % 7))
    out += [(400 + k, out[5][1], out[5][2], "copy", 0) for k in range(40)]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    return out + [(500 + k, v, 1, None, None) for k, v in enumerate(odd)]


@pytest.mark.parametrize("limit", [4096, 64])
def test_links_and_components(spark, rows, limit):
    got = embedding_dedup.embedding_near_dups(spark.createDataFrame(rows, SCHEMA), cosine=0.9, limit=limit).collect()
    links = brute_links(rows, 0.9)
    assert sum(map(len, links.values())) > 1000
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (len(s), component(links, i), component(links, i) == i) for i, s in links.items()}


def test_links_of_long_chains_in_one_label(spark):
    rng = np.random.default_rng(4)
    chains = []
    for _ in range(150):
        x = rng.standard_normal(8)
        for _ in range(20):
            chains.append(x := x / np.linalg.norm(x) + rng.standard_normal(8) * 0.1)
    x = np.array(chains, dtype=np.float32)[rng.permutation(len(chains))]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_near_dups(df, cosine=0.95).collect()}
    y = x.astype(np.float64)
    near = (y @ y.T) / np.sqrt(np.outer((y * y).sum(axis=1), (y * y).sum(axis=1))) >= 0.95
    np.fill_diagonal(near, False)
    links = {i: set(np.flatnonzero(near[i]).tolist()) for i in range(len(x))}
    assert got == {i: (len(s), component(links, i)) for i, s in links.items()}
    assert len({c for _, c in got.values()}) > 20


def test_joined_roots_keep_earlier_links():
    root = np.arange(800)
    batches = [[(5, 300), (5, 700), (3, 301), (3, 302), (1, 303), (2, 600)], [(300, 301), (302, 303)], [(600, 700)]]
    for batch in batches:
        p, q = np.array(batch).T
        root = embedding_dedup.joined_roots(root, p, q)
    assert {root[i] for i in (1, 2, 3, 5, 300, 301, 302, 303, 600, 700)} == {1}


def test_links_of_empty_and_null_ids(spark):
    assert embedding_dedup.embedding_near_dups(spark.createDataFrame([], SCHEMA)).count() == 0
    got = embedding_dedup.embedding_near_dups(spark.createDataFrame([(None, [1.0, 0.0], 1, "", 0), (7, [1.0, 0.0], 1, "", 0)], SCHEMA)).collect()
    assert sorted((r.vec_id or -1, r.n_links) for r in got) == [(-1, 0), (7, 0)]


@pytest.mark.parametrize("options", [{}, {"hashes": 2, "tables": 24, "probes": 1500, "block": 16, "slot_rows": 500}])
def test_neighbours_recall_and_order(spark, rows, options):
    rows = rows if not options else rows[::3]  # a longer code has many more buckets
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.nearest_neighbours(df, df.where("vec_id % 10 = 0"), **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    good = [r for r in rows if ok(r[1])]
    hits = total = 0
    for q in [r for r in good if r[0] % 10 == 0]:
        want = sorted((float(np.sqrt(((np.array(r[1]) - np.array(q[1])) ** 2).sum())), r[0]) for r in good if r[0] != q[0] and len(r[1]) == len(q[1]))[:10]
        mine = sorted(got.get(q[0], []))
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        hits += len({m[2] for m in mine} & {w[1] for w in want})
        total += len(want)
    assert hits / total >= 0.9


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(i * 10, [float(i + 1), 1.0], 0, "", 0) for i in range(4)], SCHEMA)
    got = ann.nearest_neighbours(df, df)
    assert got.count() == 12 and {r.rank for r in got.collect()} == {1, 2, 3}
    assert ann.nearest_neighbours(df.where("false"), df).count() == 0
    assert ann.nearest_neighbours(df, df.where("false")).count() == 0


def test_an_index_of_two_hashes_selects(spark):
    x = np.random.default_rng(2).standard_normal((50_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest_neighbours(df, df.where("vec_id % 500 = 0")).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    y, asked = x.astype(np.float64), sorted(got)
    assert asked == list(range(0, 50_000, 500))
    hits = 0
    for q in asked:
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.argsort(d, kind="stable")[:10]
        hits += len(set(best.tolist()) & set(got[q]))
        assert all(got[q][i] == d[i] for i in got[q])
    assert hits / (10 * len(asked)) >= 0.9  # 0.917 over the 51,282 vectors of the check table


def test_codes_follow_the_rows_in_small_steps():
    for axes in (2, 4, 32, 128):
        before = 0
        for rows in np.geomspace(1, 1e8, 400):
            whole, last = ann.code_shape(rows, axes)
            codes = axes**whole * (2 * last if last else 1)
            assert codes >= before and codes <= max(2, rows * 1.000001) < 2.1 * codes + 2 and 2 * last <= axes
            before = codes


@pytest.mark.parametrize("shape", [(0, 3), (1, 0), (1, 5), (2, 0), (2, 3)])
@pytest.mark.parametrize("probes", [1, 7, 60, 5000])
def test_probes_are_the_buckets_of_least_loss(shape, probes):
    whole, last = shape
    x = vectors.unit(np.random.default_rng(8).standard_normal((3, 8)))
    diagonals = vectors.signs(8, 4 * (whole + (last > 0)), 5).reshape(4, whole + (last > 0), 3, -1)
    values = [ann.hash_axes(x, d, last) for d in diagonals]
    for n in range(len(x)):
        every = []
        for t, table in enumerate(values):
            sums = {0: 0.0}
            for v in table:
                sums = {c * v.shape[1] + a: s + (v[n].max() - v[n][a]) ** 2 for c, s in sums.items() for a in range(v.shape[1])}
            every += [(s, t, c) for c, s in sums.items()]
        got = list(zip(*(z.tolist() for z in ann.pooled_probes([[v[n] for v in t] for t in values], probes))))
        assert got == [(t, c) for _, t, c in sorted(every)[:probes]]


def test_repeated_rows_of_vectors(spark):
    df = spark.createDataFrame([(i % 4, [float(i % 4 + 1), 1.0], 0, "", 0) for i in range(12)] + [(1, [9.0, 9.0], 0, "", 0)], SCHEMA)
    got = ann.nearest_neighbours(df, df)
    assert got.count() == 12 and got.groupBy("query_id").count().where("count <> 3").count() == 0
    same = spark.createDataFrame([(7, [1.0, 0.0], 1, "", 0)] * 3, SCHEMA)
    assert [(r.n_links, r.component_id) for r in embedding_dedup.embedding_near_dups(same).collect()] == [(2, 7)] * 3


def test_rotation_keeps_distances():
    x = np.random.default_rng(0).standard_normal((5, 11))
    y = vectors.rotate(x, vectors.signs(11, 1, 0)[0])
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
