"""Near-dedup, sharding, mixing, components and the pipeline against brute force, and their odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quern.llm import common, hilbert, mixing, queries, secrets, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, key string, shard int, times int, row_hash int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", 2, 3, 4) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    some = docs(spark, [None, "", " ", "one", "one two", "é " * 9000, "x" * 50_000])
    same = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, None)] * 2 + [(99, "twice", "en", "s", 5, 1, "k", 2, 3, 4)] * 3, SCHEMA)
    return some.unionByName(same)


def brute_components(ids, linked):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(200, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute_components({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("limit", [256, 3])
def test_fingerprint_components(spark, limit):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(4)):
            x ^= 1 << b
        fps.append(x)
    rows = [(i, simhash._signed(x)) for i, x in enumerate(fps)] + [(None, 0), (None, 0)]
    got = {r.id: r.component for r in simhash.simhash_components(spark.createDataFrame(rows, "id long, fp long"), "id", limit).collect()}
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert {k: v for k, v in got.items() if k is not None} == brute_components(range(len(fps)), linked)


def test_fingerprint_bits():
    text = "The cat SAT on\tthe mat\n" * 3
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    assert simhash.fingerprint(text, 3) & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("", 3) == simhash.fingerprint(None, 3) == simhash.fingerprint(" \n", 3) == 0


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(100, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join([word() for _ in range(150)] + passage))
    big = [word() for _ in range(200)]
    for i in range(60):
        copy = list(big)
        copy[i * 3] = word()
        texts.append(" ".join(copy))
    texts += [texts[0], "", None]
    got = {r.doc_id for r in simhash.simhash_dedup(docs(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1) >= 0.8]
    assert got == set(brute_components(range(len(texts)), linked).values())


def test_near_copies_among_texts_with_a_shared_passage(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(400)]
    texts = []
    for i in range(310):
        own = [word() for _ in range(70)]
        texts.append(" ".join(passage + own))
        if i % 3 == 0:
            texts.append(" ".join(passage + own[:33] + [word() for _ in range(37)]))
    got = {r.doc_id for r in simhash.simhash_dedup(docs(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert len(linked) == 104
    assert got == set(brute_components(range(len(texts)), linked).values())


@pytest.mark.parametrize(("small", "rows"), [(32, 512), (2, 7), (2, 512)])
def test_prefix_links_are_all_links(spark, small, rows):
    rng = random.Random(1)
    sets = [sorted({k, *range(100, 100 + 9 * k)}) for k in range(1, 40)]
    sets += [sorted({*rng.sample(range(60), 40), *rng.sample(range(1000, 1400), 3)}) for _ in range(60)] + [[0], [0]]
    keys = [f"k{i:03}" for i in range(len(sets))]
    shared = spark.createDataFrame([(0, 7, k, 999) for k in keys], "band int, sample long, key string, n long")
    frame = spark.createDataFrame(list(zip(keys, sets)), "key string, set array<long>")
    linked = [(keys[i], keys[j]) for i in range(len(sets)) for j in range(i) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.8]
    for known in ([], linked[::2]):
        nodes = spark.createDataFrame([(k, c) for k, c in brute_components(keys, known).items()], "key string, component string")
        found = [(r.u, r.v) for r in simhash._prefix_links(shared, nodes, frame, 0.8, small=small, part_rows=rows).collect()]
        assert brute_components(keys, found + known) == brute_components(keys, linked)


def test_dedup_odd_rows(spark, odd):
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 6, 99]
    assert simhash.simhash_dedup(odd.where("false")).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = hilbert.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards_law(spark, odd):
    texts = [f"text {i % 37} " * (i % 11) for i in range(500)]
    for df, n in ((docs(spark, texts), 24), (odd, 24), (odd, 5)):
        rows = hilbert.hilbert_shards(df, n_shards=n).collect()
        assert len(rows) == df.count()
        held = collections.defaultdict(list)
        for r in rows:
            held[r.shard].append(r.slot)
        sizes = [len(held[s]) for s in range(n)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in held.values())
    by_id = {r.doc_id: r for r in hilbert.hilbert_shards(docs(spark, texts)).collect()}
    assert all((by_id[i].text_crc32, by_id[i].size) == (zlib.crc32(t.encode()), len(t.encode()) + 8) for i, t in enumerate(texts))
    assert hilbert.hilbert_shards(odd.where("false")).count() == 0


def test_shards_are_written_in_order(spark, odd, tmp_path):
    df = docs(spark, [f"text {i}" for i in range(60)])
    hilbert.write_shards(df, f"file://{tmp_path}/out", dims=["size"], n_shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.groupBy("shard").count().count() == 4
    assert sum(r.n_rows for r in hilbert.shard_ranges(back, ["n_chars"]).collect()) == 60
    hilbert.write_shards(odd, f"file://{tmp_path}/odd", n_shards=3)  # null and repeated ids are rows like others
    back = spark.read.parquet(f"file://{tmp_path}/odd")
    plain = [c for c in odd.columns if c != "shard"]
    assert collections.Counter(map(tuple, back.select(plain).collect())) == collections.Counter(map(tuple, odd.select(plain).collect()))


def test_shards_prune_on_every_dimension(spark):
    rng = random.Random(3)
    rows = [(i, "t", "en", f"https://example.org/{rng.randrange(64):02}", rng.randrange(10_000), 1, "k", 2, 3, 4) for i in range(2_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    placed = hilbert.hilbert_shards(df, dims=["source", "n_chars"], n_shards=16, keep=["source", "n_chars"])
    ranges = hilbert.shard_ranges(placed.select("shard", "row.*"), ["source", "n_chars"]).collect()
    assert sum(r.n_rows for r in ranges) == 2_000
    assert np.mean([int(r.max_source[-2:]) - int(r.min_source[-2:]) for r in ranges]) < 0.4 * 64
    assert np.mean([r.max_n_chars - r.min_n_chars for r in ranges]) < 0.4 * 10_000


def test_exponent_meets_its_target():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    x = mixing.solve_exponent(shares, target_entropy=0.9)
    assert abs(mixing.entropy(mixing.temperature_weights(shares, x)) - 0.9) < 1e-9
    x = mixing.solve_exponent(shares, max_repeats=2.0)
    w = mixing.temperature_weights(shares, x)
    ratios = [w[s] / shares[s] for s in shares]
    assert abs(max(ratios) / min(ratios) - 2) < 1e-9
    assert mixing.solve_exponent({"a": 1.0}, max_repeats=2.0) == 0.0


def test_mixture_meets_its_budgets(spark):
    rows = [(i, "w " * (1 + i % 9), "en", "big" if i % 3 else f"s{i % 4}", 0, 1, "k", 2, 3, 4) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(df, max_repeats=2.0, block_tokens=50).collect()
    tokens, taken, seen = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        tokens[r[3]] += 1 + r[0] % 9
    for r in got:
        taken[r.source] += r.tokens
        seen[r.id] += 1
    weights = mixing.temperature_weights({s: t / sum(tokens.values()) for s, t in tokens.items()}, mixing.solve_exponent({s: t / sum(tokens.values()) for s, t in tokens.items()}, max_repeats=2.0))
    total = max(tokens[s] / weights[s] for s in tokens)
    assert all(0 <= taken[s] - max(tokens[s], round(weights[s] * total)) < 9 for s in tokens)
    assert len(seen) == 600 and max(seen.values()) <= 3 and all(0 <= r.position < 1 for r in got)
    whole = mixing.mixed_documents(df, max_repeats=2.0, block_tokens=50)
    assert whole.columns == df.columns and collections.Counter(r.doc_id for r in whole.collect()) == seen


def test_mixture_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same words", "en", "small", 10, 1, "k", 2, 3, 4)] * 7 + [(i, "w", "en", "big", 1, 1, "k", 2, 3, 4) for i in range(10, 50)], SCHEMA)
    want = collections.Counter(r.id for r in mixing.mix_sources(df, max_repeats=1.4, block_tokens=5).collect())
    got = collections.Counter(r.doc_id for r in mixing.mixed_documents(df, max_repeats=1.4, block_tokens=5).collect())
    assert got == want and want[1] % 7 and want[1] > 7
    few = collections.Counter(r.doc_id for r in mixing.mixed_documents(df, max_repeats=1.4, budget=12).collect())
    assert few == collections.Counter(r.id for r in mixing.mix_sources(df, max_repeats=1.4, budget=12).collect())


def chained(*values, seed=42):
    """Spark's xxhash64 of values of any column types, from the library: each value's hash is the next one's seed, nulls leave it."""
    for v in values:
        if isinstance(v, list):
            seed = chained(*v, seed=seed)
        elif v is not None:
            data = v.encode() if isinstance(v, str) else int(v).to_bytes(4 if isinstance(v, bool) else 8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed % 2**64)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_mixture(rows, repeats, block_tokens, seed="mix"):
    """The mixture by lists: the exponent in closed form, and each source's passes one after the other."""
    made, copies = [], collections.Counter()
    for r in rows:
        nulls = [v is None for v in r]
        made.append((chained("row", nulls, *r), chained("check", nulls, *r), r[0], r[2], max(1, len((r[1] or "").split())), copies[r]))
        copies[r] += 1
    sums = collections.Counter()
    for m in made:
        sums[m[3]] += m[4]
    whole, ratio = sum(sums.values()), max(sums.values()) / min(sums.values())
    x = 0.0 if ratio <= repeats else 1 - math.log(repeats) / math.log(ratio)
    powers = {s: (t / whole) ** x for s, t in sums.items()}
    weights = {s: w / sum(powers.values()) for s, w in powers.items()}
    total = max(sums[s] / weights[s] for s in sums)
    out = []
    for s, t in sums.items():
        budget, blocks, at = max(t, round(weights[s] * total)), max(1, -(-t // block_tokens)), 0
        for turn in range(budget // t + 1):
            key = lambda m: (b := chained(seed, m[0], m[1], m[5]) % blocks, chained(seed, "block", s, turn, b))[::-1] + (chained(seed, "doc", turn, m[0], m[1], m[5]), m[0], m[1], m[2], m[5])  # noqa: B023, E731
            for m in sorted((m for m in made if m[3] == s), key=key):
                if at < budget:
                    out.append((m[2], s, m[4], m[5], round(weights[s], 9), turn, round(at / budget, 9)))
                at += m[4]
            at = t * (turn + 1)
    return collections.Counter(out)


def test_mixture_equals_brute_force(spark):
    """Copies beyond a task's part, a null source, rows that differ only in which column is null, and many blocks."""
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice(["big"] * 6 + ["mid"] * 3 + ["small", None]), "x", None) for i in range(500)]
    rows += [(1000, "the same row", "mid", None, None)] * 250 + [(1001, "a", "small", "y", None)] * 2 + [(1001, "a", "small", None, "y")] * 3 + [(1002, None, "rare", None, None), (1003, "", "rare", "z", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, u string, v string").repartition(5)
    for repeats, block_tokens in ((2.0, 40), (3.5, 7), (1000.0, 10**6)):
        got = mixing.mix_sources(df, max_repeats=repeats, block_tokens=block_tokens, part=16).collect()
        want = brute_mixture(rows, repeats, block_tokens)
        assert collections.Counter((r.id, r.source, r.tokens, r.copies, round(r.weight, 9), r["pass"], round(r.position, 9)) for r in got) == want
    taken = collections.Counter(tuple(r)[:1] + tuple(r)[3:] for r in mixing.mixed_documents(df, max_repeats=2.0, block_tokens=40, part=16).collect())
    times = collections.Counter()
    for k, n in brute_mixture(rows, 2.0, 40).items():
        times[k[0]] += n
    assert {k: sum(n for r, n in taken.items() if r[0] == k) for k in times} == times
    assert taken[(1001, "y", None)] >= 2 and taken[(1001, None, "y")] >= 3


def test_rows_are_repeated_in_parts(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([0, -3, 1, 15, 16, 17, 1000])], "k long, n long")
    got = sorted((r.k, r.at) for r in mixing.repeated(df, "n", "at", part=16).collect())
    assert got == [(k, j) for k, n in enumerate([0, 0, 1, 15, 16, 17, 1000]) for j in range(n)]


def test_masks_take_linear_time():
    text = "token=abcdef12 " * 100_000
    spans = secrets.Scanner(secrets.RULES).scan([text])[0]
    assert len(spans) == 100_000
    assert secrets.masked(text, [s[3] for s in spans], [s[2] for s in spans], "[secret]") == "token=[secret] " * 100_000
    assert secrets.masked("abcdefgh", [1, 2, 6], [4, 5, 7], "*") == "a*f*h"


def test_mixture_of_odd_rows(spark, odd):
    assert mixing.mixed_documents(odd, max_repeats=1.5).count() >= odd.count()
    assert mixing.mix_sources(odd.where("false"), target_entropy=0.5).count() == 0


def test_pipeline_stages_equal_brute_force(spark):
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    path = "/root/testdata/sf0.001"
    all_docs = at = spark.read.parquet(f"{path}/documents.parquet")
    kept = [sorted(tuple(r) for r in at.collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.durable(stage(spark, at, path), name)
        assert at.columns == all_docs.columns and at.dtypes == all_docs.dtypes
        kept.append(sorted(tuple(r) for r in at.collect()))
    scored = {r.doc_id: r.predicted for r in queries.op8_toxicity(spark, path).collect()}
    assert kept[1] == [r for r in kept[0] if not scored[r[0]]] and len(kept[1]) < len(kept[0])

    sets = [shingles(r[1]) for r in kept[1]]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    linked = [(kept[1][i][0], kept[1][j][0]) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j]) >= 0.8]
    first = set(brute_components([r[0] for r in kept[1]], linked).values())
    assert kept[2] == [r for r in kept[1] if r[0] in first] and len(kept[2]) < len(kept[1])

    scanner, masked = secrets.Scanner(secrets.RULES), []
    for r in kept[2]:
        text, done = "", 0
        for value, end in sorted((s[3], s[2]) for s in scanner.scan([r[1]])[0]):
            if value >= done:
                text += r[1][done:value] + "[secret]"
            done = max(done, end)
        text += r[1][done:]
        masked.append((r[0], text, r[2], r[3], len(text)))
    assert kept[3] == masked
    assert set(kept[4]) == set(kept[3]) and len(kept[4]) > len(kept[3])

    plain = Tokenizer.from_file(queries.tokenizer_path())
    want = [(r[0], r[3], len(ids := plain.encode(r[1], add_special_tokens=False).ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()) for r in kept[4]]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, path).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)
    empty = all_docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0


def test_pipeline_stages_take_odd_rows(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    at = odd
    for name, stage in corpus_pipeline.STAGES:
        at = common.durable(stage(spark, at, "/root/testdata/sf0.001"), name)
        assert at.count() >= 6


def test_stages_return_columns_of_any_name_as_they_are(spark):
    """Extra columns named after everything that the stages use inside, of other types than theirs."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    names = "row own_row nth kept_id kept_row taken_row each left i toxicity secrets key fp samples set component times n __row __toxicity __secrets __i __nth __new __words __taken".split()
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, data)
        assert done.dtypes == docs.dtypes
        rows = done.collect()
        assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)


def test_simhash_dedup_holds_few_texts_at_once():
    """Pieces of bounded rows and bytes, in order, from slices of batches too; a long text is one alone."""
    texts = ["é" * n for n in (3, 0, 40, 2, 2, 500, 1, 1, 1, 1, 1)]
    batch = pa.record_batch([pa.array(range(11)), pa.array(texts)], ["i", "t"])
    got = [(rest.column(0).to_pylist(), found) for rest, found in simhash.pieces(iter([batch, batch.slice(2, 3), batch.slice(0, 0)]), text_bytes=100, most=4)]
    assert [i for i, _ in got] == [[0, 1, 2, 3], [4], [5], [6, 7, 8, 9], [10], [2, 3, 4]]
    assert all(found == [texts[i] for i in rows] for rows, found in got)


def test_text_operators_send_python_small_batches(spark):
    """Rows and bytes of the batches after near-dedup, after the toxicity model and after its scores; lower settings stay."""
    rows, size = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))
    before = {k: spark.conf.get(k) for k in (rows, size)}
    docs = spark.createDataFrame([(i, f"a text of some words {i}", "s") for i in range(20)], "doc_id long, text string, source string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")

    def counted(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], ["n"])

    def largest(n, chars):
        return max(r.n for r in spark.range(0, n, 1, 1).selectExpr(f"repeat('x', {chars}) as t").mapInArrow(counted, "n long").collect())

    model = toxicity.fit_toxicity(docs, labels)
    try:
        for call in (lambda: simhash.simhash_dedup(docs), lambda: toxicity.fit_toxicity(docs, labels), lambda: toxicity.score_toxicity(docs, model)):
            spark.conf.set(rows, "10000")
            spark.conf.set(size, "64m")
            call()
            assert largest(1500, 1) == 512 and largest(20, 1 << 20) <= 9
        spark.conf.set(rows, "100")
        spark.conf.set(size, "1m")
        toxicity.score_toxicity(docs, model)
        assert spark.conf.get(rows) == "100" and largest(20, 1 << 19) <= 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
