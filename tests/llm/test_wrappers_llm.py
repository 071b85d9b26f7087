"""The registered queries: columns, types, row counts and the contracts' laws, on the smallest tables and on empty ones."""

import collections
import hashlib
import zlib

import pytest

from quern.llm import common, queries

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "labels"]
COLUMNS = {
    "op1_cross_polytope_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op2_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op3_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op4_hilbert_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_bpe_encode_decode": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_temperature_mixing": "doc_id bigint, source string, tokens bigint, copies int, weight double, pass bigint, position double",
    "op10_pii_surrogates": "doc_id bigint, n_entities bigint, text string",
    "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op13_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").where("false").write.parquet(f"file://{folder}/{t}.parquet")
    return f"file://{folder}"


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_types_and_rows(spark, empty, texts, name):
    df = queries.QUERIES[name](spark, DATA)
    types = dict(df.dtypes)
    want = [c.split() for c in COLUMNS[name].split(", ")]
    assert [(c, types[c]) for c, _ in want] == [(c, t) for c, t in want]
    rows = df.collect()
    if name == "op1_cross_polytope_ann":
        per_query = collections.defaultdict(list)
        for r in rows:
            per_query[r.query_id].append((r.rank, r.score, r.vec_id))
        assert sorted(per_query) == [0, 100, 200, 300, 400]
        for q, found in per_query.items():
            found.sort()
            assert [f[0] for f in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted(f[1:] for f in found) and q not in {f[2] for f in found}
    elif name == "op9_temperature_mixing":
        assert {r.doc_id for r in rows} == set(texts) and all(0 <= r.position < 1 for r in rows)
    elif name == "op3_embedding_near_dedup":
        assert len(rows) == 500 and all(r.kept == (r.vec_id == r.component_id) for r in rows)
    elif name == "op12_spelling_variants":
        assert rows and all(r.n >= 5 and len(r.word) >= 6 and (r.form is None) == (r.form_n is None) for r in rows)
    else:
        assert sorted(r.doc_id for r in rows) == sorted(texts)
    if name == "op4_hilbert_sharding":
        held = collections.defaultdict(list)
        for r in rows:
            held[r.shard].append(r.slot)
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode()), "rows", None)
        assert all(sorted(s) == list(range(len(s))) for s in held.values()) and sorted(held) == list(range(24))
        assert max(map(len, held.values())) - min(map(len, held.values())) <= 1
    if name == "op5_bpe_encode_decode":
        assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
    if name == "op6_simhash_near_dedup":
        by_text = collections.defaultdict(set)
        for r in rows:
            by_text[texts[r.doc_id]].add((r.fingerprint, r.component_id))
            assert len(r.fingerprint) == 16 and r.component_id <= r.doc_id
        assert all(len(v) == 1 for v in by_text.values())
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_scratch_tables_are_freed(spark, tmp_path):
    written = []

    def build():
        written.append(common.durable(spark.range(5), "inner"))
        return written[0].where("id > 1")

    kept = common.alone(build, "outer")
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist|cannot|FileNotFound"):
        spark.read.parquet(written[0].inputFiles()[0]).count()
