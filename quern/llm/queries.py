"""The registered queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.llm import ann, bpe, embedding_dedup, hilbert, licenses, lines, mixing, runs, secrets, simhash, spelling, surrogates, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest_neighbours(rows, rows.where("vec_id % 100 = 0"), k=10)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_near_dups(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), cosine=0.93)


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return hilbert.hilbert_shards(docs, dims=["lang", "source", "size"], n_shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), mode="digest", keep=["doc_id"])


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = simhash.durable(simhash.with_fingerprint(docs, "text", ["doc_id"], words=3, name="fp"), "fp")
    return simhash.simhash_components(rows, "doc_id").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secrets.BASE_RULES]

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"] == kind)

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(said(F.filter("secrets", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"),
        said(F.col("secrets")).alias("spans"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity.score").alias("score"), "toxicity.evidence")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs, max_repeats=2.0)
    return mixed.select(F.col("id").alias("doc_id"), "source", "tokens", F.col("copies").cast("int").alias("copies"), "weight", "pass", "position")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    mapping = surrogates.fit_surrogates(docs, key=b"registered query")
    done = surrogates.replace_entities(docs, mapping)
    return done.select("doc_id", F.size("entities").cast("long").alias("n_entities"), "text", "entities")


@F.pandas_udf(StringType())
def planted_runs(texts: pd.Series, hashes: pd.Series) -> pd.Series:
    """The contract's texts: where the id's hash ends in 0, the words from one on repeat a stretch of themselves."""
    out = []
    for text, h in zip(texts, hashes.tolist()):
        if isinstance(text, str) and h == h and h is not None and int(h) % 10 == 0 and (words := text.encode("utf-8", "replace").split()):
            g = int(h) // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            text = b" ".join([*words[:a], *(words[a + i % p] for i in range(len(words) - a))]).decode()
        out.append(text)
    return pd.Series(out, dtype=object)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text", planted_runs("text", F.crc32(F.col("doc_id").cast("string").cast("binary"))))
    found = runs.periodic_runs(docs, out="p").select("doc_id", "p.*")
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs come by start and period, so a later one must have a greater exponent.
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", F.aggregate("runs", none, better)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(said, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted_edits(doc: object, words: list[str]) -> list[str]:
    """The contract's words of a text: where 199 divides the hash of id and word, the word has lost a code point."""
    if doc is None:
        return words
    begun = zlib.crc32(f"{doc}:".encode())
    out = []
    for w in words:
        h = zlib.crc32(w.encode(), begun)
        out.append(w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w)
    return out


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), least_size=6, edit=planted_edits)
    return spelling.spelling_variants(counts.where("n >= 5"), ratio=5)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), least=10)
    return done.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.coalesce("lines.text", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cross_polytope_ann": op1_cross_polytope_ann,
    "op2_license_scan": op2_license_scan,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_hilbert_sharding": op4_hilbert_sharding,
    "op5_bpe_encode_decode": op5_bpe_encode_decode,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_temperature_mixing": op9_temperature_mixing,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_line_dedup": op13_line_dedup,
}

def _secret_sql() -> str:
    """The secret scan in SQL: per rule the matches, their values and the text between them give the places."""
    parts = []
    for i, r in enumerate(secrets.RULES):
        pattern = "(" + r.regex.replace("{24,}", "+").replace("'", "''") + ")"
        pattern = f"(?i){pattern}" if r.any_case else pattern
        value = 3 if r.tail else 1
        parts.append(
            f"""SELECT doc_id, {i} AS rule, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{pattern}', 1) AS m,
            regexp_extract_all(t, '{pattern}', {value}) AS v, string_split_regex(t, '{pattern}') AS s FROM docs"""
        )
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    said = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rule)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL ".join(parts)}),
    each AS (SELECT doc_id, rule, kind, least, m, v, s, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
    spans AS (SELECT doc_id, rule, kind, length(v[i]) AS n, least,
        CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS size FROM each),
    kept AS (SELECT doc_id, rule, kind, a, a + size AS b FROM spans WHERE n >= least),
    sums AS (SELECT doc_id, {counts}, {said} FILTER (WHERE kind IN ({base})) AS base, {said} AS spans FROM kept GROUP BY doc_id)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN sums USING (doc_id)"""


def _license_sql() -> str:
    """The license scan in SQL: words are put between blanks of their own, so that no rule needs to look ahead."""
    rows = []
    for r in licenses.rules():
        pattern = r["pattern"].removeprefix(" (").removesuffix(")(?= )").replace(" ?", "@").replace(" ", "  ").replace("@", "(?:  )?")
        rows.append(f"({r['rule']}, '{r['label']}', '{r['kw']}', ' {pattern} ', {r['priority']}, {str(r['base']).lower()})")
    word = r"[0-9a-z\x{80}-\x{10FFFF}]+"
    sure = "[" + ", ".join(str(s) for s in licenses.SURENESS) + "]"
    return f"""WITH rules(rule, label, kw, pattern, priority, base) AS (VALUES {", ".join(rows)}),
    docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    counted AS (SELECT doc_id, len(regexp_extract_all(t, '{word.replace("a-z", "A-Za-z")}')) AS n_words FROM docs),
    worded AS (SELECT doc_id, regexp_extract_all(translate(t, '{licenses.UPPER}', '{licenses.LOWER}'), '{word}') AS words FROM docs),
    met AS (SELECT doc_id, rule, label, priority, base, regexp_extract_all(norm, pattern) AS m, string_split_regex(norm, pattern) AS s
        FROM (SELECT *, ' ' || array_to_string(words, '  ') || ' ' AS norm FROM worded) JOIN rules ON list_contains(words, kw)),
    each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM met WHERE len(m) > 0),
    hits AS (SELECT doc_id, rule, label, priority, base,
        (length(x) - length(replace(x, ' ', ''))) // 2 AS a, (length(m[i]) - length(replace(m[i], ' ', ''))) // 2 AS n
        FROM (SELECT *, array_to_string(s[1:i], '') || array_to_string(m[1:i - 1], '') AS x FROM each)),
    kept AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.doc_id = h.doc_id AND o.a <= h.a AND o.a + o.n >= h.a + h.n AND o.priority <= h.priority
        AND (o.a < h.a OR o.n > h.n OR o.priority < h.priority OR o.rule < h.rule))),
    based AS (SELECT doc_id, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits WHERE base GROUP BY doc_id),
    named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM kept UNION SELECT doc_id, label FROM hits WHERE base) GROUP BY doc_id),
    scored AS (SELECT doc_id, max(CAST({sure} AS DOUBLE[])[priority + 1]) AS score FROM kept GROUP BY doc_id)
    SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
        coalesce(score, 0.0) AS score FROM counted LEFT JOIN based USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN scored USING (doc_id)"""


_LINKS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
    reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x),
    least AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x), n AS (SELECT x AS vec_id, count(*) AS n_links FROM p GROUP BY x)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)"""


def _crc32_sql(text: str) -> str:
    """The unsigned crc32 of a string's UTF-8, over a table of remainders named ``crc`` with one row (tab)."""
    code = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {code}, lambda c, b: xor(tab[xor(c, b) % 256 + 1], c >> 8)), 4294967295)"


_CRC_TABLE_SQL = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab)"""

#: Places where 16 words stand twice give the periods to try; equal words a period apart make stretches.
_RUNS_SQL = f"""WITH {_CRC_TABLE_SQL},
    split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc),
    sized AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN len(w) > 0 THEN h // 10 % len(w) ELSE 0 END AS a FROM split),
    docs AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN w[:a] || list_transform(range(n - a), lambda i: w[a + i % (1 + (n - a) // (3 + h // 10 % 8)) + 1]) ELSE w END AS w FROM sized),
    grams AS MATERIALIZED (SELECT doc_id, n, i, hash(w[i + 1:i + 16]) AS gram FROM (SELECT *, unnest(range(n - 15)) AS i FROM docs)),
    tries AS (SELECT DISTINCT a.doc_id, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
    same AS (SELECT doc_id, q, i FROM (SELECT doc_id, q, w, unnest(range(n - q)) AS i FROM tries JOIN docs USING (doc_id)) WHERE w[i + 1] = w[i + q + 1]),
    stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS z FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM same) GROUP BY doc_id, q, part),
    long AS MATERIALIZED (SELECT * FROM stretches WHERE z >= 24 AND z >= 3 * q),
    runs AS MATERIALIZED (SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM long o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.z >= r.s + r.z)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + z)) AS i FROM runs),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM docs) t
        WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = t.doc_id AND g.i = t.i) GROUP BY doc_id),
    said AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || z || ',' || q || chr(10), '' ORDER BY s, q) AS body,
        first(struct_pack(s := s, z := z, q := q) ORDER BY CAST(z AS DOUBLE) / q DESC, s, q) AS best FROM runs GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.z AS length, best.q AS period, 1000 * best.z // best.q AS exponent_milli,
        sha256(coalesce(said.body, '')) AS runs_sha256, sha256(coalesce(kept.body, '')) AS collapsed_sha256
    FROM docs d LEFT JOIN said ON said.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

#: Near words share a form with one letter left out; letters beyond ASCII get one byte each, so that the distance counts letters.
_SPELLING_SQL = f"""WITH RECURSIVE {_CRC_TABLE_SQL},
    found AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{licenses.UPPER}', '{licenses.LOWER}') AS w FROM documents),
    counted AS MATERIALIZED (SELECT doc_id, w, count(*) AS k FROM found GROUP BY doc_id, w),
    hashed AS (SELECT w, k, {_crc32_sql("(doc_id || ':' || w)")} AS h FROM counted, crc),
    edited AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
    words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n, translate(word, '{"".join(chr(c) for c in range(0xC0, 0x100))}', '{"".join(chr(c) for c in [*range(48, 58), *range(65, 91), *b"!#$%&()*+,-./:;<=>?@[]^_{|}~"])}') AS code
        FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
    forms AS (SELECT word, n, code, code AS v FROM words UNION SELECT word, n, code, code[:i - 1] || code[i + 1:] FROM (SELECT *, unnest(range(1, length(code) + 1)) AS i FROM words)),
    near AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM forms a JOIN forms b ON a.v = b.v AND a.word <> b.word AND levenshtein(a.code, b.code) = 1),
    best AS (SELECT word, n, count(*) AS n_near, first(struct_pack(o := other, m := m) ORDER BY m DESC, encode(other)) AS b FROM near GROUP BY word, n),
    chosen AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.o END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best USING (word)),
    walk(word, last, depth) AS (SELECT word, word, 0 FROM chosen UNION ALL SELECT k.word, c.form, depth + 1 FROM walk k JOIN chosen c ON c.word = k.last WHERE c.form IS NOT NULL),
    roots AS (SELECT word, arg_max(last, depth) AS root FROM walk GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM chosen JOIN roots USING (word)"""

_LINES_SQL = f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
    rows AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM split),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{licenses.UPPER}', '{licenses.LOWER}') AS key FROM rows),
    shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first <> doc_id) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE first IS NULL OR first = doc_id), '')) AS kept_sha256
    FROM keyed LEFT JOIN shared USING (key) GROUP BY doc_id"""

#: The others go beyond SQL; their tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_license_scan": _license_sql(), "op3_embedding_near_dedup": _LINKS_SQL, "op7_secret_scan": _secret_sql(), "op11_periodic_runs": _RUNS_SQL, "op12_spelling_variants": _SPELLING_SQL, "op13_line_dedup": _LINES_SQL}
