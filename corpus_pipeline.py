"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, secrets are masked, sources are
mixed, and the texts are encoded. Each stage takes all that the one before kept.

For all stages: null texts count as empty and stay null, null ids and sources are values like others, whole texts of
any length count, columns beside the five of documents pass through whatever their names, and an empty table gives an
empty result. What ties and repeated rows give is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, mixing, secrets, simhash, toxicity
from quern.llm.common import alone, fresh
from quern.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, learnt from the labels that aren't held out.

    Equal texts have equal scores, so they stay or go together; repeated rows all stay or all go.
    """
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = fresh(docs.columns, "toxicity")[0]
    return toxicity.score_toxicity(docs, model, out=out).where(F.col(out)["score"] < 0.5).drop(out)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group: five-word shingles, similarity of 0.8 or more.

    The smallest id stays (nulls count as the largest), ties go by a hash of the row, and of repeated rows one stays.
    Documents without a word are one group.
    """
    return simhash.simhash_dedup(docs, words=5, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced; n_chars follows the text. Values that overlap are replaced together; repeated rows stay."""
    out = fresh(docs.columns, "secrets")[0]
    masked = secrets.mask_secrets(secrets.scan_secrets(docs, out=out), spans_col=out).drop(out)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to twice, so that sources near equal weights.

    A source's weight counts words, whatever vocabulary encodes them later. Repeated rows are documents of their own; which of them is read twice doesn't show.
    """
    return mixing.mixed_documents(docs, max_repeats=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mixture, repeats included: doc_id, source, token count and the digests of its ids and decoded text."""
    return bpe.encode_texts(docs, tokenizer_path(), mode="digest", keep=["doc_id", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("temperature_mixing", mix),
    ("bpe_encode_decode", encode),
]

#: The stages go beyond SQL (automata, merges, learnt scores); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last written as Parquet and read again; what a stage wrote on the way is freed with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = alone(partial(stage, spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
