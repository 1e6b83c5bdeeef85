"""A training corpus made from raw documents, stage by stage.

Each stage is one operator applied to all that the stage before it kept. Stages but the last return the columns of
documents; the last returns the encoded corpus, whose tokens follow each other as the mixing stage has ordered them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, jaccard, langid, mixing, secrets
from tidemark.llm.queries import vocabulary
from tidemark.session import cut

#: Several stages train models or compile automata, which SQL cannot express.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, that with the smallest doc_id stays."""
    return jaccard.keep_one(docs, n=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; widely copied examples and all documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order that interleaves sources by the square roots of their sizes; its files hold them in it."""
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as one run of tokens in the order of the mix: for every document its position, the offset of its first
    token, and the digests of its ids and of their decoding."""
    return mixing.placed(bpe.digests(mixing.located(docs), vocabulary(), mixing.PLACE), "n_tokens")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = cut(docs, f"stage-{at}")
    return docs
