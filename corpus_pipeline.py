"""The corpus pipeline: quality rules, near-deduplication, secret redaction, mixing, and BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbsense.llm import bpe, mixing, neardup, quality, secrets
from curbsense.llm.session import outside, staged, staging


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others lose their boilerplate lines, and n_chars is that of the new text.

    Null and empty texts go; repeated rows share a verdict; an empty table gives none.
    """
    return quality.clean(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the document of smallest id stays.

    Null and empty texts and rows without an id stay; rows that repeat a kept id stay repeated; an
    empty table gives none.
    """
    return neardup.deduplicated(docs, shingle=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars is that of the new text.

    A null text and its n_chars stay; repeated rows stay repeated; an empty table gives none.
    """
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is one of its own, and null and empty texts weigh nothing; repeated rows draw
    alike; an empty table gives none.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them.

    A null text counts as empty; repeated rows give equal rows; an empty table gives none.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Hash draws and token ids are beyond SQL; the result is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage gives. What a stage has staged on its way is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with staging(spark):
            # The stage's result stays: it is staged outside of the scope.
            docs = outside(staged, stage(spark, docs, sf_dir))
    return docs
