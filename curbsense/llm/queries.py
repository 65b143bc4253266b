"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from curbsense.llm import bpe, chat, embeddings, licences, media_gif, merkle, mixing, neardup, quality, search, secrets, sharding, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=40).withColumn("law", F.lit("key"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), window=20)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_gif.read_back(media_gif.store_texts(_table(spark, sf_dir, "documents")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op11_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), k=10)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(_table(spark, sf_dir, "documents"), now={"text": F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))})


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(_table(spark, sf_dir, "embeddings"), least=0.95)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_mixing": op1_mixing,
    "op2_chat": op2_chat,
    "op3_bpe": op3_bpe,
    "op4_licences": op4_licences,
    "op5_sharding": op5_sharding,
    "op6_substring": op6_substring,
    "op7_quality": op7_quality,
    "op8_gif": op8_gif,
    "op9_secrets": op9_secrets,
    "op10_minhash": op10_minhash,
    "op11_maxscore": op11_maxscore,
    "op12_merkle": op12_merkle,
    "op13_embeddings": op13_embeddings,
}

ORACLE_SQL = {
    "op2_chat": chat.ORACLE_SQL,
    "op7_quality": quality.ORACLE_SQL,
    "op9_secrets": secrets.ORACLE_SQL,
    "op11_maxscore": search.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
}
