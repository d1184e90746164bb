"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import idstore, lm, mixing, pieces, quality, sharding, simhash, topk, vectors, warc
from .common import table


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(spark, table(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(spark, table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_idstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idstore.round_trip(spark, table(spark, sf_dir, "documents"), BYTE_BPE, end=2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(warc.write_warc(spark, table(spark, sf_dir, "pages")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(spark, docs, model)
    score = F.col("quality_score")
    return scored.select("doc_id", quality.held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    import corpus_pipeline

    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    order = sorted(found, key=lambda k: int(k[2:].split("_")[0]))
    return {k: found[k] for k in order} | {"pipeline": corpus_pipeline.run}


ORACLES: dict[str, str] = {}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
