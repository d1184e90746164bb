"""A corpus pipeline of four stages, each one of the llm operators. Every stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import mixing, pieces, quality, simhash
from meridian.llm.common import shared_folder, table
from meridian.llm.registry import PIECE_MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from the input's own labelled rows."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(spark, docs.select(*COLUMNS), model).where("quality_score >= 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the first document: those linked by a similarity of 0.8 of their sets of five-word shingles.

    The first is that of the smallest id, then of the smallest digest of the text; null ids come last. A row is a document by its id (or none) and
    text, so different texts of one id are different documents; rows that repeat both are one. Texts without words are copies of each other.
    """
    near = simhash.near_copies(docs)
    keep = near.where(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest"))).select(F.col("doc_id").alias("kept_id"), "digest")
    rows = docs.select(*COLUMNS).withColumn("digest", simhash.text_digest())
    rows = rows.join(keep, (F.col("doc_id").eqNullSafe(F.col("kept_id"))) & (rows["digest"] == keep["digest"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "digest"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its taken words over its words, halves rounded up; so 0 to 3 times.

    A stream of a source (one for each 65,536 words) takes a run of blocks, so only the documents at the run's two ends are taken in part, and its
    total stays within one document of its share. Documents without words cannot be counted in words and stay once.
    """
    mixed = mixing.mix_sources(spark, docs.select(*COLUMNS))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5)).otherwise(1).cast("int")
    return mixed.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.expr("sequence(1, times)"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts as piece ids: what a trainer reads."""
    ids = pieces.encode_documents(docs.select("doc_id", "source", "text"), PIECE_MODEL)
    return ids.select("doc_id", "source", F.size("piece_ids").alias("n_pieces"), "piece_ids")


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("mix", mix), ("sentencepiece", encode)]

#: Nearest-neighbour votes, fingerprints and Viterbi can't be put in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
