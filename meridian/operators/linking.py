"""Entity resolution between points of a graph and named regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, terms


def not_dissolved(entities: DataFrame, dissolved: DataFrame) -> DataFrame:
    """Entities without a dissolution date: an anti-join."""
    return entities.join(dissolved.select("subject"), "subject", "left_anti")


def of_type(types: DataFrame, kind: str) -> DataFrame:
    return types.where(F.col("object") == kind).select("subject")


def candidates(placed: DataFrame, types: DataFrame, kind: str, labels: DataFrame, dissolved: DataFrame) -> DataFrame:
    """``subject, region_id, name, label``: placed(subject, region_id, name) of a type, not dissolved, with their English labels."""
    p = not_dissolved(placed.join(of_type(types, kind), "subject", "left_semi"), dissolved)
    english = labels.where(terms.is_english(F.col("object"))).select("subject", F.col("object").alias("label"))
    return p.join(english, "subject").select("subject", "region_id", "name", "label").distinct()


def layer0_scores(cands: DataFrame) -> DataFrame:
    """With ``similarity`` of the name to the shortened label, and ``match``: every word of the name is in the label."""
    label = terms.short_label(F.col("label"))
    return cands.withColumns({"similarity": similarity.similarity(F.col("name"), label), "match": terms.name_in_label(F.col("name"), F.col("label"))})


def layer0(scored: DataFrame, least: float = 0.8) -> DataFrame:
    """``subject, region_id``: the best of each region, by match, then similarity, then smaller subject; kept if it matches or scores."""
    best = scored.groupBy("region_id").agg(F.min(F.struct((~F.col("match")).alias("miss"), (-F.col("similarity")).alias("far"), F.col("subject"))).alias("b"))
    return best.where((F.col("b.far") <= -least) | ~F.col("b.miss")).select(F.col("b.subject").alias("subject"), "region_id")


def layer1_scores(cands: DataFrame, type_labels: DataFrame, region_types: list[str]) -> DataFrame:
    """cands(subject, region_id, name, varname, kind, label): adds ``best_score`` over alternative names and ``type_match``.

    type_labels(subject, type_label): a region's kind must be in one of the entity's type labels. ``region_types`` is the small list of
    words that labels lose.
    """
    label = terms.strip_types(terms.short_label_lower(F.col("label")), region_types)
    scored = cands.withColumn("best_score", similarity.best_name(terms.join_names(F.col("name"), F.col("varname")), label))
    flags = scored.join(type_labels, "subject", "left").withColumn("m", F.coalesce(terms.same_type(F.col("type_label"), F.col("kind")), F.lit(False)))
    return flags.groupBy("subject", "region_id", "name", "kind", "label").agg(F.max("best_score").alias("best_score"), F.max("m").alias("type_match"))


def layer1(scored: DataFrame, least: float = 0.8) -> DataFrame:
    """``subject, region_id``: best of each region, then best of each subject, then the threshold; ties to the smaller id."""
    per_region = scored.groupBy("region_id").agg(F.min(F.struct((~F.col("type_match")).alias("miss"), (-F.col("best_score")).alias("far"), F.col("subject"))).alias("b"))
    one = per_region.select("region_id", "b.*")
    per_subject = one.groupBy("subject").agg(F.min(F.struct("miss", "far", "region_id")).alias("b"))
    return per_subject.where((F.col("b.far") <= -least) & ~F.col("b.miss")).select("subject", F.col("b.region_id").alias("region_id"))
