"""Combining stored and computed scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators.ranks import latest_per_key


def scored_or_heuristic(features: DataFrame, scores: DataFrame, key: str = "admission_id") -> DataFrame:
    """Latest stored score of every row, else the heuristic one, with tier, factors and source."""
    newest = latest_per_key(
        scores.select(key, F.col("risk_score").cast("double").alias("_stored"), "predicted_at", "prediction_id"),
        [key], [F.desc("predicted_at"), F.desc("prediction_id")],
    ).select(key, "_stored")
    joined = features.join(newest, key, "left").withColumn("_heuristic", F.round(scoring.heuristic_score(), 4))
    score = F.coalesce("_stored", "_heuristic")
    source = F.when(F.col("_stored").isNull(), "heuristic_fallback").otherwise("stored")
    return joined.withColumns(
        {"risk_score": score, "risk_tier": scoring.risk_tier(score), "score_source": source, "factors": scoring.weighted_factors()}
    ).drop("_stored", "_heuristic")


def unscored(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys asked for, and how many of them are unknown."""
    asked = requested.select(key).distinct()
    found = known.select(key).distinct().withColumn("_known", F.lit(True))
    return asked.join(found, key, "left").agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(F.col("_known").isNull()).alias("failed")
    )
