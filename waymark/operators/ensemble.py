"""Choosing among and joining the results of several model runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.evaluate import loss_by_car


def best_model_by_car(scored: DataFrame) -> DataFrame:
    """For each car the model with the least mean validation loss, ties to the first name."""
    return loss_by_car(scored).groupBy("out_id").agg(
        F.min_by("model", F.struct("loss", "model")).alias("model"), F.min("loss").alias("loss")
    )


def mean_best_loss(best: DataFrame) -> DataFrame:
    """Mean over cars of the best loss, 6 decimals."""
    return best.agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("cars"))


def merge_best(predictions: DataFrame, best: DataFrame) -> DataFrame:
    """Each car's predictions from its best model."""
    return predictions.join(best.select("out_id", "model"), ["out_id", "model"], "left_semi")


def submission(targets: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per trip to score with its predicted end; trips without a prediction keep nulls."""
    ends = predictions.select("r_key", F.col("predict_lat").alias("end_lat"), F.col("predict_lon").alias("end_lon"))
    return targets.select("r_key").join(ends, "r_key", "left")


def first_value_wins(predictions: DataFrame, priority: str, columns: Sequence[str]) -> DataFrame:
    """Per trip and column, the value of the first run (least ``priority``) that has one."""
    return predictions.groupBy("r_key").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(priority))).alias(c) for c in columns]
    )


def stack_features(probabilities: DataFrame) -> DataFrame:
    """First-level probabilities side by side in long form; the feature is named ``model#zone``."""
    return probabilities.select(
        "out_id", "r_key", F.concat("model", F.lit("#"), F.col("zoneid").cast("string")).alias("feature"), "p"
    )


def first_address(dictionary: DataFrame) -> DataFrame:
    """First address of each zone in (lat, lon) order."""
    return dictionary.groupBy("out_id", "zoneid").agg(F.min(F.struct("lat_e5", "lon_e5")).alias("a")).select(
        "out_id", "zoneid", (F.col("a.lat_e5") / F.lit(1e5)).alias("predict_lat"), (F.col("a.lon_e5") / F.lit(1e5)).alias("predict_lon")
    )


def stacked_position(zones: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Predicted zone of each trip to the first address of that zone."""
    wanted = zones.withColumnRenamed("predict_zone_id", "zoneid")
    return wanted.join(first_address(dictionary), ["out_id", "zoneid"], "left").withColumnRenamed(
        "zoneid", "predict_zone_id"
    )
