"""Scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo

# The loss is one half at a miss of 1000 metres; 250 metres is its scale.
LOSS_MIDDLE = 1000
LOSS_SCALE = 250
EPSILON = 1e-7
CUT_OFFS = tuple(range(10, 60, 5))  # hundredths


def half_even_ratio(total: Column, count: Column) -> Column:
    """``total / count`` of whole numbers, rounded half to even without leaving whole numbers."""
    whole = F.floor(total / count)
    rest = total - whole * count
    up = (2 * rest > count) | ((2 * rest == count) & (F.pmod(whole, F.lit(2)) == 1))
    return whole + up.cast("bigint")


def miss_distance(predicted: DataFrame) -> DataFrame:
    """``loss_dis``: metres between the true end and the predicted point."""
    return predicted.withColumn(
        "loss_dis",
        geo.distance_m(geo.degrees("end_lat_e5"), geo.degrees("end_lon_e5"), F.col("predict_lat"), F.col("predict_lon")),
    )


def trip_loss(missed: DataFrame) -> DataFrame:
    """``loss_e5``: the sigmoid loss of a miss in hundred-thousandths; the loss itself has 5 decimals."""
    loss = F.lit(1.0) / (F.lit(1.0) + F.exp((F.lit(LOSS_MIDDLE) - F.col("loss_dis")) / LOSS_SCALE))
    return missed.withColumn("loss_e5", F.rint(loss * F.lit(1e5)).cast("bigint")).withColumn(
        "final_loss", F.col("loss_e5") / F.lit(1e5)
    )


def loss_accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean loss (5 decimals) and share of trips whose zone was predicted (4 decimals), null without truth."""
    hit = (F.col("end_zoneid") == F.col("predict_zone_id")).cast("bigint")
    known = F.col("loss_e5").isNotNull()
    return scored.groupBy(*by).agg(
        F.count("*").alias("trips"),
        (half_even_ratio(F.sum("loss_e5"), F.count("loss_e5")) / F.lit(1e5)).alias("loss"),
        (
            half_even_ratio(F.sum(F.when(known, F.coalesce(hit, F.lit(0)))) * 10_000, F.count("loss_e5")) / F.lit(1e4)
        ).alias("accuracy"),
    )


def loss_by_car(scored: DataFrame) -> DataFrame:
    return scored.groupBy("out_id", "model").agg(
        (F.sum("loss_e5") / F.count("loss_e5") / F.lit(1e5)).alias("loss"), F.count("*").alias("trips")
    )


def multilabel_f(long: DataFrame, threshold: float) -> DataFrame:
    """F measure of each row over its labels: ``2 * correct / (true + predicted)``, 0 when nothing is true or predicted.

    Rows are ``r_key, label, truth, score``; a score from ``threshold`` up counts as predicted.
    """
    predicted = (F.col("score") >= threshold).cast("bigint")
    sums = long.groupBy("r_key").agg(
        F.sum(F.col("truth") * predicted).alias("correct_sum"),
        F.sum("truth").alias("true_sum"),
        F.sum(predicted).alias("pred_sum"),
    )
    ratio = F.try_divide(2 * F.col("correct_sum"), F.col("true_sum") + F.col("pred_sum"))
    return sums.withColumn("f_measure", F.coalesce(ratio, F.lit(0.0)))


def _rounded(value: Column) -> Column:
    return F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value.cast("double"))))


def precision_recall_f(rows: DataFrame, beta: float = 1.0) -> DataFrame:
    """Precision, recall, F-beta and F1 of ``score`` against ``truth`` after clipping to 0..1 and rounding."""
    if beta < 0:
        raise ValueError("beta must not be negative")
    counts = rows.agg(
        F.sum(_rounded(F.col("truth") * F.col("score"))).alias("tp"),
        F.sum(_rounded(F.col("score"))).alias("pp"),
        F.sum(_rounded(F.col("truth"))).alias("ap"),
    )
    rates = counts.select(
        "ap",
        (F.col("tp") / (F.col("pp") + EPSILON)).alias("precision"),
        (F.col("tp") / (F.col("ap") + EPSILON)).alias("recall"),
    )

    def f_score(b: float) -> Column:
        p, r, bb = F.col("precision"), F.col("recall"), b * b
        return F.when(F.col("ap") == 0, 0.0).otherwise((1 + bb) * (p * r) / (bb * p + r + EPSILON))

    return rates.select("precision", "recall", f_score(beta).alias("fbeta"), f_score(1.0).alias("f1"))


def f1_by_cut_off(rows: DataFrame, cut_offs: Sequence[int] = CUT_OFFS) -> DataFrame:
    """F1 (5 decimals) of ``score > cut`` against ``truth`` for each cut in hundredths, in one pass."""
    cuts = rows.select("truth", "score", F.explode(F.array(*[F.lit(c) for c in cut_offs])).alias("cut"))
    marked = cuts.withColumn("_yes", (F.col("score") > F.col("cut") / F.lit(100.0)).cast("bigint"))
    sums = marked.groupBy("cut").agg(
        F.sum(F.col("truth") * F.col("_yes")).alias("tp"),
        F.sum("_yes").alias("pp"),
        F.sum("truth").alias("ap"),
    )
    both = F.col("pp") + F.col("ap")
    return sums.select(
        (F.col("cut") / F.lit(100.0)).alias("threshold"),
        F.coalesce(
            F.when(both > 0, half_even_ratio(2 * F.col("tp") * 100_000, both) / F.lit(1e5)), F.lit(0.0)
        ).alias("f1"),
    )


def best_cut_off(rows: DataFrame) -> DataFrame:
    """The cut-off with the greatest F1, the smallest of equal ones."""
    return f1_by_cut_off(rows).agg(
        F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1")
    )
