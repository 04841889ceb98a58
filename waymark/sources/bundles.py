"""Result bundles: four tables of many model runs, and a ``runs`` table with their parameters; and single runs in either of two forms.

A run's predictions are stored as positions (``r_key, predict_lat, predict_lon``) or as probabilities with one column per zone (``out_id,
r_key`` and the zones' numbers, null or 0 where a car doesn't have the zone). Readers take both.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import ensemble, models

TABLES = ("validation", "predictions", "probabilities_target", "probabilities_train")


def save_bundle(tables: dict[str, DataFrame], path: str) -> str:
    """Append the tables of one or more runs, divided by ``model``. Readers of one run touch only its folders."""
    for name in TABLES:
        if name in tables:
            tables[name].write.mode("append").partitionBy("model").parquet(f"{path}/{name}")
    return path


def load_bundle(spark: SparkSession, path: str, table: str, models: list[str] | None = None) -> DataFrame:
    df = spark.read.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")
    return df if models is None else df.where(F.col("model").isin(models))


def attach_car(df: DataFrame, trips: DataFrame) -> DataFrame:
    """Give rows that only carry ``r_key`` their car again; both sides have one row per trip."""
    return df.join(trips.select("r_key", "out_id"), "r_key", "left")


def run_name(loss, model, threshold, split_num, cohort):
    """Name of a run; it begins with the loss, so sorting by name puts the best run first."""
    return F.concat_ws(
        "_",
        F.format_string("%07.5f", loss),
        model,
        threshold.cast("string"),
        F.concat(F.lit("split_num"), split_num.cast("string")),
        F.concat(F.lit("geo"), cohort.cast("string")),
    )


def select_runs(runs: DataFrame, pattern: str, top: int | None = None) -> DataFrame:
    """Rows of the runs whose name matches; ``top`` keeps the first few by name, the best."""
    chosen = runs.where(F.col("model").rlike(pattern))
    return chosen if top is None else chosen.orderBy("model").limit(top)


def save_wide(probabilities: DataFrame, path: str) -> str:
    """One run's probabilities (out_id, r_key, zoneid, p) with a column for every zone number that occurs in any car."""
    zones = sorted(r["zoneid"] for r in probabilities.select("zoneid").distinct().collect())  # zone numbers, not zones of cars
    probabilities.groupBy("out_id", "r_key").pivot("zoneid", zones).agg(F.first("p")).write.parquet(path)
    return path


def _positions(run: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(r_key, predict_lat, predict_lon) of a run in either form.

    Of probabilities the greatest counts, the lowest zone of equal ones, and its position is the zone's first address; a trip without any
    has null positions, as has one whose zone isn't in ``dictionary``.
    """
    if "predict_lat" in run.columns:
        return run.select("r_key", "predict_lat", "predict_lon")
    zones = [c for c in run.columns if c not in ("out_id", "r_key")]
    if not zones:
        return run.select("r_key", *[F.lit(None).cast("double").alias(c) for c in ("predict_lat", "predict_lon")])
    long = run.unpivot(["out_id", "r_key"], zones, "zoneid", "p")
    long = long.withColumn("zoneid", F.when(F.col("p").isNotNull(), F.col("zoneid").cast("bigint")))
    return ensemble.stacked_position(models.predicted_zone(long), dictionary).select("r_key", "predict_lat", "predict_lon")


def read_any_form(spark: SparkSession, paths: Mapping[str, str], dictionary: DataFrame) -> DataFrame:
    """``model, r_key, predict_lat, predict_lon`` of the runs stored under ``paths``, by name, each in the form that its columns tell."""
    out = None
    for name, path in paths.items():
        one = _positions(spark.read.parquet(path), dictionary).select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out
