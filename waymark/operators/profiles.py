"""Profiles of cars, cells and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import cohorts, enrich


def car_distance_profile(trips: DataFrame, keys=("out_id",)) -> DataFrame:
    """Least, greatest and mean distance per car in whole metres, from trips with ``distance``."""
    return trips.groupBy(*keys).agg(
        F.min("distance").alias("distance_min"),
        F.max("distance").alias("distance_max"),
        F.rint(F.sum("distance") / F.count("distance")).cast("bigint").alias("distance_mean"),
    )


def attach_profile(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Profile columns on any table with cars; cars without a profile keep nulls."""
    return rows.join(profile, ["out_id"], "left")


def score_cars(targets: DataFrame) -> DataFrame:
    """Cars to score with their number of trips, busiest first."""
    return targets.groupBy("out_id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "out_id")


def only_cars(trips: DataFrame, cars: DataFrame) -> DataFrame:
    """Trips of the listed cars."""
    return trips.join(cars.select("out_id").distinct(), ["out_id"], "left_semi")


def car_geo_footprint(trips: DataFrame, sides=("start", "end")) -> DataFrame:
    """Distinct geohash cells per car at six precisions and the number of trips.

    Trips are reduced to distinct 9-digit cells per car before the distinct counts fan out.
    """
    coded = enrich.with_geo_codes(trips)
    result = coded.groupBy("out_id").agg(F.count("*").alias("count"))
    for side in sides:
        suffix = "_end" if side == "end" else ""
        cells = coded.select("out_id", F.col(f"{side}_code").alias("code")).distinct()
        counts = cells.groupBy("out_id").agg(
            *[F.countDistinct(geo.coarser(F.col("code"), p)).alias(f"geo{p}{suffix}") for p in geo.GEOHASH_PRECISIONS]
        )
        result = result.join(counts, "out_id")
    if "end" in sides:
        result = result.withColumn("gp", cohorts.geo_bucket(F.col("geo6_end")))
    return result


def footprints_side_by_side(labelled: DataFrame, unlabelled: DataFrame) -> DataFrame:
    """Footprints of both tables, aligned on the car; a car missing on one side has nulls there."""
    left = car_geo_footprint(labelled)
    right = car_geo_footprint(unlabelled, sides=("start",))
    left = left.select("out_id", *[F.col(c).alias(f"train_{c}") for c in left.columns if c != "out_id"])
    right = right.select("out_id", *[F.col(c).alias(f"test_{c}") for c in right.columns if c != "out_id"])
    return left.join(right, "out_id", "full")


def rare_geo_cells(trips: DataFrame) -> DataFrame:
    """4-digit end cells reached once by one car."""
    cells = enrich.with_geo_codes(trips).select(
        geo.geohash_text(F.col("end_code"), 4).alias("geo4_end"), "out_id"
    )
    return (
        cells.groupBy("geo4_end")
        .agg(F.min("out_id").alias("_first"), F.max("out_id").alias("_last"), F.count("*").alias("trips"))
        .where((F.col("_first") == F.col("_last")) & (F.col("trips") <= 1))
        .select("geo4_end", F.lit(1).cast("bigint").alias("cars"), "trips")
    )


def end_zone_profile(snapped: DataFrame) -> DataFrame:
    """First and last visit and number of visits of each end zone of a car."""
    return snapped.groupBy("out_id", "end_zoneid").agg(
        F.min("start_time").alias("first_visit"),
        F.max("start_time").alias("last_visit"),
        F.count("*").alias("visits"),
    )


def attach_end_zone_profile(snapped: DataFrame) -> DataFrame:
    return snapped.join(end_zone_profile(snapped), ["out_id", "end_zoneid"], "left")


START_ZONE_MEASURES = ("duration_s", "distance", "end_sn")


def start_zone_profile(snapped: DataFrame) -> DataFrame:
    """What trips from a start zone look like: spread of duration, distance and end rank, and its end zones.

    ``duration_s`` is in whole seconds, which keeps sums exact.
    """
    aggs = []
    for name in START_ZONE_MEASURES:
        aggs += [
            F.min(name).alias(f"sz_{name}_min"),
            F.max(name).alias(f"sz_{name}_max"),
            (F.sum(name) / F.count(name)).alias(f"sz_{name}_mean"),
            F.sum(name).alias(f"sz_{name}_sum"),
        ]
    return (
        snapped.where(F.col("start_zoneid").isNotNull())
        .groupBy("out_id", "start_zoneid")
        .agg(
            *aggs,
            F.countDistinct("end_zoneid").alias("sz_end_zoneid_nunique"),
            F.count("end_zoneid").alias("sz_end_zoneid_count"),
            F.max("start_sn").alias("sz_start_sn_max"),
        )
    )


def attach_start_zone_profile(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Join the profile to trips; a trip from an unknown zone takes the column's mean over all joined trips.

    The means are one row, read as a scalar subquery.
    """
    measures = [c for c in profile.columns if c.startswith("sz_")]
    joined = rows.join(profile, ["out_id", "start_zoneid"], "left")
    means = joined.agg(F.struct(*[(F.sum(c).cast("double") / F.count(c)).alias(c) for c in measures]).alias("m")).scalar()
    keep = [c for c in joined.columns if c not in measures]
    return joined.withColumn("_means", means).select(
        *keep, *[F.coalesce(F.col(c).cast("double"), F.col(f"_means.{c}")).alias(c) for c in measures]
    )
