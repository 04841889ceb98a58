"""Cohorts of cars, holdouts and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import skew
from waymark.functions import geo
from waymark.operators import enrich
from waymark.sources.trips import minute_chunk

# Right-closed edges of the geohash cohorts, and the zone threshold in metres used for each cohort.
GEO_EDGES = (0, 20, 40, 60, 80, 100, 900)
COHORT_THRESHOLDS = (200, 300, 400, 450, 550, 450)


def bucket(value: Column, edges: Sequence) -> Column:
    """Index of the right-closed interval of ``edges`` that holds ``value``, -1 outside."""
    ladder = F.when(value <= edges[0], -1)
    for i, edge in enumerate(edges[1:]):
        ladder = ladder.when(value <= edge, i)
    return ladder.otherwise(-1).cast("bigint")


def geo_bucket(cells: Column) -> Column:
    return bucket(cells, GEO_EDGES)


def cohort_geo(trips: DataFrame) -> DataFrame:
    """Cohort of each car by its number of distinct 6-digit end cells."""
    cells = enrich.with_geo_codes(trips).select("out_id", geo.coarser(F.col("end_code"), 6).alias("cell"))
    counts = cells.groupBy("out_id").agg(F.countDistinct("cell").alias("cells"))
    return counts.withColumn("cohort", geo_bucket(F.col("cells")))


def cohort_quantile(snapped: DataFrame, groups: int = 5) -> DataFrame:
    """Cohort of each car by quantiles of its number of distinct end zones; equal numbers share a cohort.

    Equal neighbouring edges make one interval. The exact percentile keeps one counter per distinct number of zones,
    and the edges are one row.
    """
    zones = snapped.groupBy("out_id").agg(F.countDistinct("end_zoneid").alias("zones"))
    shares = F.array(*[F.lit(i / groups) for i in range(1, groups)])
    edges = zones.agg(F.percentile("zones", shares)).scalar()
    below = F.array_distinct(F.filter(F.col("_edges"), lambda e: e < F.col("zones")))
    return (
        zones.withColumn("_edges", edges).withColumn("cohort", F.size(below).cast("bigint")).drop("_edges")
    )


def with_cohort(trips: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Trips with their car's cohort, ready for ``write.partitionBy("cohort")`` in one pass."""
    return trips.join(cohorts.select("out_id", "cohort"), ["out_id"], "inner")


def holdout_latest(trips: DataFrame, parts: int = 5) -> DataFrame:
    """``holdout`` = 1 on the latest ``count div parts`` trips of each car; later first, equal times by ``r_key``."""
    ranked = skew.with_position(
        trips, ["out_id"], [F.col("start_time"), F.desc("r_key")], [minute_chunk("start_time")]
    )
    return ranked.withColumn(
        "holdout", (F.col("total") - F.col("pos") < F.floor(F.col("total") / parts)).cast("bigint")
    ).drop("pos", "total")


def _numeric(trips: DataFrame) -> bool:
    return trips.schema["r_key"].dataType.typeName() in ("long", "integer")


def holdout_first_rows(trips: DataFrame, parts: int = 5) -> DataFrame:
    """``holdout`` = 1 on the first ``count div parts`` trips of each car in file (``r_key``) order."""
    chunk = F.floor(F.col("r_key") / 65536) if _numeric(trips) else F.substring("r_key", 1, 12)
    ranked = skew.with_position(trips, ["out_id"], ["r_key"], [chunk], cold=0 if _numeric(trips) else "")
    return ranked.withColumn("holdout", (F.col("pos") <= F.floor(F.col("total") / parts)).cast("bigint")).drop("pos", "total")


def holdout_earliest(trips: DataFrame, parts: int = 5) -> DataFrame:
    """``validate`` = 0 on the earliest ``(parts - 1) / parts`` of each car's trips, 1 on the rest; one part trains on all."""
    if parts == 1:
        return trips.withColumn("validate", F.lit(0).cast("bigint"))
    ranked = skew.with_position(trips, ["out_id"], ["start_time", "r_key"], [minute_chunk("start_time")])
    cut = F.floor(F.col("total") * (parts - 1) / parts)
    return ranked.withColumn("validate", (F.col("pos") > cut).cast("bigint")).drop("pos", "total")


def labelled_and_targets(trips: DataFrame, parts: int = 5) -> tuple[DataFrame, DataFrame]:
    """Split by ``holdout_latest``: the older trips, and the latest ones that play the part of trips to predict."""
    split = holdout_latest(trips, parts)
    return split.where("holdout = 0").drop("holdout"), split.where("holdout = 1").drop("holdout")


def sample_cars(trips: DataFrame, n: int, always: DataFrame | None = None, seed: int = 777) -> DataFrame:
    """``n`` cars in the order of a seeded hash, plus cars that are always wanted."""
    cars = trips.select("out_id").distinct()
    chosen = cars.orderBy(F.xxhash64("out_id", F.lit(seed)), "out_id").limit(n)
    return chosen if always is None else chosen.union(always.select("out_id")).distinct()


def worst_cars(best: DataFrame, counts: DataFrame, score: float = 0.6, least: int = 5) -> DataFrame:
    """Cars whose best loss over all models is still ``score`` or more and that have enough trips, worst first."""
    return (
        best.join(counts, "out_id", "left")
        .where((F.col("loss") >= score) & (F.col("count") >= least))
        .orderBy(F.desc("loss"), F.desc("count"), "out_id")
    )
