"""Zones: the noisy end points of a car gathered into a small set of places.

Every function takes ``keys``, the columns that name a car. A parameter sweep adds a run column to them and so
builds the zones of all runs in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import skew
from waymark.functions import geo
from waymark.operators.nearest import nearest
from waymark.session import materialise

CAR = ("out_id",)

# First zone id, bounds in metres of a threshold derived from a car's mean distance,
# the value below which a threshold is a divisor of that mean, and the offset of zones without traffic.
FIRST_ZONE = 100
LEAST_GAP = 500
GREATEST_GAP = 5000
DIVISOR_BELOW = 100
UNRANKED = 9000

# Cars with more zones than this are merged in rounds over all tasks instead of one ordered fold per car.
FOLD_ZONES = 1000


def car_addresses(trips: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Distinct end points of each car."""
    return trips.select(*keys, F.col("end_lat_e5").alias("lat_e5"), F.col("end_lon_e5").alias("lon_e5")).distinct()


def car_thresholds(profile: DataFrame, threshold) -> DataFrame:
    """Threshold in metres per car. A number from 100 is taken as it is; a smaller one divides the mean distance."""
    if threshold >= DIVISOR_BELOW:
        metres = F.lit(int(threshold)).cast("bigint")
    else:
        metres = F.greatest(
            F.lit(LEAST_GAP), F.least(F.lit(GREATEST_GAP), F.floor(F.col("distance_mean") / F.lit(threshold)))
        ).cast("bigint")
    return profile.withColumn("threshold", metres)


def with_threshold(addresses: DataFrame, threshold, keys: Sequence[str] = CAR) -> DataFrame:
    """Threshold column from a number of metres or from a table of thresholds per car."""
    if isinstance(threshold, DataFrame):
        return addresses.join(threshold.select(*keys, "threshold"), list(keys), "inner")
    return addresses.withColumn("threshold", F.lit(int(threshold)).cast("bigint"))


def _gap(prev: str) -> Column:
    return geo.metres_e5(f"{prev}.lat_e5", f"{prev}.lon_e5", "lat_e5", "lon_e5")


def _lat_chunk() -> Column:
    return F.floor(F.col("lat_e5") / 64)


def address_gaps(addresses: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Metres from the previous address of the car in (lat, lon) order, null on the first."""
    scan = skew.with_previous(
        addresses, keys, ["lat_e5", "lon_e5"], [_lat_chunk()], ["lat_e5", "lon_e5"]
    )
    return scan.withColumn("distance_gap", _gap("_prev")).drop("_prev")


def address_zones(addresses: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Zone of each address: the first of a car is 100, each gap above the threshold begins the next zone.

    Addresses need a ``threshold``. Gaps inside a chunk are counted there; whether a chunk begins a new zone, and the
    number of zones before it, come from one summary row per chunk.
    """
    keys = list(keys)
    chunked = skew.with_chunks(addresses, keys, [_lat_chunk()])
    inner = Window.partitionBy(*keys, "_c0").orderBy("lat_e5", "lon_e5")
    here = F.struct("lat_e5", "lon_e5")
    breaks = chunked.withColumn("_prev", F.lag(here).over(inner)).withColumn(
        "_break", F.coalesce((_gap("_prev") > F.col("threshold")).cast("bigint"), F.lit(0))
    )
    chunks = breaks.groupBy(*keys, "_c0").agg(
        F.min(here).alias("_first"), F.max(here).alias("_last"), F.sum("_break").alias("_breaks"), F.first("threshold").alias("threshold")
    )
    across = Window.partitionBy(*keys).orderBy("_c0")
    carried = (
        chunks.withColumn("_carry", F.lag("_last").over(across))
        .withColumn(
            "_joint",
            F.coalesce(
                (
                    geo.metres_e5("_carry.lat_e5", "_carry.lon_e5", "_first.lat_e5", "_first.lon_e5") > F.col("threshold")
                ).cast("bigint"),
                F.lit(0),
            ),
        )
        .select(
            *keys,
            "_c0",
            (F.sum(F.col("_joint") + F.col("_breaks")).over(across) - F.col("_breaks")).alias("_before"),
        )
    )
    running = F.sum("_break").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return (
        breaks.withColumn("_run", running)
        .join(carried, [*keys, "_c0"])
        .withColumn("zoneid", F.lit(FIRST_ZONE) + F.col("_before") + F.col("_run"))
        .drop("_c0", "_prev", "_break", "_run", "_before")
    )


def zone_means(zones: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """One row per zone with its centre: the plain mean of its distinct addresses, in degrees."""
    count = F.count("*")
    return zones.groupBy(*keys, "zoneid").agg(
        ((F.sum("lat_e5") / count) / F.lit(1e5)).alias("center_lat"),
        ((F.sum("lon_e5") / count) / F.lit(1e5)).alias("center_lon"),
    )


def zone_centers(zones: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Addresses with their zone's centre and the whole metres to it."""
    plain = zones.drop("center_lat", "center_lon", "distance_2_center")
    return plain.join(zone_means(zones, keys), [*keys, "zoneid"], "left").withColumn(
        "distance_2_center",
        geo.metres(F.col("center_lat"), F.col("center_lon"), geo.degrees("lat_e5"), geo.degrees("lon_e5")),
    )


def _centres(zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zone means with the threshold, which is constant per car."""
    count = F.count("*")
    return zones.groupBy(*keys, "zoneid").agg(
        ((F.sum("lat_e5") / count) / F.lit(1e5)).alias("center_lat"),
        ((F.sum("lon_e5") / count) / F.lit(1e5)).alias("center_lon"),
        F.first("threshold").alias("threshold"),
    )


def _within(earlier: str, later: str, threshold: Column) -> Column:
    """Two centres are within reach: longitude band first, then whole metres."""
    gap = F.rint(F.abs(F.col(f"{earlier}.center_lon") - F.col(f"{later}.center_lon")) * F.lit(1e5))
    away = geo.metres(
        F.col(f"{earlier}.center_lat"),
        F.col(f"{earlier}.center_lon"),
        F.col(f"{later}.center_lat"),
        F.col(f"{later}.center_lon"),
    )
    return (gap <= 2 * threshold) & (away <= threshold)


# Degrees of latitude and of longitude that always cover one metre of threshold: a metre is at most 1/110000 degree of
# latitude; the longitude band is 2e-5 degree per metre plus half a unit of its fifth decimal.
LAT_REACH = 1e-5
LON_REACH = 2e-5


def _cell(center: str, reach: float) -> Column:
    return F.floor(F.col(center) / (F.col("threshold") * F.lit(reach) + F.lit(1e-5)))


def _with_cells(centres: DataFrame) -> DataFrame:
    return centres.withColumn("_cy", _cell("center_lat", LAT_REACH)).withColumn("_cx", _cell("center_lon", LON_REACH))


def _around(df: DataFrame) -> DataFrame:
    """Each row once for its own cell and once for each of the eight around it."""
    steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    return (
        df.withColumn("_dy", F.explode(steps))
        .withColumn("_dx", F.explode(steps))
        .withColumn("_cy", F.col("_cy") + F.col("_dy"))
        .withColumn("_cx", F.col("_cx") + F.col("_dx"))
        .drop("_dy", "_dx")
    )


ORDER = ("center_lon", "center_lat", "zoneid")


def _pairs(centres: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centres ``a`` before ``b`` of one car within reach of each other, met only through a grid as wide as the reach."""
    cells = _with_cells(centres)
    place = F.struct(*ORDER)
    earlier = _around(cells.select(*keys, place.alias("a"), "_cy", "_cx"))
    later = cells.select(*keys, place.alias("b"), "threshold", "_cy", "_cx")
    return later.join(earlier, [*keys, "_cy", "_cx"]).where(
        (F.col("a") < F.col("b")) & _within("a", "b", F.col("threshold"))
    )


def _metres_between(a: str, b: str) -> Column:
    return geo.metres(
        F.col(f"{a}.center_lat"), F.col(f"{a}.center_lon"), F.col(f"{b}.center_lat"), F.col(f"{b}.center_lon")
    )


def zone_merge_pairs(zones: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Pairs of zone centres of a car within reach of each other, the earlier in (lon, lat) order first."""
    return _pairs(_centres(zones, keys), keys).select(
        *keys,
        F.col("a.zoneid").alias("zoneid"),
        F.col("b.zoneid").alias("zoneid_near"),
        _metres_between("a", "b").alias("distance"),
    )


def _fold(centres: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moves of cars with few zones: walk the ordered zones once, holding the kept ones.

    The arrays hold at most ``FOLD_ZONES`` zones of one car. Each zone brings the earlier zones in its reach in order, so
    the first of them that was kept is its target.
    """
    keys = list(keys)
    earlier = (
        _pairs(centres, keys)
        .groupBy(*keys, F.col("b.zoneid").alias("zoneid"))
        .agg(F.transform(F.array_sort(F.collect_list("a")), lambda z: z.zoneid).alias("earlier"))
    )
    none = F.array().cast("array<bigint>")
    zone = F.struct(*ORDER, F.coalesce("earlier", none).alias("earlier"))
    ordered = (
        centres.join(earlier, [*keys, "zoneid"], "left")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(zone)).alias("zones"))
    )

    def step(state: Column, z: Column) -> Column:
        target = F.get(F.array_intersect(z.earlier, state.kept), F.lit(0))
        move = F.struct(z.zoneid.alias("zoneid"), target.alias("zoneid_new"))
        return F.struct(
            F.when(target.isNull(), F.array_append(state.kept, z.zoneid)).otherwise(state.kept).alias("kept"),
            F.when(target.isNull(), state.moves).otherwise(F.array_append(state.moves, move)).alias("moves"),
        )

    start = F.struct(
        none.alias("kept"), F.array().cast("array<struct<zoneid:bigint,zoneid_new:bigint>>").alias("moves")
    )
    return ordered.select(*keys, F.explode(F.aggregate("zones", start, step).moves).alias("m")).select(*keys, "m.*")


def _rounds(centres: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moves of cars with many zones: repeated rounds over a grid, each spread over all tasks.

    In a round an open zone is kept when no open zone before it lies in the nine cells around it; open zones in reach
    of an earlier kept zone are closed. Only the first open zone of a cell can be kept, so each round compares cells,
    never all pairs. The first open zone of a car is always kept, so the rounds end. Every zone is then given the first
    kept zone in its reach. Each round is written to the shared folder.
    """
    keys = list(keys)
    cell = [*keys, "_cy", "_cx"]
    everything = materialise(_with_cells(centres).select(*cell, "threshold", F.struct(*ORDER).alias("z")), "merge-zones")
    open_zones, kept = everything, None
    while not open_zones.isEmpty():
        firsts = open_zones.groupBy(*cell).agg(F.min("z").alias("z"), F.first("threshold").alias("threshold"))
        nearby = _around(firsts.select(*cell, F.col("z").alias("other"))).groupBy(*cell).agg(F.min("other").alias("_least"))
        fresh = firsts.join(nearby, cell).where(F.col("z") <= F.col("_least")).select(*cell, "threshold", "z")
        fresh = materialise(fresh, "merge-kept")
        kept = fresh if kept is None else kept.unionByName(fresh)
        reach = _around(fresh.select(*cell, F.col("z").alias("k")))
        closed = (
            open_zones.join(reach, cell)
            .where((F.col("k") <= F.col("z")) & ((F.col("k") == F.col("z")) | _within("k", "z", F.col("threshold"))))
            .select(*keys, F.col("z.zoneid").alias("_id"))
            .distinct()
        )
        ids = open_zones.withColumn("_id", F.col("z.zoneid"))
        open_zones = materialise(ids.join(closed, [*keys, "_id"], "left_anti").drop("_id"), "merge-open")
    reach = _around(kept.select(*cell, F.col("z").alias("k")))
    return (
        everything.join(reach, cell)
        .where((F.col("k") < F.col("z")) & _within("k", "z", F.col("threshold")))
        .groupBy(*keys, F.col("z.zoneid").alias("zoneid"))
        .agg(F.min("k").alias("k"))
        .select(*keys, "zoneid", F.col("k.zoneid").alias("zoneid_new"))
    )


def _moves(centres: DataFrame, keys: Sequence[str], fold_zones: int | None = None) -> DataFrame:
    """``zoneid -> zoneid_new`` of every zone absorbed by an earlier one, written once.

    In (lon, lat) order of the centres, a zone within reach of a kept earlier zone is absorbed by the first such zone;
    any other zone is kept.
    """
    limit = FOLD_ZONES if fold_zones is None else fold_zones
    keys = list(keys)
    many = centres.groupBy(*keys).count().where(F.col("count") > limit)
    if many.isEmpty():
        return materialise(_fold(centres, keys), "merge-moves")
    marked = centres.join(many.select(*keys, F.lit(True).alias("_many")), keys, "left")
    few = marked.where(F.col("_many").isNull()).drop("_many")
    return materialise(
        _fold(few, keys).unionByName(_rounds(marked.where("_many").drop("_many"), keys)), "merge-moves"
    )


def zone_merge_map(zones: DataFrame, keys: Sequence[str] = CAR, fold_zones: int | None = None) -> DataFrame:
    """Zones absorbed by an earlier one: ``zoneid -> zoneid_new`` with the metres between their centres."""
    keys = list(keys)
    centres = _centres(zones, keys)
    out = _moves(centres, keys, fold_zones)
    place = F.struct("center_lat", "center_lon")
    for name, side in (("zoneid", "_z"), ("zoneid_new", "_k")):
        out = out.join(centres.select(*keys, F.col("zoneid").alias(name), place.alias(side)), [*keys, name])
    return out.select(*keys, "zoneid", "zoneid_new", _metres_between("_k", "_z").alias("cur_dis"))


def zones_merged(zones: DataFrame, keys: Sequence[str] = CAR, fold_zones: int | None = None) -> DataFrame:
    """Apply the merge map and recentre; the zone before merging stays as ``zoneid_raw``."""
    moved = zones.join(_moves(_centres(zones, keys), keys, fold_zones), [*keys, "zoneid"], "left")
    renamed = moved.withColumn("zoneid_raw", F.col("zoneid")).withColumn(
        "zoneid", F.coalesce("zoneid_new", "zoneid")
    )
    return zone_centers(renamed.drop("zoneid_new"), keys)


def build_zones(trips: DataFrame, threshold=500, keys: Sequence[str] = CAR) -> DataFrame:
    """Addresses of all cars with their merged zones: the front half of the zone dictionary.

    The address table is written once; the merge and everything after it read that table.
    """
    addresses = with_threshold(car_addresses(trips, keys), threshold, keys)
    return zones_merged(materialise(address_zones(addresses, keys), "address-zones"), keys)


def address_traffic(trips: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Departures and arrivals per car and point, counted before any join."""
    point = F.explode(
        F.array(
            F.struct(
                F.col("start_lat_e5").alias("lat_e5"),
                F.col("start_lon_e5").alias("lon_e5"),
                F.lit(1).alias("out"),
                F.lit(0).alias("in"),
            ),
            F.struct(
                F.col("end_lat_e5").alias("lat_e5"),
                F.col("end_lon_e5").alias("lon_e5"),
                F.lit(0).alias("out"),
                F.lit(1).alias("in"),
            ),
        )
    ).alias("p")
    return (
        trips.select(*keys, point)
        .select(*keys, "p.*")
        .groupBy(*keys, "lat_e5", "lon_e5")
        .agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    )


def zone_in_out(zones: DataFrame, trips: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Departures and arrivals per zone; trips whose point is no address of the car are left out."""
    place = zones.select(*keys, "lat_e5", "lon_e5", "zoneid")
    return (
        address_traffic(trips, keys)
        .join(place, [*keys, "lat_e5", "lon_e5"])
        .groupBy(*keys, "zoneid")
        .agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
        .withColumn("in_out", F.col("in") + F.col("out"))
    )


def zone_shares(traffic: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Totals per car and the share of each zone; null where the total is 0."""
    totals = traffic.groupBy(*keys).agg(*[F.sum(c).alias(f"{c}_total") for c in ("in", "out", "in_out")])
    joined = traffic.join(totals, list(keys), "inner")
    return joined.select(
        "*", *[F.try_divide(F.col(c), F.col(f"{c}_total")).alias(f"{c}_per") for c in ("in", "out", "in_out")]
    )


def _rank_chunk() -> list[Column]:
    return [-F.col("in_out"), F.floor(F.col("zoneid") / 4096)]


def zone_rank(traffic: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Rank ``sn`` of each zone of a car by traffic, 0 first; equal traffic by zone id."""
    ranked = skew.with_position(traffic, keys, [F.desc("in_out"), F.col("zoneid")], _rank_chunk())
    return ranked.withColumn("sn", F.col("pos") - 1).drop("pos", "total")


def zone_drop_ratio(traffic: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Traffic of a zone relative to the zone ranked before it, 1 for the first."""
    minus = traffic.withColumn("_minus", -F.col("in_out"))
    scan = skew.with_previous(minus, keys, ["_minus", "zoneid"], _rank_chunk(), ["in_out"])
    ratio = F.coalesce(F.try_divide(F.col("in_out"), F.col("_prev.in_out")), F.lit(1.0))
    return scan.withColumn("drop_percent", ratio).drop("_minus", "_prev")


DICTIONARY_COLUMNS = (
    "lat_e5",
    "lon_e5",
    "zoneid",
    "sn",
    "center_lat",
    "center_lon",
    "distance_2_center",
    "out",
    "in",
    "in_out",
    "in_total",
    "out_total",
    "in_out_total",
    "in_per",
    "out_per",
    "in_out_per",
)


def zone_dictionary(trips: DataFrame, threshold=500, keys: Sequence[str] = CAR) -> DataFrame:
    """Every end point of every car with its zone, the zone's centre, traffic, shares and rank."""
    zones = build_zones(trips, threshold, keys)
    frequency = zone_rank(zone_shares(zone_in_out(zones, trips, keys), keys), keys)
    return zones.join(frequency, [*keys, "zoneid"], "left").select(*keys, *DICTIONARY_COLUMNS)


def _side(dictionary: DataFrame, side: str, keys: Sequence[str]) -> DataFrame:
    return dictionary.select(
        *keys,
        F.col("lat_e5").alias(f"{side}_lat_e5"),
        F.col("lon_e5").alias(f"{side}_lon_e5"),
        F.col("center_lat").alias(f"{side}_lat_adj"),
        F.col("center_lon").alias(f"{side}_lon_adj"),
        F.col("zoneid").alias(f"{side}_zoneid"),
        F.col("sn").alias(f"{side}_sn"),
    )


def snap_trips(trips: DataFrame, dictionary: DataFrame, keys: Sequence[str] = CAR, sides=("start", "end")) -> DataFrame:
    """Zone, centre and rank of the start and end of each trip; points that are no address keep nulls.

    A place that holds much of the data is divided by the adaptive skew join: the trips are the left side.
    """
    for side in sides:
        trips = trips.join(_side(dictionary, side, keys), [*keys, f"{side}_lat_e5", f"{side}_lon_e5"], "left")
    return trips


def zone_center_list(dictionary: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """One row per zone with its centre, rank and traffic."""
    columns = ("center_lat", "center_lon", "sn", "in_out")
    return dictionary.groupBy(*keys, "zoneid").agg(*[F.first(c).alias(c) for c in columns])


def center_gaps(dictionary: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Whole metres from each zone centre to the one before it in (lon, lat) order of the car."""
    centres = zone_center_list(dictionary, keys)
    chunk = [F.floor(F.col("center_lon") * 1000)]
    scan = skew.with_previous(centres, keys, list(ORDER), chunk, ["center_lat", "center_lon"])
    return scan.select(
        *keys,
        "zoneid",
        geo.metres(
            F.col("_prev.center_lat"), F.col("_prev.center_lon"), F.col("center_lat"), F.col("center_lon")
        ).alias("distance_gap"),
    )


def zone_distances(wanted: DataFrame, dictionary: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Whole metres between the centres of the wanted pairs ``zoneid_a, zoneid_b`` of a car."""
    centres = zone_center_list(dictionary, keys)
    out = wanted
    for side in ("a", "b"):
        one = centres.select(
            *keys,
            F.col("zoneid").alias(f"zoneid_{side}"),
            F.col("center_lat").alias(f"_lat_{side}"),
            F.col("center_lon").alias(f"_lon_{side}"),
        )
        out = out.join(one, [*keys, f"zoneid_{side}"], "inner")
    return out.select(
        *keys,
        "zoneid_a",
        "zoneid_b",
        geo.metres(F.col("_lat_a"), F.col("_lon_a"), F.col("_lat_b"), F.col("_lon_b")).alias("distance"),
    )


def zones_knn_reduced(dictionary: DataFrame, threshold: int = 2, least_zones: int = 50) -> DataFrame:
    """In cars with many zones, addresses of rarely used zones move to the zone of the nearest address of a kept zone.

    A zone is kept from ``threshold`` departures and arrivals. Distance is squared 1e-5 degrees; equal distances go to
    the address first in (lat, lon) order.
    """
    zones = dictionary.groupBy("out_id").agg(F.countDistinct("zoneid").alias("_zones"))
    marked = dictionary.join(zones, ["out_id"], "inner").withColumn(
        "_rare", (F.col("_zones") >= least_zones) & (F.coalesce("in_out", F.lit(0)) < threshold)
    )
    marked = materialise(marked.select("out_id", "lat_e5", "lon_e5", "zoneid", "_zones", "_rare"), "knn-zones")
    # (lat, lon) packed into one number orders addresses and names them inside a car
    packed = (F.col("lat_e5") + 9_000_000) * F.lit(2**26) + (F.col("lon_e5") + 18_000_000)
    spot = F.array(F.col("lat_e5"), F.col("lon_e5"))
    rare = marked.where("_rare").select("out_id", packed.alias("q_id"), spot.alias("x"))
    kept = marked.where(~F.col("_rare") & (F.col("_zones") >= least_zones)).select(
        "out_id", packed.alias("p_id"), spot.alias("x"), F.col("zoneid").alias("label")
    )
    moved = nearest(rare, kept, ["out_id"], dims=2, k=1, power=2).select(
        "out_id", F.col("q_id").alias("_id"), F.col("label").alias("zoneid_new")
    )
    joined = marked.withColumn("_id", packed).join(moved, ["out_id", "_id"], "left")
    return zone_centers(
        joined.select("out_id", "lat_e5", "lon_e5", F.coalesce("zoneid_new", "zoneid").alias("zoneid"))
    )


def zones_kmeans_reduced(dictionary: DataFrame, centers: int = 5, most_rounds: int = 300) -> DataFrame:
    """In cars with at least ``centers`` zones, cluster the addresses anew around that many centres.

    Starts from the centres of the busiest zones; assigns each address to its nearest centre (by degrees) and averages, until
    no centre moves or ``most_rounds`` are over. Each car's centres are one short array; addresses are never gathered.
    """
    cars = (
        zone_center_list(dictionary)
        .where(F.col("sn") < centers)
        .groupBy("out_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.col("sn").alias("c"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon")))
            ).alias("centres")
        )
        .where(F.size("centres") == centers)
    )
    spots = materialise(dictionary.select("out_id", "lat_e5", "lon_e5", "zoneid", "center_lat", "center_lon"), "kmeans-spots")
    centres = materialise(cars, "kmeans-centres")

    def assigned(centres: DataFrame) -> DataFrame:
        lat, lon = geo.degrees("lat_e5"), geo.degrees("lon_e5")
        ranked = F.transform(
            "centres",
            lambda c: F.struct(
                ((c.lat - lat) * (c.lat - lat) + (c.lon - lon) * (c.lon - lon)).alias("d"),
                c.c.alias("c"),
                c.lat.alias("lat"),
                c.lon.alias("lon"),
            ),
        )
        return spots.join(centres, ["out_id"], "left").withColumn("near", F.array_min(ranked)).drop("centres")

    for _ in range(most_rounds):
        means = (
            assigned(centres)
            .where(F.col("near").isNotNull())
            .groupBy("out_id", F.col("near.c").alias("c"))
            .agg(
                (F.sum("lat_e5") / F.count("*") / F.lit(1e5)).alias("lat"),
                (F.sum("lon_e5") / F.count("*") / F.lit(1e5)).alias("lon"),
            )
        )
        # a centre no address chose stays where it was
        before = centres.select("out_id", F.explode("centres").alias("o")).select("out_id", "o.*")
        updated = before.join(
            means.select("out_id", "c", F.col("lat").alias("new_lat"), F.col("lon").alias("new_lon")), ["out_id", "c"], "left"
        ).groupBy("out_id").agg(
            F.array_sort(
                F.collect_list(
                    F.struct("c", F.coalesce("new_lat", "lat").alias("lat"), F.coalesce("new_lon", "lon").alias("lon"))
                )
            ).alias("centres")
        )
        updated = materialise(updated, "kmeans-centres")
        moved = updated.join(centres.withColumnRenamed("centres", "old"), "out_id").where(F.col("centres") != F.col("old"))
        centres = updated
        if moved.isEmpty():
            break
    return assigned(centres).select(
        "out_id",
        "lat_e5",
        "lon_e5",
        F.coalesce(F.col("near.c"), F.col("zoneid")).alias("zoneid"),
        F.coalesce(F.col("near.lat"), F.col("center_lat")).alias("center_lat"),
        F.coalesce(F.col("near.lon"), F.col("center_lon")).alias("center_lon"),
    )


def zones_renumbered(dictionary: DataFrame) -> DataFrame:
    """Zone ids replaced by their traffic rank; zones without a rank become 9000 + id."""
    return dictionary.withColumn("zoneid", F.coalesce("sn", F.col("zoneid") + UNRANKED))


def zones_visit_centered(snapped: DataFrame, keys: Sequence[str] = CAR) -> DataFrame:
    """Trips with their end zone's centre moved to the mean end point over visits."""
    count = F.count("*")
    means = snapped.groupBy(*keys, "end_zoneid").agg(
        ((F.sum("end_lat_e5") / count) / F.lit(1e5)).alias("end_lat_adj"),
        ((F.sum("end_lon_e5") / count) / F.lit(1e5)).alias("end_lon_adj"),
    )
    return snapped.drop("end_lat_adj", "end_lon_adj").join(means, [*keys, "end_zoneid"], "left")


def car_top_centers(dictionary: DataFrame, top: int = 4, keys: Sequence[str] = CAR) -> DataFrame:
    """Centres of the zones ranked 0..top of each car, one row per car: ``center_lat_0 .. center_lon_top``."""
    ranked = zone_center_list(dictionary, keys).where(F.col("sn") <= top)
    return ranked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("sn") == i, F.col("center_lat"))).alias(f"center_lat_{i}") for i in range(top + 1)],
        *[F.max(F.when(F.col("sn") == i, F.col("center_lon"))).alias(f"center_lon_{i}") for i in range(top + 1)],
    )


def center_distances(snapped: DataFrame, top_centers: DataFrame, top: int = 4, keys: Sequence[str] = CAR) -> DataFrame:
    """Whole metres from the start of a trip to each of the car's top centres, ``dis_center_0 .. dis_center_{top-1}``.

    The start is its zone's centre, or the point itself outside all zones. A centre the car does not have takes the
    value of the one before.
    """
    lat = F.coalesce(F.col("start_lat_adj"), geo.degrees("start_lat_e5"))
    lon = F.coalesce(F.col("start_lon_adj"), geo.degrees("start_lon_e5"))
    joined = snapped.join(top_centers, list(keys), "left")
    plain = [geo.metres(lat, lon, F.col(f"center_lat_{i}"), F.col(f"center_lon_{i}")) for i in range(top)]
    measured = joined.select("*", *[p.alias(f"_dis{i}") for i, p in enumerate(plain)])
    filled = [
        F.coalesce(*[F.col(f"_dis{j}") for j in range(i, -1, -1)]).alias(f"dis_center_{i}") for i in range(top)
    ]
    return measured.select(*snapped.columns, *filled)
