"""Model features of trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import enrich
from waymark.session import materialise

BASE = ("weekday", "weekend", "start_lat_e5", "start_lon_e5", "hour_c")


def feature_columns(gp="0") -> list[str]:
    """Names of a feature set: ``0`` base, a number n adds n embedding columns, ``knn`` two centre distances, ``zoneid`` the start zone."""
    gp = str(gp)
    columns = list(BASE)
    if gp.isnumeric():
        columns += [f"geo_rd_c{gp}_{i}" for i in range(int(gp))]
    elif gp == "knn":
        columns += ["dis_center_1", "dis_center_2"]
    elif gp == "zoneid":
        columns += ["start_zoneid"]
    return columns


def trip_features(trips: DataFrame, gp="0") -> DataFrame:
    """Long feature rows ``out_id, r_key, feature, value``."""
    columns = feature_columns(gp)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return trips.select("out_id", "r_key", F.explode(pairs).alias("f")).select("out_id", "r_key", "f.*")


def scaler(train: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of whole-number features per car, from exact sums; a zero deviation becomes 1."""
    sums = train.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        *[F.sum(F.col(c).cast("decimal(20,0)")).alias(f"_s_{c}") for c in columns],
        *[F.sum((F.col(c) * F.col(c)).cast("decimal(20,0)")).alias(f"_q_{c}") for c in columns],
    )
    out = []
    for c in columns:
        spread = F.sqrt((F.col("_n") * F.col(f"_q_{c}") - F.col(f"_s_{c}") * F.col(f"_s_{c}")).cast("double")) / F.col("_n")
        out.append((F.col(f"_s_{c}").cast("double") / F.col("_n")).alias(f"mean_{c}"))
        out.append(F.when(spread == 0, 1.0).otherwise(spread).alias(f"std_{c}"))
    return sums.select(*keys, F.col("_n").alias("n_train"), *out)


def scale_features(rows: DataFrame, fitted: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Features minus mean over deviation, fitted on training rows, for any rows of the same cars."""
    joined = rows.join(fitted, list(keys), "inner")
    kept = [c for c in rows.columns if c not in columns]
    return joined.select(*kept, *[((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).alias(c) for c in columns])


def geo_hour_traffic(labelled: DataFrame, targets: DataFrame, precision: int = 5) -> DataFrame:
    """Trips and distinct cars per geohash cell and hour of week: departures of both tables, arrivals of the labelled."""

    def points(trips: DataFrame, side: str, prefix: str) -> DataFrame:
        code = enrich.with_geo_codes(enrich.with_calendar(trips))
        return code.select(
            "out_id",
            geo.geohash_text(F.col(f"{side}_code"), precision).alias("cell"),
            F.concat(F.lit(prefix), F.col("hour_wk").cast("string")).alias("hour_wk"),
        )

    every = points(targets, "start", "out_").unionByName(points(labelled, "end", "in_")).unionByName(
        points(labelled, "start", "out_")
    )
    # one row per car first, so counting cars needs no second pass over trips
    per_car = every.groupBy("cell", "hour_wk", "out_id").agg(F.count("*").alias("trips"))
    return per_car.groupBy("cell", "hour_wk").agg(F.sum("trips").alias("trips"), F.count("*").alias("cars"))


HOURS = [f"{way}_{h}" for way in ("in", "out") for h in range(168)]


def geo_hour_matrix(traffic: DataFrame) -> DataFrame:
    """One row per cell, one column per direction and hour of week, 0 where there were no trips."""
    return traffic.groupBy("cell").pivot("hour_wk", HOURS).agg(F.first("trips")).fillna(0)


def geo_hour_gram(traffic: DataFrame) -> DataFrame:
    """``hour_a, hour_b, product``: for every two hours (a not after b, as text) the sum over cells of the products of their trips.

    A cell has at most 336 hours; their products are combined inside input partitions, so at most 56,616 rows of each are shuffled.
    """
    entry = F.struct("hour_wk", "trips")
    cells = traffic.where("cell is not null").groupBy("cell").agg(F.collect_list(entry).alias("hours"))
    one = cells.select("hours", F.explode("hours").alias("a"))
    two = one.select("a", F.explode(F.filter("hours", lambda b: b.hour_wk >= F.col("a.hour_wk"))).alias("b"))
    product = F.sum(F.col("a.trips") * F.col("b.trips")).alias("product")
    return two.groupBy(F.col("a.hour_wk").alias("hour_a"), F.col("b.hour_wk").alias("hour_b")).agg(product)


def geo_embedding(traffic: DataFrame, components: int) -> DataFrame:
    """Left singular vectors of the cell by hour table of trips as an embedding of cells, ``geo_rd_c{n}_{i}``.

    The table stays long and distributed. The driver sees the exact products of its 336 columns, takes their eigenvectors and sends them
    back as one number per hour and component; cells become sums of these. What rounding leaves between the vectors is taken
    out by the Cholesky factor of their own products. The sign of a vector makes its entry of greatest magnitude positive (equal ones: that of
    the first cell). Components beyond the rank are 0; rows with a null cell play no part.
    """
    import numpy as np

    spark = traffic.sparkSession
    names = [f"geo_rd_c{components}_{i}" for i in range(components)]
    table = materialise(traffic.where("cell is not null").select("cell", "hour_wk", "trips"), "geo-traffic")
    place = {h: i for i, h in enumerate(HOURS)}
    gram = np.zeros((len(HOURS), len(HOURS)))
    for r in geo_hour_gram(table).collect():  # at most 56,616 rows, however many cells there are
        i, j = place[r.hour_a], place[r.hour_b]
        gram[i, j] = gram[j, i] = r.product
    squares, vectors = np.linalg.eigh(gram)
    squares, vectors = squares[::-1], vectors[:, ::-1]
    rank = min(components, int((squares > squares[0] * 1e-12).sum()))
    loads = vectors[:, :rank] / np.sqrt(squares[:rank])
    if rank == 0:
        return table.select("cell").distinct().select("cell", *[F.lit(0.0).alias(n) for n in names])
    loads = spark.createDataFrame([(h, [float(x) for x in loads[i]]) for h, i in place.items()], "hour_wk string, load array<double>")
    sums = [F.sum(F.col("trips") * F.col("load")[i]).alias(f"y{i}") for i in range(rank)]
    placed = materialise(table.join(F.broadcast(loads), "hour_wk").groupBy("cell").agg(*sums), "geo-placed")
    products = placed.agg(*[F.sum(F.col(f"y{i}") * F.col(f"y{j}")) for i in range(rank) for j in range(rank)]).first()
    turn = np.linalg.inv(np.linalg.cholesky(np.array(products, float).reshape(rank, rank))).T
    mixed = [sum((F.col(f"y{i}") * float(turn[i, k]) for i in range(k + 1)), F.lit(0.0)).alias(f"u{k}") for k in range(rank)]
    turned = placed.select("cell", *mixed)
    top = turned.agg(*[F.min_by(f"u{k}", F.struct(-F.abs(F.col(f"u{k}")), "cell")) for k in range(rank)]).first()
    signed = [(F.col(f"u{k}") * (-1.0 if top[k] < 0 else 1.0)).alias(names[k]) for k in range(rank)]
    return turned.select("cell", *signed, *[F.lit(0.0).alias(n) for n in names[rank:]])


def attach_embedding(trips: DataFrame, embedding: DataFrame, precision: int = 5) -> DataFrame:
    """Embedding of the start cell; cells without one keep nulls. Cells that hold much of the data are salted."""
    cells = enrich.with_geo_codes(trips).withColumn("cell", geo.geohash_text(F.col("start_code"), precision))
    return cells.drop("start_code", "end_code").join(embedding, ["cell"], "left")


def train_near_targets(labelled: DataFrame, targets: DataFrame, precision: int) -> DataFrame:
    """Trips whose start cell is, or touches, a start cell of the car's targets; cars without such trips keep all."""
    bits_x, bits_y = geo.cell_bits(precision)
    x, y = geo.cell_x(F.col("start_lon_e5"), bits_x), geo.cell_y(F.col("start_lat_e5"), bits_y)
    steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    wanted = (
        targets.select("out_id", x.alias("cx"), y.alias("cy"))
        .distinct()
        .withColumn("dx", F.explode(steps))
        .withColumn("dy", F.explode(steps))
        .select("out_id", F.pmod(F.col("cx") + F.col("dx"), F.lit(2**bits_x)).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
        .distinct()
    )
    celled = labelled.withColumn("cx", x).withColumn("cy", y)
    near = celled.join(wanted.withColumn("_near", F.lit(1)), ["out_id", "cx", "cy"], "left").drop("cx", "cy")
    any_near = near.groupBy("out_id").agg(F.max("_near").alias("_any"))
    return (
        near.join(any_near, ["out_id"], "left")
        .where(F.col("_near").isNotNull() | F.col("_any").isNull())
        .drop("_near", "_any")
    )


def train_top_zones(snapped: DataFrame, top: int = 50) -> DataFrame:
    """Trips to the ``top`` most visited end zones of each car; equal counts by zone id.

    Zones are ranked, not trips, and Spark limits each car's zones before it sorts them.
    """
    visits = snapped.groupBy("out_id", "end_zoneid").agg(F.count("*").alias("_visits"))
    busiest = Window.partitionBy("out_id").orderBy(F.desc("_visits"), "end_zoneid")
    kept = visits.withColumn("_rank", F.row_number().over(busiest)).where(F.col("_rank") <= top)
    return snapped.join(kept.select("out_id", "end_zoneid"), ["out_id", "end_zoneid"], "left_semi")
