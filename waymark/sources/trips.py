"""Trip tables: CSV and Parquet readers, the CSV writer, and trips derived from an event stream table.

A trip row is ``r_key, out_id, start_time, end_time, start_lat_e5, start_lon_e5, end_lat_e5, end_lon_e5``.
Coordinates are integers in 1e-5 degrees, so joins on a place compare exactly. Unlabelled trips have null ends.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import skew
from waymark.session import application_dir

LABELLED_CSV = T.StructType(
    [
        T.StructField("r_key", T.StringType()),
        T.StructField("out_id", T.StringType()),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("start_lat", T.DecimalType(9, 5)),
        T.StructField("start_lon", T.DecimalType(9, 5)),
        T.StructField("end_lat", T.DecimalType(9, 5)),
        T.StructField("end_lon", T.DecimalType(9, 5)),
    ]
)
UNLABELLED_COLUMNS = ("r_key", "out_id", "start_time", "start_lat", "start_lon")
UNLABELLED_CSV = T.StructType([field for field in LABELLED_CSV if field.name in UNLABELLED_COLUMNS])

TRIP_COLUMNS = (
    "r_key",
    "out_id",
    "start_time",
    "end_time",
    "start_lat_e5",
    "start_lon_e5",
    "end_lat_e5",
    "end_lon_e5",
)
POINTS = ("start_lat", "start_lon", "end_lat", "end_lon")


def _to_e5(df: DataFrame) -> DataFrame:
    ends = [] if "end_time" in df.columns else ["end_time", "end_lat", "end_lon"]
    for name in ends:
        df = df.withColumn(name, F.lit(None).cast(LABELLED_CSV[name].dataType))
    return df.select(
        "r_key",
        "out_id",
        "start_time",
        "end_time",
        *[F.rint(F.col(name) * 100_000).cast("bigint").alias(f"{name}_e5") for name in POINTS],
    )


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    return _to_e5(spark.read.schema(LABELLED_CSV).option("header", True).option("enforceSchema", False).csv(path))


def read_unlabelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Trips without ends; the same columns as labelled trips, with null ends."""
    return _to_e5(spark.read.schema(UNLABELLED_CSV).option("header", True).option("enforceSchema", False).csv(path))


def write_unlabelled_csv(trips: DataFrame, path: str) -> str:
    """Write trips without their ends, the form ``read_unlabelled_csv`` reads back."""
    at = {f"start_{c}": (F.col(f"start_{c}_e5").cast("decimal(12,0)") / 100_000).cast("decimal(9,5)").alias(f"start_{c}") for c in ("lat", "lon")}
    writer = trips.select(*[at.get(c, F.col(c)) for c in UNLABELLED_CSV.names]).write
    writer.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return path


def write_csv(trips: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Write trips as CSV with decimal degrees, the form ``read_labelled_csv`` reads back."""
    flat = trips.select(
        *[c for c in trips.columns if not c.endswith("_e5")],
        *[(F.col(f"{name}_e5").cast("decimal(12,0)") / 100_000).cast("decimal(9,5)").alias(name) for name in POINTS],
    )
    order = [*LABELLED_CSV.names, *[c for c in flat.columns if c not in LABELLED_CSV.names]]
    writer = flat.select(*order).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)
    return path


def minute_chunk(ts: str) -> Column:
    """Minutes since 1970, an order-preserving division of time for ordered scans over hot cars."""
    return F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


def trips_from_events(events: DataFrame) -> DataFrame:
    """Trips of one car per user: each trip starts where the user's previous one ended."""
    base = events.select(
        "event_id",
        "user_id",
        "ts",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        F.rint(F.col("value") * 100).cast("int").alias("cents"),
        (F.lit(3) + (F.col("user_id") * 7) % 45).alias("n"),
    )
    habit = F.floor(F.hour("ts") / 8) + F.when(F.weekday("ts") >= 5, 3).otherwise(0)
    anchored = base.withColumn(
        "anchor", F.when(F.col("k") < 70, habit % F.col("n")).otherwise((F.col("k") * 13 + F.col("cents")) % F.col("n"))
    )
    places = anchored.select(
        F.col("event_id").alias("r_key"),
        F.col("user_id").alias("out_id"),
        F.col("ts").alias("start_time"),
        F.timestamp_add("SECOND", 60 + F.col("cents") % 7200, F.col("ts")).alias("end_time"),
        (
            F.lit(3_000_000)
            + (F.col("user_id") % 50) * 2000
            + (F.col("anchor") % 7) * 1500
            + (F.col("cents") % 3) * 150
        ).alias("end_lat_e5"),
        (
            F.lit(11_400_000)
            + (F.col("user_id") % 40) * 2500
            + F.floor(F.col("anchor") / 7) * 2000
            + (F.col("cents") % 4) * 200
        ).alias("end_lon_e5"),
    )
    chained = skew.with_previous(
        places, ["out_id"], ["start_time", "r_key"], [minute_chunk("start_time")], ["end_lat_e5", "end_lon_e5"]
    )
    return (
        chained.where(F.col("_prev").isNotNull())
        .withColumn("start_lat_e5", F.col("_prev.end_lat_e5"))
        .withColumn("start_lon_e5", F.col("_prev.end_lon_e5"))
        .select(*TRIP_COLUMNS)
    )


def derived_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trips_from_events`` over a data folder, written once per application as the input table of all queries."""
    path = f"{application_dir(spark)}/trips-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    trips = trips_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):  # a failed write leaves the folder without it
        trips.write.mode("overwrite").parquet(path)
    return spark.read.schema(trips.schema).parquet(path)
