"""Derived columns of trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark import skew
from waymark.functions import calendar as cal
from waymark.functions import geo
from waymark.sources.trips import minute_chunk


def with_distance(trips: DataFrame) -> DataFrame:
    """Whole metres from start to end."""
    return trips.withColumn("distance", geo.metres_e5("start_lat_e5", "start_lon_e5", "end_lat_e5", "end_lon_e5"))


def with_calendar(trips: DataFrame) -> DataFrame:
    ts = F.col("start_time")
    return trips.select(
        "*",
        F.to_date(ts).alias("start_base"),
        F.dayofmonth(ts).cast("bigint").alias("day"),
        F.weekday(ts).cast("bigint").alias("weekday"),
        cal.weekend(ts).alias("weekend"),
        cal.centi_hour(ts).alias("hour_c"),
        cal.hour_of_week(ts).alias("hour_wk"),
    )


def with_holiday(trips: DataFrame, calendar: DataFrame) -> DataFrame:
    """1 on days off, 0 on workdays, from the calendar; dates outside it follow the weekend rule.

    The calendar has one row per date, so its size is bounded by the years it spans.
    """
    day = calendar.select(F.col("date").alias("_date"), "code")
    return (
        trips.withColumn("_date", F.to_date("start_time"))
        .join(F.broadcast(day), "_date", "left")
        .withColumn(
            "holiday",
            F.coalesce((F.col("code") != "0").cast("bigint"), cal.weekend(F.col("start_time"))),
        )
        .drop("_date", "code")
    )


def with_duration(trips: DataFrame) -> DataFrame:
    return trips.withColumn("duration", cal.days_between(F.col("start_time"), F.col("end_time")))


def with_geo_codes(trips: DataFrame) -> DataFrame:
    """45-bit geohash codes of both ends; ``geo.coarser`` gives any lower precision."""
    return trips.select(
        "*",
        geo.geohash_code(F.col("start_lat_e5"), F.col("start_lon_e5")).alias("start_code"),
        geo.geohash_code(F.col("end_lat_e5"), F.col("end_lon_e5")).alias("end_code"),
    )


def with_geohash(trips: DataFrame) -> DataFrame:
    """Geohash cells with 4 to 9 digits of both ends: ``geo4 .. geo9`` and ``geo4_end .. geo9_end``."""
    nine = with_geo_codes(trips).select(
        *trips.columns,
        geo.geohash_text(F.col("start_code")).alias("geo9"),
        geo.geohash_text(F.col("end_code")).alias("geo9_end"),
    )
    shorter = [
        F.substring(f"geo9{side}", 1, p).alias(f"geo{p}{side}") for side in ("", "_end") for p in geo.GEOHASH_PRECISIONS[:-1]
    ]
    return nine.select("*", *shorter)


def geohash_codes(trips: DataFrame) -> DataFrame:
    """Category code of every cell: its index among the sorted distinct cells of the same side and precision.

    Returns ``side, geo9, code4 .. code9``, one row per distinct 9-digit cell. The sorted order of 9-digit cells groups
    those of every shorter prefix, so the index at each precision is a running count of prefix changes.
    The scan is chunked by the 4-digit prefix: at most 32**4 summary rows per side and 32**5 cells per chunk.
    """
    cells = with_geo_codes(trips).select(
        F.explode(
            F.array(
                F.struct(F.lit("start").alias("side"), F.col("start_code").alias("code")),
                F.struct(F.lit("end").alias("side"), F.col("end_code").alias("code")),
            )
        ).alias("c")
    )
    distinct = cells.select("c.*").where(F.col("code").isNotNull()).distinct().withColumn("_chunk", geo.coarser(F.col("code"), 4))
    inner = Window.partitionBy("side", "_chunk").orderBy("code")
    precisions = geo.GEOHASH_PRECISIONS[1:]
    changes = distinct.withColumn("_before", F.lag("code").over(inner)).select(
        "*",
        *[
            F.coalesce((geo.coarser(F.col("code"), p) != geo.coarser(F.col("_before"), p)).cast("bigint"), F.lit(1)).alias(f"_new{p}")
            for p in precisions
        ],
    )
    running = Window.partitionBy("side", "_chunk").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    totals = changes.groupBy("side", "_chunk").agg(*[F.sum(f"_new{p}").alias(f"_sum{p}") for p in precisions])
    over = Window.partitionBy("side").orderBy("_chunk")
    offsets = totals.select(
        "side",
        "_chunk",
        (F.row_number().over(over) - 1).cast("bigint").alias("code4"),
        *[(F.sum(f"_sum{p}").over(over) - F.col(f"_sum{p}")).alias(f"_off{p}") for p in precisions],
    )
    return (
        changes.select("side", "_chunk", "code", *[F.sum(f"_new{p}").over(running).alias(f"_run{p}") for p in precisions])
        .join(offsets, ["side", "_chunk"])
        .select(
            "side",
            geo.geohash_text(F.col("code")).alias("geo9"),
            "code4",
            *[(F.col(f"_off{p}") + F.col(f"_run{p}") - 1).alias(f"code{p}") for p in precisions],
        )
    )


def far_trips(trips: DataFrame, profile: DataFrame) -> DataFrame:
    """``far`` = 1 for trips longer than twice the car's mean distance."""
    joined = trips.join(profile.select("out_id", "distance_mean"), ["out_id"], "left")
    return joined.withColumn("far", (F.col("distance") > 2 * F.col("distance_mean")).cast("bigint"))


def circular_gap(a, b):
    """Share of a day between two hours given in hundredths, the short way round, in whole hundredths."""
    gap = F.abs(a - b)
    return F.rint(F.least(gap, F.lit(2400) - gap) / F.lit(24.0)).cast("bigint")


def departure_time_gaps(trips: DataFrame) -> DataFrame:
    """Circular time-of-day gap between each trip of a car and the one before, as a share of a day."""
    hours = trips.select("r_key", "out_id", "start_time", cal.centi_hour(F.col("start_time")).alias("hour_c"))
    scan = skew.with_previous(hours, ["out_id"], ["start_time", "r_key"], [minute_chunk("start_time")], ["hour_c"])
    return scan.select("r_key", "out_id", (circular_gap(F.col("hour_c"), F.col("_prev.hour_c")) / F.lit(100.0)).alias("time_gap"))


def weekly_trips(trips: DataFrame) -> DataFrame:
    """Trips per car and week serial, with the first day of the week."""
    weeks = trips.withColumn("week_sn", cal.week_serial(F.to_date("start_time")))
    return (
        weeks.groupBy("out_id", "week_sn")
        .agg(F.count("*").alias("trips"))
        .withColumn("week_start", cal.week_start(F.col("week_sn")))
    )


def date_dimension(dates: DataFrame, months_back: int = 2) -> DataFrame:
    """One row per distinct ``date`` with the week, month and text forms used for reporting."""
    d = F.col("date")
    text = F.date_format(d, "yyyy-MM-dd")
    return dates.select("date").distinct().select(
        "date",
        cal.week_serial(d).alias("week_sn"),
        cal.week_start(cal.week_serial(d)).alias("week_start"),
        cal.monday(d).alias("monday"),
        cal.sunday(d).alias("sunday"),
        F.add_months(d, 1).alias("next_month"),
        F.last_day(d).alias("month_end"),
        cal.first_sunday_months_back(d, months_back).alias("shifted_sunday"),
        F.to_date(cal.text_to_timestamp(text)).alias("from_text"),
        F.to_date(cal.text_to_timestamp(F.substring(text, 1, 7))).alias("from_month_text"),
        text.alias("as_text"),
    )
