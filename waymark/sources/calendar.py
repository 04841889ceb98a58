"""Holiday calendars: a small dimension table ``(date, code)``, '0' workday, '1' weekend, '2' holiday."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def calendar(spark: SparkSession, first: str, last: str, holidays=(), worked=()) -> DataFrame:
    """One row per day from ``first`` to ``last``: the weekend rule with holiday ranges and worked weekends on top."""
    day = F.col("date")
    is_holiday = F.lit(False)
    for start, end in holidays:
        is_holiday = is_holiday | day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    is_worked = F.lit(False)
    for date in worked:
        is_worked = is_worked | (day == F.lit(date).cast("date"))
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date")
    )
    return days.select(
        "date",
        F.when(is_holiday, "2").when(is_worked, "0").when(F.weekday(day) >= 5, "1").otherwise("0").alias("code"),
    )
