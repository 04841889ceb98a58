"""Missing values, text encoding and checks of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import skew


def _finite(name: str) -> Column:
    """The number, or null for NaN and the infinities."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(name))


def impute_missing(
    df: DataFrame, train: Column, numbers: Sequence[str], texts: Sequence[str], fixed: dict[str, str] | None = None
) -> DataFrame:
    """Fill missing values with what the training rows show: the mean of numbers (0 without any), the most frequent text.

    The least of equally frequent texts is taken. ``fixed`` names text columns filled with a given text. Infinite numbers
    count as missing in all rows. Other columns, dates among them, stay as they are.
    """
    fixed = fixed or {}
    rows = df.where(train)
    means = rows.agg(
        F.struct(*[F.coalesce(F.avg(_finite(n).cast("double")), F.lit(0.0)).alias(n) for n in numbers]).alias("m")
    ).scalar()
    filled = df.withColumn("_means", means)
    for text in texts:
        if text in fixed:
            fill = F.lit(fixed[text])
        else:
            counts = rows.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("n"))
            fill = counts.agg(F.min_by(text, F.struct(-F.col("n"), F.col(text)))).scalar()
        filled = filled.withColumn(text, F.coalesce(F.col(text), fill))
    for number in numbers:
        filled = filled.withColumn(number, F.coalesce(_finite(number).cast("double"), F.col(f"_means.{number}")))
    return filled.drop("_means")


def label_encode(df: DataFrame, texts: Sequence[str], missing: str = "Other") -> DataFrame:
    """Texts replaced by their index among the sorted distinct texts, nulls as ``'Other'``."""
    for text in texts:
        df = df.withColumn(text, F.coalesce(F.col(text), F.lit(missing)))
        codes = skew.sorted_codes(df, text).withColumnRenamed("code", "_code")
        df = df.join(codes, [text], "left").withColumn(text, F.col("_code")).drop("_code")
    return df


def _odd(name: str) -> Column:
    c = F.col(name).cast("double")
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def numeric_exceptions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per number column, the rows that are null or NaN and those that are infinite, in one pass."""
    pairs = []
    for name in columns:
        c = F.col(name).cast("double")
        missing = F.sum((c.isNull() | F.isnan(c)).cast("bigint")).alias("missing")
        infinite = F.sum(F.coalesce((F.abs(c) == float("inf")).cast("bigint"), F.lit(0))).alias("infinite")
        pairs.append(F.struct(F.lit(name).alias("column"), missing, infinite))
    return df.agg(F.array(*pairs).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def exception_report(df: DataFrame, index: str, columns: Sequence[str]) -> DataFrame:
    """All offending rows."""
    bad = _odd(columns[0])
    for name in columns[1:]:
        bad = bad | _odd(name)
    return df.where(bad).select(index, *columns)
