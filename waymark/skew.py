"""Joins and ordered scans that stay balanced when one key holds much of the data.

A plain window over one car puts all its rows in one task. The scans below divide the rows of a *hot* key
(more than ``HOT_ROWS`` rows) into order-preserving chunks, work inside each chunk, and carry a one-row
summary per chunk across. Keys that are not hot form a single chunk, so they pay no extra work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import materialise

HOT_ROWS = 1_000_000


def with_chunks(df: DataFrame, keys: Sequence[str], chunk: Sequence[Column], cold=0, hot_rows: int | None = None) -> DataFrame:
    """Add chunk columns ``_c0, _c1, ...``: the given expressions for hot keys, the constant ``cold`` otherwise.

    The broadcast list of hot keys has at most rows / ``HOT_ROWS`` entries.
    Without keys the whole table is one group and always chunked.
    """
    if not keys:
        return df.select("*", *[c.alias(f"_c{i}") for i, c in enumerate(chunk)])
    limit = HOT_ROWS if hot_rows is None else hot_rows
    hot = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys, F.lit(True).alias("_hot"))
    return df.join(F.broadcast(hot), list(keys), "left").select(
        *df.columns, *[F.coalesce(F.when(F.col("_hot"), c), F.lit(cold)).alias(f"_c{i}") for i, c in enumerate(chunk)]
    )


def chunk_names(chunk: Sequence[Column]) -> list[str]:
    return [f"_c{i}" for i in range(len(chunk))]


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Sequence[Column],
    position: str = "pos",
    total: str = "total",
    cold=0,
) -> DataFrame:
    """Rank of each row inside its key (1-based) and the number of rows of the key.

    ``order`` must be unique within a key and ``chunk`` must rise with it.
    """
    keys, names = list(keys), chunk_names(chunk)
    chunked = with_chunks(df, keys, chunk, cold)
    sizes = chunked.groupBy(*keys, *names).agg(F.count("*").alias("_size"))
    before = sizes.select(
        *keys,
        *names,
        (F.sum("_size").over(Window.partitionBy(*keys).orderBy(*names)) - F.col("_size")).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias(total),
    )
    inner = Window.partitionBy(*keys, *names).orderBy(*order)
    return (
        chunked.withColumn(position, F.row_number().over(inner))
        .join(before, [*keys, *names])
        .withColumn(position, F.col(position) + F.col("_before"))
        .drop(*names, "_before")
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Sequence[Column],
    columns: Sequence[str],
    cold=0,
) -> DataFrame:
    """Struct ``_prev`` with ``columns`` of the preceding row of the same key, null on the first row."""
    keys, names = list(keys), chunk_names(chunk)
    chunked = with_chunks(df, keys, chunk, cold)
    tails = chunked.groupBy(*keys, *names).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_tail"))
    carried = tails.select(
        *keys, *names, F.lag("_tail").over(Window.partitionBy(*keys).orderBy(*names)).alias("_carried")
    )
    inner = Window.partitionBy(*keys, *names).orderBy(*order)
    return (
        chunked.withColumn("_prev", F.lag(F.struct(*columns)).over(inner))
        .join(carried, [*keys, *names])
        .withColumn("_prev", F.coalesce("_prev", "_carried"))
        .drop(*names, "_carried")
    )


def sorted_codes(values: DataFrame, column: str) -> DataFrame:
    """0-based index of each distinct non-null text in sorted order, as ``(column, code)``.

    The texts are divided into ranges by what occurs, whatever they begin with. The ranges are written, so that their numbers
    stay the same; each counts on from the sum of those before, one row per range.
    """
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = materialise(distinct.repartitionByRange(column).withColumn("_part", F.spark_partition_id()), "sorted-texts")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    return ranged.withColumn("_own", own).join(before, "_part").select(column, (F.col("_before") + F.col("_own") - 1).alias("code"))
