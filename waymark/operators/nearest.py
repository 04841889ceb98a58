"""Exact k nearest points within groups.

Groups of up to ``SMALL_PAIRS`` pairs of a query and a point are worked on whole inside tasks: pairs live in arrays there, and only the k nearest come
out, so none is sorted or spilled. Other small groups join their queries and points directly. Groups with more than ``SMALL_POINTS`` points are searched by
descending a grid: at each level a query keeps only the cells that can still hold one of its k nearest points, so it never
meets all points of its group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators import whole
from waymark.session import materialise

SMALL_POINTS = 4096
#: Queries times points of a group that is worked on inside one task.
SMALL_PAIRS = 1_000_000

# Bits dropped from each coordinate at the levels of the grid, coarse to fine. The last level keeps all bits.
LEVELS = (18, 14, 11, 8, 5, 0)


def _power(value: Column, power: int) -> Column:
    out = value
    for _ in range(power - 1):
        out = out * value
    return out


def _sum(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _minkowski(gaps: Sequence[Column], power: int) -> Column:
    """Sum of powers; the root keeps the order, so it is not taken."""
    return _sum([_power(g, power) for g in gaps])


def _scaled(gap: Column, i: int, scaled: bool) -> Column:
    return gap / F.col("scale")[i] if scaled else gap.cast("double")


def _best(pairs: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k nearest of each query; equal distances by point id. Spark limits each group before it sorts."""
    near = Window.partitionBy(*keys, "q_id").orderBy("dist", "p_id")
    return pairs.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def _with_distance(pairs: DataFrame, dims: int, power: int, scaled: bool) -> DataFrame:
    gaps = pairs.select("*", *[_scaled(F.abs(F.col("x")[i] - F.col("px")[i]), i, scaled).alias(f"_g{i}") for i in range(dims)])
    return gaps.withColumn("dist", _minkowski([F.col(f"_g{i}") for i in range(dims)], power))


def _direct(queries: DataFrame, points: DataFrame, keys, dims, k, power, scaled) -> DataFrame:
    pairs = queries.join(points.withColumnRenamed("x", "px"), list(keys))
    return _best(_with_distance(pairs, dims, power, scaled), keys, k).select(*keys, "q_id", "rank", "p_id", "label", "dist")


def _whole_groups(queries: DataFrame, points: DataFrame, keys: list[str], dims: int, k: int, power: int, scaled: bool) -> DataFrame:
    """``_direct`` of groups that fit in a task. Distances that are null come first there, and so here."""
    zeros = F.array_repeat(F.lit(0).cast("bigint"), dims)
    ones = F.array_repeat(F.lit(1.0), dims)

    def rows(df: DataFrame, role: int, key: str, label: Column, scale: Column) -> DataFrame:
        hole = F.exists("x", lambda v: v.isNull()) | F.exists(scale, lambda v: v.isNull())
        spot, size = F.when(hole, zeros).otherwise(F.col("x")).alias("x"), F.when(hole, ones).otherwise(scale).alias("scale")
        return df.select(*keys, F.lit(role).alias("role"), F.col(key).alias("id"), label.alias("label"), spot, size, hole.alias("hole"))

    both = rows(points, 0, "p_id", F.col("label"), ones).unionByName(
        rows(queries, 1, "q_id", F.lit(None).cast(points.schema["label"].dataType), F.col("scale") if scaled else ones)
    )

    def near(x: np.ndarray, scale: np.ndarray, hole: np.ndarray, p: slice, q: slice) -> tuple[np.ndarray, np.ndarray]:
        far = None
        for i in range(dims):
            gap = np.abs(x[q, i][:, None] - x[p, i][None, :])
            gap = gap / scale[q, i][:, None] if scaled else gap.astype(np.float64)
            term = gap
            for _ in range(power - 1):
                term = term * gap
            far = term if far is None else far + term
        far[hole[q][:, None] | hole[p][None, :]] = -1.0
        first = np.argsort(far, axis=1, kind="stable")[:, :k]  # points lie in the order of their ids
        return first, np.take_along_axis(far, first, axis=1)

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        role, hole = (table.column(c).to_numpy() for c in ("role", "hole"))
        x, scale = whole.matrix(table.column("x"), dims), whole.matrix(table.column("scale"), dims, np.float64)
        ask, rank, point, dist = [], [], [], []
        for a, b in zip(starts, np.r_[starts[1:], table.num_rows]):
            middle = a + int(np.searchsorted(role[a:b], 1))
            if a < middle < b:
                first, far = near(x, scale, hole, slice(a, middle), slice(middle, b))
                ask.append(np.repeat(np.arange(middle, b), first.shape[1]))
                rank.append(np.tile(np.arange(1, first.shape[1] + 1, dtype=np.int32), len(first)))
                point.append(a + first.ravel())
                dist.append(far.ravel())
        if ask:
            ask, rank, point, dist = (np.concatenate(v) for v in (ask, rank, point, dist))
            out = table.select([*keys, "id"]).take(pa.array(ask)).rename_columns([*keys, "q_id"])
            found = table.select(["id", "label"]).take(pa.array(point))
            out = out.append_column("rank", pa.array(rank)).append_column("p_id", found.column("id"))
            out = out.append_column("label", found.column("label")).append_column("dist", pa.array(dist, mask=dist < 0))
            yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    schema = both.select(*keys, F.col("id").alias("q_id"), F.lit(0).alias("rank"), F.col("id").alias("p_id"), "label", F.lit(None).cast("double").alias("dist")).schema
    return whole.by_car(both, keys, work, schema, order=["role", "id"])


def _descend(queries: DataFrame, points: DataFrame, keys, dims, k, power, scaled, bits) -> DataFrame:
    keys = list(keys)
    # of equal points only the k with the least ids can be among the nearest
    copies = Window.partitionBy(*keys, "x").orderBy("p_id")
    points = materialise(
        points.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy"), "nearest-points"
    )

    def cell(level: int) -> Column:
        return F.array(*[F.shiftright(F.col("x")[i], min(62, bits[i](level))) for i in range(dims)])

    frontier, parent = queries, None
    for level in LEVELS:
        group = [*keys, "_cell"] if parent is None else [*keys, "_parent", "_cell"]
        tagged = points.withColumn("_cell", cell(level))
        if parent is not None:
            tagged = tagged.withColumn("_parent", cell(parent))
        cells = tagged.groupBy(*group).agg(
            F.count("*").alias("_n"),
            F.array(*[F.min(F.col("x")[i]) for i in range(dims)]).alias("_lo"),
            F.array(*[F.max(F.col("x")[i]) for i in range(dims)]).alias("_hi"),
        )
        if parent is None:
            met = frontier.join(cells, keys, "inner")
        else:
            met = frontier.withColumnRenamed("_cell", "_parent").join(cells, [*keys, "_parent"])
        x = F.col("x")
        low = [F.greatest(F.lit(0), F.col("_lo")[i] - x[i], x[i] - F.col("_hi")[i]) for i in range(dims)]
        high = [F.greatest(F.abs(x[i] - F.col("_lo")[i]), F.abs(x[i] - F.col("_hi")[i])) for i in range(dims)]
        met = met.select(
            "*",
            _minkowski([_scaled(g, i, scaled) for i, g in enumerate(low)], power).alias("_least"),
            _minkowski([_scaled(g, i, scaled) for i, g in enumerate(high)], power).alias("_most"),
        )
        query = Window.partitionBy(*keys, "q_id")
        held = F.sum("_n").over(query.orderBy("_most", "_cell").rowsBetween(Window.unboundedPreceding, 0))
        bounded = met.withColumn("_held", held).withColumn(
            "_bound", F.min(F.when(F.col("_held") >= k, F.col("_most"))).over(query)
        )
        frontier = bounded.where(
            F.col("_bound").isNull() | (F.col("_least") <= F.col("_bound") * (1 + 1e-9))
        ).select(*queries.columns, "_cell")
        parent = level
    leaves = points.withColumn("_cell", cell(LEVELS[-1])).withColumnRenamed("x", "px")
    pairs = frontier.join(leaves, [*keys, "_cell"])
    return _best(_with_distance(pairs, dims, power, scaled), keys, k).select(*keys, "q_id", "rank", "p_id", "label", "dist")


def nearest(
    queries: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    dims: int,
    k: int,
    power: int,
    bits: Sequence | None = None,
    small_points: int | None = None,
) -> DataFrame:
    """The ``k`` nearest points of each query in its group, by the Minkowski distance of ``power``.

    ``queries`` hold ``keys, q_id, x`` and optionally ``scale`` (an array of divisors per coordinate); ``points`` hold
    ``keys, p_id, x, label``; ``x`` is an array of ``dims`` whole numbers. ``bits`` maps a grid level to the bits dropped
    from each coordinate. Returns ``keys, q_id, rank, p_id, label, dist``.
    """
    keys = list(keys)
    limit = SMALL_POINTS if small_points is None else small_points
    scaled = "scale" in queries.columns
    bits = bits or [lambda level: level] * dims
    counted = points.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(queries.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("q")))
    sizes = counted.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where("p > 0 and q > 0")
    kind = F.when(F.col("p") > limit, "large").when(F.col("p") * F.col("q") > SMALL_PAIRS, "direct").otherwise("whole")
    kinds = materialise(sizes.select(*keys, kind.alias("kind")), "nearest-groups")

    def of(wanted: str) -> tuple[DataFrame, DataFrame]:
        groups = kinds.where(F.col("kind") == wanted).select(*keys)
        return queries.join(groups, keys, "left_semi"), points.join(groups, keys, "left_semi")

    found = _whole_groups(*of("whole"), keys, dims, k, power, scaled)
    others = {r[0] for r in kinds.where("kind != 'whole'").select("kind").distinct().collect()}  # at most two
    if "direct" in others:
        found = found.unionByName(_direct(*of("direct"), keys, dims, k, power, scaled))
    if "large" in others:
        found = found.unionByName(_descend(*of("large"), keys, dims, k, power, scaled, bits))
    return found
