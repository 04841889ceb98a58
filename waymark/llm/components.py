"""Connected components of a graph by repeated hooking and contraction: a distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b) of longs: root is the smallest node of its component.

    In a round every node hooks to the neighbour of smallest hash, if that is smaller than its own, and to where that
    one hooks; the edges are rewritten to these roots. Hashes keep chains of hooks short whatever the order of ids, so a
    graph shrinks severalfold in a round. All steps are joins and grouped minima; rows of a node are combined
    before each shuffle, and each round's tables are written to the shared folder, so a lost executor costs one step.
    """
    moved = edges.select(_rank("a"), _rank("b"))
    rounds: list[DataFrame] = []
    while True:
        apart = moved.where("a != b")
        live = materialise(apart.union(apart.select("b", "a")).distinct(), "edges")
        if live.isEmpty():
            break
        hooks = materialise(live.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "hooks")
        further = hooks.select(F.col("node").alias("root"), F.col("root").alias("end"))
        rounds.append(materialise(hooks.join(further, "root").select("node", F.col("end").alias("root")), "roots"))
        a = rounds[-1].select(F.col("node").alias("a"), F.col("root").alias("_a"))
        b = rounds[-1].select(F.col("node").alias("b"), F.col("root").alias("_b"))
        moved = live.where("a < b").join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    found = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        to = found.select(F.col("node").alias("root"), F.col("root").alias("end"))
        found = earlier.join(to, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    nodes = edges.select("a").union(edges.select("b")).distinct().where(F.col("a").isNotNull()).select("a", F.xxhash64("a").alias("node"))
    named = materialise(nodes.join(found, "node").select(F.col("a").alias("node"), "root"), "components")
    least = named.groupBy("root").agg(F.min("node").alias("least"))
    return materialise(named.join(least, "root").select("node", F.col("least").alias("root")), "components")


def _rank(column: str):
    """A fixed shuffle of the ids; distinct ids keep distinct hashes, as the hash permutes 64-bit values."""
    return F.xxhash64(column).alias(column)
