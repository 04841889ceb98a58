"""A set of query vectors against all rows, block by block.

Rows are dealt to blocks by a hash of their id and every block is packed into one row of bytes; blocks of queries meet all
blocks of rows. A task holds one block of each kind, so its memory is bounded by the block sizes, and no popular vector, code or
bucket can gather in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.session import materialise

ROW_BLOCK = 8192
QUERY_BLOCK = 8192


def usable(table: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v) of the rows that can take part: an id, and a vector of the table's most common length (the longer of
    equally common ones) whose components are finite and not all zero."""
    v = F.col(vector).cast("array<double>")
    limit = F.lit(float("inf"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    rows = table.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0.0)
    )
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (lengths["n"] if lengths else 0))


@dataclass
class Blocks:
    """Packed blocks, numbered from 0 to ``count - 1``; a number may have no rows."""

    table: DataFrame
    count: int


def packed(rows: DataFrame, size: int) -> Blocks:
    """Blocks of about ``size`` rows of (vec_id, v): the ids in rising order and their vectors."""
    count = max(1, -(-rows.count() // size))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        ids, vectors = frame["vec_id"].to_numpy(np.int64), np.array(frame["v"].tolist(), np.float64)
        return pd.DataFrame({"block": frame["block"].iloc[:1].to_numpy(), "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})

    dealt = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias("block"))
    return Blocks(materialise(dealt.groupBy("block").applyInPandas(pack, "block long, ids binary, vectors binary"), "blocks"), count)


FOUND = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("near", T.DoubleType())]
)

#: Of query ids and vectors, row ids and vectors: for each query that has any, its position, its best rows' positions and their ``near``.
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def searched(queries: Blocks, rows: Blocks, search: Search, k: int) -> DataFrame:
    """(query_id, rank, vec_id, near): the ``k`` rows of smallest ``near`` of each query, ties to smaller vec_id.

    ``search`` finds at least the ``k`` best of one block for each query of one block.
    """
    q = queries.table.select(F.col("block").alias("q_block"), "ids", "vectors", F.explode(F.sequence(F.lit(0), F.lit(rows.count - 1))).alias("block"))
    r = rows.table.select("block", "ids", "vectors", F.explode(F.sequence(F.lit(0), F.lit(queries.count - 1))).alias("q_block"))
    q, r = (x.select(F.col("q_block").cast("long"), F.col("block").cast("long"), "ids", "vectors") for x in (q, r))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "near": np.empty(0)})
        (q_ids, q_v), (ids, v) = (_unpacked(x) for x in (left, right))
        found = list(search(q_ids, q_v, ids, v))
        return pd.DataFrame(
            {
                "query_id": np.repeat(q_ids[[f[0] for f in found]], [len(f[1]) for f in found]),
                "vec_id": ids[np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])],
                "near": np.concatenate([f[2] for f in found] or [np.empty(0)]).astype(float),
            }
        )

    pairs = q.groupBy("q_block", "block").cogroup(r.groupBy("q_block", "block")).applyInPandas(run, FOUND)
    best = Window.partitionBy("query_id").orderBy("near", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "near")


def _unpacked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(frame["ids"].iloc[0], np.int64)
    return ids, np.frombuffer(frame["vectors"].iloc[0], np.float64).reshape(len(ids), -1)


class SubstringIndex:
    """Tables of the substrings of 64-bit codes: for every substring value, the codes that have it."""

    def __init__(self, codes: np.ndarray, substrings: int):
        self.codes, self.substrings, self.bits = codes, substrings, 64 // substrings
        self.values = np.arange(1 << self.bits, dtype=np.uint64)
        self.tables = []
        for s in range(substrings):
            part = self.part(codes, s)
            order = np.argsort(part, kind="stable")
            self.tables.append((order, np.searchsorted(part[order], np.arange((1 << self.bits) + 1))))
        weights = np.bitwise_count(self.values)
        self.masks = [np.flatnonzero(weights == w) for w in range(self.bits + 1)]

    def part(self, codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(self.bits * s)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def probe(self, code: np.uint64, s: int, weight: int) -> np.ndarray:
        """Positions of the codes whose substring ``s`` differs from that of ``code`` in exactly ``weight`` bits."""
        order, starts = self.tables[s]
        at = self.part(code, s) ^ self.masks[weight]
        low, n = starts[at], starts[at + 1] - starts[at]
        low, n = low[n > 0], n[n > 0]
        return order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def distance(self, code: np.uint64, positions: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.codes[positions] ^ code).astype(np.int64)
