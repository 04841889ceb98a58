"""Approximate nearest neighbours by inner product: multi-index hashing over learned rotated binary codes.

Vectors get one more component that makes all lengths equal, so that the largest inner product becomes the smallest
angle; they are centred, turned to their principal axes and then by the rotation that best fits the corners of the cube
(iterated sign and orthogonal fit), and the signs of the result are the code. A code is cut into substrings, each with a table.
A query takes every code within a Hamming radius: two codes within radius R agree to within R // substrings bits in one
substring at least, so probing all tables with that radius misses none. What is found is ranked by the original vectors.

The rotation and the radius are learned on a bounded sample; all rows are indexed. The radius is the one within which
``AIM`` of the sample's own nearest neighbours lie, and grows for a query that finds too few.

Defined results: as in ``hamming``; an inner product is computed in double precision, component by component in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.blocks import QUERY_BLOCK, ROW_BLOCK, SubstringIndex, packed, searched, usable
from waymark.session import materialise

SUBSTRINGS = 8
K = 20
SAMPLE_ROWS = 4096
SAMPLE_QUERIES = 256
AIM = 0.98
ROTATION_ROUNDS = 30


@dataclass
class Coder:
    """What turns vectors to codes, and the radius to search."""

    length: float
    centre: np.ndarray
    axes: np.ndarray
    radius: int

    def codes(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        extra = 0.0 if query else np.sqrt(np.maximum(0.0, self.length**2 - (vectors**2).sum(axis=1)))
        turned = (vectors - self.centre[:-1]) @ self.axes[:-1] + np.multiply.outer(extra - self.centre[-1], self.axes[-1])
        signs = np.zeros((len(vectors), 64), np.uint8)
        signs[:, : turned.shape[1]] = turned > 0
        return np.packbits(signs, axis=1).view(np.uint64).ravel()


def learn(sample: np.ndarray, length: float, k: int = K) -> Coder:
    """The coder of sampled vectors (rows); ``length`` is the greatest length of all vectors."""
    full = np.column_stack([sample, np.sqrt(np.maximum(0.0, length**2 - (sample**2).sum(axis=1)))])
    centre = full.mean(axis=0)
    spread, axes = np.linalg.eigh((full - centre).T @ (full - centre))
    axes = axes[:, np.argsort(-spread, kind="stable")[:64]]
    placed = (full - centre) @ axes
    rotation = np.linalg.qr(np.random.default_rng(0).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(ROTATION_ROUNDS):
        corners = np.where(placed @ rotation > 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(placed.T @ corners)
        rotation = u @ vt
    coder = Coder(length, centre, axes @ rotation, 64)
    asked = min(SAMPLE_QUERIES, len(sample))
    k = min(k, len(sample) - 1)
    if k > 0:
        near = sample[:asked] @ sample.T
        near[np.arange(asked), np.arange(asked)] = -np.inf
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        away = np.bitwise_count(coder.codes(sample[:asked], query=True)[:, None] ^ coder.codes(sample)[best])
        coder.radius = int(np.quantile(away, AIM, method="higher"))
    return coder


def within_radius(index: SubstringIndex, code: np.uint64, radius: int) -> np.ndarray:
    """Positions of all codes within ``radius`` of ``code``."""
    met = np.zeros(len(index.codes), bool)
    for s in range(index.substrings):
        for weight in range(radius // index.substrings + 1):
            met[index.probe(code, s, weight)] = True
    positions = np.flatnonzero(met)
    return positions[index.distance(code, positions) <= radius]


def _search(coder: Coder, k: int):
    def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        index = SubstringIndex(coder.codes(v), SUBSTRINGS)
        for i, code in enumerate(coder.codes(q, query=True)):
            wanted = min(k, int((ids != q_ids[i]).sum()))
            radius = coder.radius
            while len(found := (at := within_radius(index, code, radius))[ids[at] != q_ids[i]]) < wanted:
                radius += 2
            if wanted:
                score = (v[found] * q[i]).sum(axis=1)  # row by row, so equal vectors get equal scores
                best = np.lexsort((found, -score))[:k]
                yield i, found[best], -score[best]

    return search


def nearest(table: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): of the rows of ``table``, those of largest inner product with each row of ``queries``."""
    rows = materialise(usable(table), "vectors")
    asked = rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").dropDuplicates(["vec_id"])
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    length = rows.agg(F.max(F.sqrt(square))).first()[0]
    sample = rows.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id", "v").limit(SAMPLE_ROWS).select("v").toArrow().column("v").to_pylist()
    if not sample:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    coder = learn(np.array(sample, float), length, k)
    found = searched(packed(asked, QUERY_BLOCK), packed(rows, ROW_BLOCK), _search(coder, k), k)
    return found.select("query_id", "rank", "vec_id", (-F.col("near")).alias("score"))


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(table, table.where(F.col("vec_id") % 20 == 0))
