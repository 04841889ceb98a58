"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into four substrings, each with a table of its own. A query probes the tables with growing
radius, one substring after the other: after radius ``a`` in substrings 0 to ``s`` and ``a - 1`` in the rest, every code
not yet met differs in more than ``4 a + s`` bits. It stops when its k-th best verified distance is within that bound.

Defined results: rows with a null id or an unusable vector (see ``blocks.usable``) neither ask nor answer; a query with fewer
candidates gets them all; equal distances go to the smaller vec_id; rows with the query's own id are no candidates; repeated rows
count one by one; an empty table gives an empty table; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.blocks import QUERY_BLOCK, ROW_BLOCK, SubstringIndex, packed, searched, usable
from waymark.session import materialise

SUBSTRINGS = 4
K = 10


def sign_codes(vectors: np.ndarray) -> np.ndarray:
    """One bit for each of the first 64 components, 1 where it is positive; missing components give 0."""
    signs = np.zeros((len(vectors), 64), np.uint8)
    signs[:, : min(64, vectors.shape[1])] = vectors[:, :64] > 0
    return np.packbits(signs, axis=1).view(np.uint64).ravel()


def nearest_codes(index: SubstringIndex, code: np.uint64, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of at least the ``k`` nearest of the ``allowed`` codes (all, if fewer)."""
    wanted = min(k, int(allowed.sum()))
    met = ~allowed
    positions, distances = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    within = np.zeros(65, np.int64)
    for radius in range(index.bits + 1):
        for s in range(index.substrings):
            fresh = index.probe(code, s, radius)
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            positions.append(fresh)
            distances.append(index.distance(code, fresh))
            within += np.bincount(distances[-1], minlength=65)
            if within[: index.substrings * radius + s + 1].sum() >= wanted:
                found, away = np.concatenate(positions), np.concatenate(distances)
                # positions are in order of vec_id, so a stable order by distance settles ties
                best = np.lexsort((found, away))[:k]
                return found[best], away[best]
    raise AssertionError("every code is met at the full radius")


def _search(k: int):
    def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        index = SubstringIndex(sign_codes(v), SUBSTRINGS)
        for i, code in enumerate(sign_codes(q)):
            allowed = ids != q_ids[i]
            if allowed.any():
                yield i, *nearest_codes(index, code, allowed, k)

    return search


def top_k(table: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, distance): the ``k`` rows of ``table`` nearest to each row of ``queries``, both (vec_id, embedding)."""
    rows = materialise(usable(table), "vectors")
    asked = rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").dropDuplicates(["vec_id"])
    found = searched(packed(asked, QUERY_BLOCK), packed(rows, ROW_BLOCK), _search(k), k)
    return found.select("query_id", "rank", "vec_id", F.col("near").cast("int").alias("distance"))


def op3_hamming(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(table, table.where(F.col("vec_id") % 100 == 0))


OP3_SQL = """
with e as (select vec_id, embedding from embeddings where vec_id is not null and embedding is not null),
d as (select q.vec_id query_id, r.vec_id,
             cast(list_sum(list_transform(range(1, 65), lambda i: case when (q.embedding[i] > 0) <> (r.embedding[i] > 0) then 1 else 0 end)) as int) distance
      from e q join e r on q.vec_id % 100 = 0 and q.vec_id <> r.vec_id)
select query_id, cast(row_number() over (partition by query_id order by distance, vec_id) as int) as rank, vec_id, distance
from d qualify row_number() over (partition by query_id order by distance, vec_id) <= 10
"""
