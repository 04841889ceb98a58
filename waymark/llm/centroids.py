"""Centroid clustering by bit planes.

A vector's 64 components are whole numbers in two's complement. Bit p of all of them is one 64-bit word, its plane p, so a vector is as
many words as its numbers have bits. The product of two vectors is the sum over pairs of planes of ``weight * popcount(plane AND plane)``,
where the weights are powers of two and the top plane's is negative; distances follow from it as ``x.x - 2 x.c + c.c``. All of it is exact.

Vectors are packed once into a written table. A round sends the centroids (at most ``k`` times 64 numbers) to all tasks; each task gives one row
of counts and sums per cluster, combined before the shuffle, and at most ``k`` rows come back. A cluster that holds most vectors is still
one row per task.

Defined results: vectors that are null, have another length, or hold a null or non-finite component take no part and have no row; equal
distances go to the smaller cluster number; rows with one vec_id are vectors of their own (for the start in the order of their components); a
null vec_id is hashed as empty text; with fewer vectors than clusters there are as many clusters as vectors; an empty cluster keeps its
centroid and has no row; an empty table gives an empty table; components whose whole number passes ``LARGEST`` raise an error, as their
distances might not fit in 64 bits; columns other than vec_id and embedding play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.session import materialise

COMPONENTS = 64
SCALE = 256
LARGEST = (1 << 27) - 1
#: Vectors worked on at once in a Python worker.
BLOCK = 2048


def weights(planes: int) -> np.ndarray:
    """Of each plane, lowest first: powers of two, the sign's negative."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def pack(numbers: np.ndarray, planes: int) -> np.ndarray:
    """(vectors, planes) words of a (vectors, 64) matrix of whole numbers."""
    bits = (numbers[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[..., 0]


def unpack(words: np.ndarray) -> np.ndarray:
    """The (vectors, 64) matrix of numbers back."""
    planes = words.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), planes, 8), axis=2, bitorder="little")
    return np.einsum("npj,p->nj", bits, weights(planes))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Every vector of ``x`` times every one of ``y``, both as planes."""
    out = np.zeros((len(x), len(y)), np.int64)
    w = weights(x.shape[1])
    for p, w_p in enumerate(w):
        for q, w_q in enumerate(w):
            out += np.bitwise_count(x[:, p, None] & y[None, :, q]) * (w_p * w_q)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    """Every vector of ``x``, as planes, times itself."""
    w = weights(x.shape[1])
    return sum(np.bitwise_count(x[:, p] & x[:, q]) * (w[p] * w[q]) for p in range(len(w)) for q in range(len(w)))


@dataclass
class Packed:
    """``table`` (vec_id, words) of ``planes`` words a vector, and its first centroids."""

    table: DataFrame
    planes: int
    start: np.ndarray


def _whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = vectors.where((F.size("embedding") == COMPONENTS) & finite)
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("x"))


def _hash(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def packed(vectors: DataFrame, k: int, seed: int) -> Packed:
    """Vectors as bit planes in a written table."""
    whole = _whole(vectors)
    bounds = whole.agg(F.max(F.array_max("x")).alias("high"), F.min(F.array_min("x")).alias("low")).first()
    largest = max(abs(bounds["high"] or 0), abs(bounds["low"] or 0))
    if largest > LARGEST:
        raise ValueError(f"a component times {SCALE} is {largest}, more than {LARGEST}")
    planes = int(largest).bit_length() + 1
    schema = T.StructType([whole.schema["vec_id"], T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(at, BLOCK)
                words = pack(batch.column("x").flatten().to_numpy().reshape(-1, COMPONENTS), planes)
                made = pa.array([w.tobytes() for w in words], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), made], schema.names)

    first = whole.orderBy(_hash(seed), "x").limit(k).collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(-1, COMPONENTS)
    return Packed(materialise(whole.mapInArrow(run, schema), "bit-planes"), planes, start)


def _words(batch: pa.RecordBatch, planes: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("words").to_pylist()), "<u8").reshape(-1, planes)


def _nearest(words: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every vector, the first of equal ones, and its squared distance."""
    far = squares(words)[:, None] - 2 * products(words, centroids) + squares(centroids)[None, :]
    nearest = far.argmin(axis=1)
    return nearest, far[np.arange(len(words)), nearest]


def moved(vectors: Packed, centroids: np.ndarray) -> np.ndarray:
    """Every centroid as the mean, rounded down, of the vectors nearest to it."""
    planes, sent, k = vectors.planes, pack(centroids, vectors.planes), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, COMPONENTS), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                words = _words(whole.slice(at, BLOCK), planes)
                nearest, _ = _nearest(words, sent)
                order = np.argsort(nearest, kind="stable")
                found, starts = np.unique(nearest[order], return_index=True)
                count += np.bincount(nearest, minlength=k)
                sums[found] += np.add.reduceat(unpack(words)[order], starts, axis=0)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array(count[full]), pa.array(list(sums[full]), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
        )

    parts = vectors.table.mapInArrow(run, "cluster int, n long, sums array<long>").groupBy("cluster")
    total = parts.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(COMPONENTS)]).alias("sums")).collect()
    out = centroids.copy()
    for row in total:
        out[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return out


def assigned(vectors: Packed, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    planes, sent = vectors.planes, pack(centroids, vectors.planes)
    schema = T.StructType([vectors.table.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                nearest, far = _nearest(_words(batch, planes), sent)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nearest, pa.int32()), pa.array(far)], schema.names)

    return vectors.table.mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance, cluster_inertia, inertia)`` of the vectors of ``vectors`` (vec_id, embedding), and the centroids.

    Centroids start as the ``k`` vectors with smallest sha256 of ``seed:vec_id`` and move ``rounds`` times.
    """
    planes = packed(vectors, k, seed)
    centroids = planes.start
    if not len(centroids):
        nothing = planes.table.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")])
        return nothing.where(F.lit(False)), centroids
    for _ in range(rounds):
        centroids = moved(planes, centroids)
    found = materialise(assigned(planes, centroids), "clusters")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    each = {r["cluster"]: r["cluster_inertia"] for r in inertia.collect()}  # at most k rows
    own = F.element_at(F.array(*[F.lit(each.get(c, 0)).cast("long") for c in range(len(centroids))]), F.col("cluster") + 1)
    return found.select("*", own.alias("cluster_inertia"), F.lit(sum(each.values())).cast("long").alias("inertia")), centroids


def op12_clusters(spark, sf_dir: str) -> DataFrame:
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()] or [""]
    digest = F.element_at(F.array(*[F.lit(d) for d in digests]), F.col("cluster") + 1)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _op12_sql(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
p{i} as materialized (select rn, c, sum((x.x - c.x) * (x.x - c.x)) far from x join c{i} c using (j) group by rn, c),
a{i} as materialized (select rn, arg_min(c, far * 1000 + c) c, min(far) far from p{i} group by rn)""")
        if i < rounds:
            steps.append(f"""
m{i} as (select c, j, sum(x) s, count(*) n from a{i} join x using (rn) group by c, j),
c{i + 1} as materialized (select c, j, case when n is null then o.x else cast((s - ((s % n) + n) % n) // n as bigint) end x
                          from c{i} o left join m{i} using (c, j))""")
    return f"""
with v as materialized (
  select row_number() over (order by vec_id) rn, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * x::double) as bigint)) v,
         sha256('{seed}:' || coalesce(vec_id::varchar, '')) h
  from embeddings where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda x: isfinite(x))) = {COMPONENTS}),
x as materialized (select rn, unnest(range({COMPONENTS})) j, unnest(v) x from v),
s as (select row_number() over (order by h, v) - 1 c, v from v qualify c < {k}),
c0 as materialized (select c, unnest(range({COMPONENTS})) j, unnest(v) x from s),{",".join(steps)},
d as (select c, sha256(string_agg(x::varchar, ',' order by j)) centroid_sha256 from c{rounds} group by c)
select vec_id, cast(c as integer) as cluster, cast(far as bigint) distance, cast(sum(far) over (partition by c) as bigint) cluster_inertia,
       cast(sum(far) over () as bigint) inertia, centroid_sha256
from a{rounds} join v using (rn) join d using (c)"""


OP12_SQL = _op12_sql()
