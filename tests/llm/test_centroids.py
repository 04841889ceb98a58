import hashlib

import duckdb
import numpy as np
import pytest

from waymark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(vectors, k, rounds, seed):
    """Clustering with whole-number arithmetic, vector by vector."""
    kept = [(i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v in vectors]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in kept[:k]]

    def nearest(v):
        far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in middle]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        parts = [[] for _ in middle]
        for _, v in kept:
            parts[nearest(v)[0]].append(v)
        middle = [[sum(x) // len(p) for x in zip(*p)] if p else c for p, c in zip(parts, middle)]
    return sorted(((i, *nearest(v)) for i, v in kept), key=str), middle


def rows(n, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=64) * scale).astype(np.float32).tolist()) for i in range(n)]


def run(spark, vectors, **options):
    table = spark.createDataFrame([(i, v, "mine") for i, v in vectors], SCHEMA)
    found, middle = centroids.cluster(table, **options)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str), middle.tolist(), found


@pytest.mark.parametrize("scale", [0.001, 1.0, 1000.0])
def test_equals_plain_arithmetic(spark, scale):
    vectors = rows(60, scale=scale)
    got, middle, found = run(spark, vectors, k=7, rounds=3, seed=2)
    want, want_middle = plain(vectors, 7, 3, 2)
    assert got == want and middle == want_middle
    one = found.first()
    assert one.inertia == sum(r[2] for r in want)
    assert one.cluster_inertia == sum(r[2] for r in want if r[1] == one.cluster)


def test_planes_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 27), 1 << 27, (50, 64))
    x[0], x[1] = -(1 << 27) + 1, (1 << 27) - 1
    words = centroids.pack(x, 28)
    assert (centroids.unpack(words) == x).all()
    assert (centroids.products(words, words[:5]) == x @ x[:5].T).all()
    assert (centroids.squares(words) == (x * x).sum(axis=1)).all()


def test_hard_rows(spark):
    good = rows(5, seed=3)
    bad = [(10, None), (11, good[0][1][:63]), (12, [float("nan")] + good[0][1][1:]), (13, [None] + good[0][1][1:]), (14, [float("-inf")] * 64), (15, [])]
    hard = good + bad + [(None, good[1][1]), (2, good[3][1]), (2, good[3][1]), (7, [0.0] * 64), (8, [-0.0] * 64)]
    kept = [r for r in hard if r not in bad]
    got, middle, _ = run(spark, hard, k=4, rounds=2, seed=2)
    assert (got, middle) == plain(kept, 4, 2, 2)


def test_more_clusters_than_vectors_and_ties(spark):
    vectors = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [3.0] * 64)]
    got, middle, _ = run(spark, vectors, k=40, rounds=5, seed=2)
    assert (got, middle) == plain(vectors, 40, 5, 2)


def test_empty_table(spark):
    table = spark.createDataFrame([(1, None, "mine")], SCHEMA)
    found, middle = centroids.cluster(table)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"] and not found.count() and not len(middle)


def test_too_large_components_raise(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, [1e30] * 64)], k=1)


def test_equals_sql(spark, sf):
    got = sorted(map(tuple, centroids.op12_clusters(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as from '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(centroids.OP12_SQL).fetchall())
