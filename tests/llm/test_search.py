import numpy as np
import pytest

from waymark.llm import ann, blocks, hamming


def brute_codes(ids, v, asked, k):
    codes = hamming.sign_codes(v)
    out = {}
    for q in asked:
        i = int(np.flatnonzero(ids == q)[0])
        away = np.bitwise_count(codes ^ codes[i]).astype(int)
        out[q] = sorted((int(d), int(x)) for d, x in zip(away, ids) if x != q)[:k]
    return out


def grouped(rows, value):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r[value], r.vec_id))
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    for module in (hamming, ann):
        monkeypatch.setattr(module, "ROW_BLOCK", 60)
        monkeypatch.setattr(module, "QUERY_BLOCK", 7)


def test_codes_equal_brute_force(spark, small_blocks):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(150, 64)), np.tile(rng.normal(size=(1, 64)), (100, 1)), rng.normal(size=(1, 64)) + 0.05 * rng.normal(size=(80, 64))])
    table = spark.createDataFrame([(i, x.tolist(), "mine") for i, x in enumerate(v)], "vec_id long, embedding array<float>, rank string")
    asked = [0, 5, 160, 161, 270, 300]
    for k in (1, 10, 400):
        found = hamming.top_k(table, table.where(f"vec_id in ({','.join(map(str, asked))})"), k)
        assert grouped(found.collect(), "distance") == brute_codes(np.arange(len(v)), v.astype(np.float32), asked, k)


def test_recall_of_neighbours(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
        ids = np.array([r.vec_id for r in rows])
        v = np.array([r.embedding for r in rows], float)
        found = grouped(ann.op8_neighbours(spark, sf).collect(), "score")
        assert sorted(found) == sorted(int(i) for i in ids if i % 20 == 0)
        hits = 0
        for q, got in found.items():
            score = (v * v[ids == q][0]).sum(axis=1)
            best = sorted((-s, i) for s, i in zip(score, ids) if i != q)[:20]
            hits += len({i for _, i in best} & {i for _, i in got})
            assert len(got) == 20 and got == sorted(got, key=lambda t: (-t[0], t[1]))
            assert all(abs(s - score[ids == i][0]) < 1e-12 for s, i in got)
        assert hits / (20 * len(found)) >= 0.93


def test_lengths_that_differ(spark, small_blocks):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 20)) * rng.lognormal(0, 1, (400, 1))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = grouped(ann.nearest(table, table.where("vec_id < 40")).collect(), "score")
    hits = sum(
        len({i for _, i in found[q]} & set(sorted(set(range(400)) - {q}, key=lambda i: -float(v[q] @ v[i]))[:20])) for q in range(40)
    )
    assert hits / 800 >= 0.9


def test_hard_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0])]
    rows += [(8, [-1.0, 0.5]), (8, [-1.0, 0.5]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (20, [0.5, 0.5]), (40, None)]
    table = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, embedding array<double>, score double")
    queries = table.where("vec_id % 20 = 0 or vec_id in (1, 8) or vec_id is null")
    found = grouped(ann.nearest(table, queries).collect(), "score")
    assert found == {
        20: [(0.5, 1), (0.5, 2), (-0.25, 8), (-0.25, 8)],
        1: [(1.0, 2), (0.5, 20), (-1.0, 8), (-1.0, 8)],
        8: [(-0.25, 20), (-1.0, 1), (-1.0, 2)],
    }
    exact = grouped(hamming.top_k(table, queries, 2).collect(), "distance")
    assert exact == {20: [(1, 1), (1, 2)], 1: [(0, 2), (1, 20)], 8: [(1, 20), (2, 1)]}
    nothing = table.limit(0)
    assert ann.nearest(nothing, nothing).count() == 0 and hamming.top_k(nothing, nothing).count() == 0
    assert blocks.usable(table).count() == 5
