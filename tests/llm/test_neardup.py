import numpy as np
from pyspark.sql import Row

from waymark.llm import neardup
from waymark.llm.components import components


def brute(rows, num=85, den=100):
    """Component of every (doc_id, text) by all pairs on sets of word tuples."""
    sets = {}
    for doc, text in rows:
        words = bytes(text or "", "utf-8").lower().split()
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    seen = set()
    for docs in by_shingle.values():
        for i, a in enumerate(docs):
            for b in docs[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_equals_brute_force(spark, sf):
    for folder in (sf, sf.replace("0.001", "0.01")):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        found = neardup.op9_near_duplicates(spark, folder)
        assert as_dict(found) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_hard_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "other")
    texts = [None, "", " \t", "a b", "A  B", "a b c", base, near, base.upper(), "x " * 30000, "x " * 30000 + "y", "é b c d e", "É b c d e"]
    rows = [Row(doc_id=i, text=t, band=1, component_id="x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, band int, component_id string")
    assert as_dict(neardup.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in rows])
    repeated = neardup.near_duplicates(docs.union(docs)).collect()
    assert len(repeated) == 2 * len(texts)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, base), (5, base)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(nameless).collect()} == {(None, None), (5, 5)}


def test_chain_of_near_copies(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):  # each differs from the one before, so ends are far apart
        words[int(rng.integers(200))] = f"n{i}"
        rows.append((1000 - i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_dict(neardup.near_duplicates(docs)) == brute(rows)


def test_group_of_edited_copies(spark):
    """Copies with one to eight words changed: some linked, some not, many candidates; and a doc_id with two texts."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for j in rng.integers(0, 150, int(rng.integers(1, 9))):
            words[j] = f"x{rng.integers(10**9)}"
        rows.append((i * 3 % 1000 + i, " ".join(words)))
    rows = list(dict(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({c for _, c in want.values()}) > 50 and as_dict(neardup.near_duplicates(docs)) == want
    again = neardup.near_duplicates(docs.union(spark.createDataFrame([(rows[0][0], "another text")], docs.schema))).collect()
    assert {r.doc_id: r.component_id for r in again} == {d: c for d, (_, c) in want.items()}


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    for share in (0.2, 0.5, 0.85):
        both, each = int(2000 * share), int(1000 * (1 - share))
        a, b = np.unique(pool[: both + each]), np.unique(np.concatenate([pool[:both], pool[both + each : both + 2 * each]]))
        est, _ = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None])
        assert abs(est[0] - both / (both + 2 * each)) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (300, 300), (201, 202)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
