import zlib

import numpy as np
from pyspark.sql import Row

from waymark.llm import quality


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    pos = labels == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op4_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    s, y, p = map(np.array, zip(*held))
    assert auc(s, y) > 0.95
    assert np.mean(p == y) > 0.93


def test_identity_equals_all_pairs():
    rng = np.random.default_rng(3)
    n = quality.WORD_BUCKETS + quality.STATISTICS
    machine = quality.Machine(
        0.3, rng.normal(size=n).astype(np.float32) * 0.1, rng.normal(size=(n, quality.RANK)).astype(np.float32) * 0.1,
        np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS),
    )
    features = quality.Features()
    rows = [features(t, c) for t, c in [("a b c a B!\nx", 11), (None, None), ("one two three four", 18)]]
    for row, found in zip(rows, machine.score(rows)):
        x = np.zeros(n)
        x[row[0]] = row[1]
        x[quality.WORD_BUCKETS :] = machine.scaled(np.array(row[2]))
        used = np.flatnonzero(x)
        pairs = sum(machine.factors[i] @ machine.factors[j] * x[i] * x[j] for a, i in enumerate(used) for j in used[:a])
        assert abs(found - 1 / (1 + np.exp(-(0.3 + x @ machine.linear + pairs)))) < 1e-4


def test_hard_rows(spark):
    texts = [None, "", "  \n", "good words here", "BAD!! BAD!! BAD!!", "long " * 200_000, "é퟿\U0001f600"]
    rows = [Row(doc_id=i, text=t, n_chars=None if i == 2 else len(t or ""), score="mine") for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (10, 1), (11, 0), (99, 1)], "doc_id long, quality int")
    machine = quality.fit(docs, labels)
    found = {r.doc_id: r.score for r in quality.score(docs, machine).collect()}
    assert len(found) == 14 and all(0 <= s <= 1 for s in found.values())
    assert found[3] == found[10] and found[0] == found[1]
    again = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert again == found
    assert quality.score(docs.limit(0), machine).count() == 0
    untaught = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, untaught).collect()} == {0.5}
