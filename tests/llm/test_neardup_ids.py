"""Tables in which a doc_id has several texts."""

import corpus_pipeline
import numpy as np

from waymark.llm import neardup


def test_an_id_with_two_long_texts(spark):
    """The sets of one id count apart when shingles of its own are counted, so links of the first text stay."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for j in rng.integers(0, 150, int(rng.integers(1, 9))):
            words[j] = f"x{rng.integers(10**9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    others = [(i, " ".join(f"y{i}z{j}" for j in range(400))) for i, _ in rows]
    again = neardup.near_duplicates(docs.union(spark.createDataFrame(others, docs.schema))).collect()
    assert len(set(want.values())) > 50 and len(again) == 600
    assert {(r.doc_id, r.component_id) for r in again} == set(want.items())


def test_links_through_equal_sets(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    docs = spark.createDataFrame([(1, x), (5, x), (5, y), (9, y), (7, "another text of six words")], "doc_id long, text string")
    found = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (5, 1), (5, 1), (7, 7), (9, 1)]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 7]
