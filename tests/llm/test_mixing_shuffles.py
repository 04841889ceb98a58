import contextlib
import io

import pytest

from waymark.llm import mixing

CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture
def unaided(spark):
    """Every join shuffles, and plans are final."""
    before = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_texts_are_shuffled_twice(unaided):
    """Once for their place in the queue and once for the order of the mix, however large the table of places."""
    docs = unaided.createDataFrame([(i, "w " * (i % 9), "ab"[i % 2]) for i in range(50)], "doc_id long, text string, source string")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        mixing.mixed(docs).explain()
    plan = shown.getvalue()
    assert "SortMergeJoin" in plan
    assert plan.count("Exchange ") == 3  # the third is that of the places


def test_null_and_empty_source_differ(spark):
    """One document each: they are never one queue."""
    docs = spark.createDataFrame([(1, "a b c", None), (2, "a b", ""), (3, "a", "s")], "doc_id long, text string, source string")
    sizes = {r.doc_id: (r.size, r.source_size) for r in mixing.mix(docs).collect()}
    assert sizes == {1: (3, 3), 2: (2, 2), 3: (1, 1)}
