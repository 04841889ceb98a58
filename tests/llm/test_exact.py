import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.llm import exact

SCHEMA = "doc_id long, text string, keep_id string"


def expected(rows):
    """(doc_id, keep_id, group_size, kept) of every row, by sorting each group."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for group in groups.values():
        group.sort(key=lambda r: r[:3])
        out += [(r[3], group[0][3], len(group), i == 0) for i, r in enumerate(group)]
    return Counter(out)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], SCHEMA).repartition(5)
    got = exact.groups(docs, **options).collect()
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)


HARD = [
    (1, "a b"), (2, "ab "), (3, " a b"), (3, " a b"), (4, None), (5, ""), (6, " \t\n\x0b\f\r"), (None, "ab  "), (None, "x"), (7, "x"),
    (8, "a b"), (9, "a​b"), (10, "A B"), (11, "z" * 3_000_000), (12, "z " * 3_000_000), (13, "\U0001f600 b"), (14, "\U0001f600b"),
    *[(100 + i % 40, "many copies") for i in range(300)],
]


def test_hard_rows(spark):
    assert found(spark, HARD) == expected(HARD)


def test_different_texts_with_one_digest_stay_apart(spark):
    weak = lambda content: F.unhex(F.substring(F.sha2(content, 256), 1, 1).cast("string"))
    rows = [(i, f"text {i % 37}" + " " * (i % 5)) for i in range(400)]
    assert found(spark, rows, digest=weak) == expected(rows)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3) | st.none(), st.text("ab \n", max_size=3) | st.none()), max_size=30))
def test_any_rows(spark, rows):
    assert found(spark, rows) == expected(rows)


def test_hot_and_other_groups_meet_alike(spark, monkeypatch):
    rows = [(i, "hot") for i in range(60)] + [(100 + i, f"t{i // 2}") for i in range(40)]
    monkeypatch.setattr(exact, "HOT_SHARE", 2)
    assert found(spark, rows) == expected(rows)
    monkeypatch.setattr(exact, "HOT_SHARE", 0)
    assert found(spark, rows) == expected(rows)


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(i, t, "mine") for i, t in HARD], SCHEMA)
    stay = exact.deduplicated(docs).collect()
    assert Counter(r.doc_id for r in stay) == Counter(row[0] for row, n in expected(HARD).items() for _ in range(n) if row[3])
    assert stay[0].keep_id == "mine"


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_small_tables(spark, rows):
    assert found(spark, rows) == expected(rows)


def test_equals_sql(spark, sf):
    got = Counter(tuple(r) for r in exact.op13_exact(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as from '{sf}/documents.parquet'")
    assert got == Counter(con.execute(exact.OP13_SQL).fetchall())
