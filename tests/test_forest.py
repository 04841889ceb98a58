"""Forests grown with nodes carried by the rows, against the same forest in SQL."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.operators import forest
from waymark.plans import oracles


def made(rows, cars=3, features=5):
    draw = random.Random(rows)
    out = []
    for r in range(rows):
        car = r % cars
        x = [draw.randint(0, 30) if f else draw.randint(0, 2) for f in range(features)]
        out.append((car, r, 100 + (x[0] + x[1] // 10 + draw.randint(0, 1)) % 4, x))
    return out


def expected(rows, trees, depth):
    n = len(rows[0][3])
    con = duckdb.connect()
    frame = pd.DataFrame([(c, r, label) for c, r, label, _ in rows], columns=["out_id", "r_key", "label"])  # noqa: F841
    long = pd.DataFrame([(c, r, f, v) for c, r, _, x in rows for f, v in enumerate(x)], columns=["out_id", "r_key", "feature", "v"])  # noqa: F841
    return con.execute(
        oracles.query(
            f"f_rows as (select * from frame), f_asked as (select out_id, r_key from frame), f_x as (select * from long), f_size as (select distinct out_id, {n} n_features from frame)",
            oracles.forest_sql("f", trees, depth, oracles.POISSON, True),
            "select out_id, tree, r_key, zoneid, p from f_each",
        )
    ).fetchall()


@pytest.mark.parametrize("sparse", [False, True])
def test_equals_sql_tree_by_tree(spark, sparse):
    rows = made(240)
    x = "x map<int, bigint>" if sparse else "x array<bigint>"
    given = [(c, r, label, {f: v for f, v in enumerate(v) if v} if sparse else v, len(v)) for c, r, label, v in rows]
    train = spark.createDataFrame(given, f"out_id bigint, r_key bigint, label bigint, {x}, n_features int")
    found = forest.tree_shares(train, train.drop("label"), 7, 4, 0, forest.bootstrap(), 0, sparse=sparse).collect()
    ours = {(r.out_id, r.tree, r.r_key, r.zoneid): round(r.p, 9) for r in found}
    theirs = {(c, t, r, z): round(p, 9) for c, t, r, z, p in expected(rows, 7, 4)}
    assert len(theirs) > 7 * 200 and ours == theirs


def test_deep_trees_and_empty_tables(spark):
    """Eight levels: the expression that walks a tree must not double with each."""
    rows = made(60, cars=1)
    train = spark.createDataFrame([(*r, 5) for r in rows], "out_id bigint, r_key bigint, label bigint, x array<bigint>, n_features int")
    each = forest.tree_shares(train, train.drop("label"), 2, 8)
    shares = each.groupBy("tree", "r_key").agg(F.sum("p").alias("p")).collect()
    assert len(shares) == 120 and all(abs(r.p - 1) < 1e-9 for r in shares)
    assert forest.tree_shares(train.limit(0), train.drop("label").limit(0), 2, 2).count() == 0


@pytest.mark.parametrize("sparse", [False, True])
def test_small_cars_need_no_jobs_by_level_and_get_the_same(spark, monkeypatch, sparse):
    rows = [(c, r, None if r == 9 else label, v[: 3 + c]) for c, r, label, v in made(150)]  # cars differ in their features; one label is null
    x = "x map<int, bigint>" if sparse else "x array<bigint>"
    given = [(c, r, label, {f: v for f, v in enumerate(v) if v} if sparse else v, len(v)) for c, r, label, v in rows]
    train = spark.createDataFrame([g for g in given if g[0] != 2 or g[1] < 9], f"out_id bigint, r_key bigint, label bigint, {x}, n_features int")
    asked = spark.createDataFrame(given, train.schema).drop("label")
    settings = (7, 3, 0, forest.bootstrap(), 0)
    by_levels = forest._by_levels(train, asked, *settings, ["out_id"], sparse).collect()
    want = {(r.out_id, r.tree, r.r_key, r.zoneid): pytest.approx(r.p, abs=1e-12) for r in by_levels}

    def shares():
        return {(r.out_id, r.tree, r.r_key, r.zoneid): r.p for r in forest.tree_shares(train, asked, *settings, sparse=sparse).collect()}

    with monkeypatch.context() as patch:
        patch.setattr(forest, "_grown", None)
        assert shares() == want
        mean = forest.forest_probabilities(train, asked, 7, 3, sparse=sparse).groupBy("out_id", "r_key").agg(F.sum("p").alias("p")).collect()
        assert len(mean) == 150 and all(r.p == pytest.approx(1) for r in mean)
    monkeypatch.setattr(forest, "SMALL_CELLS", 400)  # both kinds of cars
    assert shares() == want
