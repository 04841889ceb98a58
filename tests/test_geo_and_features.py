"""Known values and edges of the trip operators."""

import math

import pytest
from pyspark.sql import functions as F

from waymark import skew
from waymark.functions import geo
from waymark.operators import cohorts, forest, quality
from waymark.sources import bundles
from waymark.sources.calendar import calendar


def test_distance_of_known_points(spark):
    rows = spark.createDataFrame([(30.0, 114.0, 30.0, 114.0), (0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    found = [r[0] for r in rows.select(geo.metres(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert found[0] == 0
    assert found[1] == pytest.approx(2 * math.pi * 6_371_000 / 360, rel=0.01)


def test_cohort_edges(spark):
    cells = [0, 1, 20, 21, 40, 41, 60, 61, 80, 81, 100, 101, 900, 901]
    found = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "cells long").select(cohorts.geo_bucket(F.col("cells"))).collect()]
    assert found == [-1, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, -1]


def test_calendar(spark):
    days = {str(r.date): r.code for r in calendar(spark, "2024-01-01", "2024-01-14", [("2024-01-01", "2024-01-01")], ["2024-01-14"]).collect()}
    assert len(days) == 14
    assert (days["2024-01-01"], days["2024-01-06"], days["2024-01-08"], days["2024-01-14"]) == ("2", "1", "0", "0")


@pytest.mark.parametrize("parts", ["1", "8", "60"])
def test_sorted_codes_with_a_common_start(spark, parts):
    texts = [f"https://example.org/{i:04}" for i in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts * 2] + [(None,)], "t string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r.t: r.code for r in skew.sorted_codes(rows, "t").collect()} == {t: i for i, t in enumerate(texts)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("hot", [1, 1_000_000])
def test_position_does_not_depend_on_what_counts_as_hot(spark, hot, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rows = spark.createDataFrame([(i % 3, i * 7 % 100, i) for i in range(90)], "k long, v long, i long")
    found = skew.with_position(rows, ["k"], ["v", "i"], [F.floor(F.col("v") / 10)]).collect()
    for k in range(3):
        mine = sorted((r for r in found if r.k == k), key=lambda r: (r.v, r.i))
        assert [r.pos for r in mine] == list(range(1, 31)) and {r.total for r in mine} == {30}


def test_every_node_looks_at_as_many_features_as_asked(spark):
    rows = spark.createDataFrame([(1, 0, n, [0] * 100, 100, 1, 1) for n in range(20)], "out_id long, tree int, node int, x array<long>, n_features int, label long, w long")
    drawn = forest._features(rows.select("n_features", "tree", "node"), 0, 10, 5)
    counts = forest.split_counts(rows, drawn, ["out_id"], False)
    assert {r.n for r in counts.groupBy("node").agg(F.countDistinct("feature").alias("n")).collect()} == {10}


def test_a_trip_is_scored_by_a_tree_that_has_not_seen_it(spark):
    """Every trip of the car ends in a zone of its own, so a tree that has learned from a trip gives that zone a share."""
    rows = spark.createDataFrame([(1, i, 100 + i, [i], 1) for i in range(40)], "out_id long, r_key long, label long, x array<long>, n_features int")
    found = forest.cross_fitted(rows, folds=4, depth=2).collect()
    assert {r.r_key for r in found} == set(range(40)) and all(r.zoneid != 100 + r.r_key for r in found)
    assert len({r.part for r in found}) == 4
    shares = forest.fold_shares(rows, rows.drop("label"), folds=4, depth=2).groupBy("part", "r_key").agg(F.sum("p").alias("p")).collect()
    assert len(shares) == 160 and all(abs(r.p - 1) < 1e-9 for r in shares)


def test_impute_and_exceptions(spark):
    rows = spark.createDataFrame([(1, 2.0, "a", True), (2, None, None, True), (3, float("inf"), "b", False), (4, 4.0, "a", True)], "i long, v double, t string, tr boolean")
    filled = {r.i: (r.v, r.t) for r in quality.impute_missing(rows, F.col("tr"), ["v"], ["t"]).collect()}
    assert filled == {1: (2.0, "a"), 2: (3.0, "a"), 3: (3.0, "b"), 4: (4.0, "a")}
    assert sorted(r.i for r in quality.exception_report(rows, "i", ["v"]).collect()) == [2, 3]


def test_select_runs(spark):
    runs = spark.createDataFrame([("a1", 1), ("b1", 2), ("a0", 3)], "model string, x long")
    assert {r.model for r in bundles.select_runs(runs, "^a").collect()} == {"a0", "a1"}
    assert [r.model for r in bundles.select_runs(runs, "^a", 1).collect()] == ["a0"]
