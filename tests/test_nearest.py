"""Nearest points of small groups, found inside tasks, against the pairs of a join."""

import random

from pyspark.sql import functions as F

from waymark.operators import nearest


def test_small_groups_sort_no_pairs_and_get_the_same(spark, monkeypatch):
    draw = random.Random(5)
    spot = lambda: [draw.randint(0, 6), None if draw.random() < 0.03 else draw.randint(0, 3)]
    points = [(c, r * 7 % 101, spot(), 100 + r % 5) for c in (1, 2, 3, 5) for r in range((30, 3, 60, 40)[(1, 2, 3, 5).index(c)])]
    asked = [(c, 1000 + r, spot(), [1.5, 0.7]) for c in (1, 2, 3, 4) for r in range(12)]
    points = spark.createDataFrame(points, "out_id long, p_id long, x array<long>, label long")
    queries = spark.createDataFrame(asked, "out_id long, q_id long, x array<long>, scale array<double>")
    for k, power, scaled in ((5, 2, True), (4, 5, True), (3, 2, False)):
        ask = queries if scaled else queries.drop("scale")
        want = sorted(map(str, nearest._direct(ask, points, ["out_id"], 2, k, power, scaled).collect()))

        def rows():
            return sorted(map(str, nearest.nearest(ask, points, ["out_id"], 2, k, power).collect()))

        with monkeypatch.context() as patch:
            patch.setattr(nearest, "_best", None)  # no window over pairs
            assert len(want) > 36 and rows() == want
        with monkeypatch.context() as patch:
            patch.setattr(nearest, "SMALL_PAIRS", 400)  # both kinds of groups
            assert rows() == want
    assert nearest.nearest(queries, points.where(F.lit(False)), ["out_id"], 2, 3, 2).count() == 0
