"""Runs in either form, and weighted neighbours, on small known values."""

import math

import pytest

from waymark.operators import models
from waymark.sources import bundles


@pytest.fixture
def dictionary(spark):
    rows = [(1, 100, 30, 7), (1, 100, 20, 9), (1, 100, 20, 8), (1, 101, 50, 5), (2, 100, 60, 6)]
    return spark.createDataFrame(rows, "out_id long, zoneid long, lat_e5 long, lon_e5 long")


def test_both_forms_give_equal_rows(spark, dictionary, tmp_path):
    rows = [(1, 11, 100, 0.5), (1, 11, 101, 0.5), (1, 12, 101, 0.9), (1, 12, 100, 0.1), (2, 13, 100, 1.0), (2, 14, 102, 1.0)]
    wide = bundles.save_wide(spark.createDataFrame(rows, "out_id long, r_key long, zoneid long, p double"), str(tmp_path / "wide"))
    want = {11: (20 / 1e5, 8 / 1e5), 12: (50 / 1e5, 5 / 1e5), 13: (60 / 1e5, 6 / 1e5), 14: (None, None)}
    placed = spark.createDataFrame([(k, *v, "more") for k, v in want.items()], "r_key long, predict_lat double, predict_lon double, kw string")
    placed.write.parquet(str(tmp_path / "placed"))
    assert "102" in spark.read.parquet(wide).columns
    found = bundles.read_any_form(spark, {"a": wide, "b": str(tmp_path / "placed")}, dictionary).collect()
    for model in "ab":
        assert {r.r_key: (r.predict_lat, r.predict_lon) for r in found if r.model == model} == want


def test_a_trip_without_probabilities(spark, dictionary, tmp_path):
    path = str(tmp_path / "wide")
    spark.createDataFrame([(1, 11, None, 0.0), (1, 12, None, None)], "out_id long, r_key long, `100` double, `101` double").write.parquet(path)
    found = {r.r_key: r.predict_lat for r in bundles.read_any_form(spark, {"a": path}, dictionary).collect()}
    assert found == {11: 50 / 1e5, 12: None}
    empty = str(tmp_path / "empty")
    spark.createDataFrame([(1, 11)], "out_id long, r_key long").write.parquet(empty)
    assert [tuple(r) for r in bundles.read_any_form(spark, {"a": empty}, dictionary).collect()] == [("a", 11, None, None)]


def test_distance_weights(spark):
    columns = "weekday long, weekend long, start_lat_e5 long, start_lon_e5 long, hour_c long"
    train = spark.createDataFrame(
        [(1, i, 0, 0, x, 0, 0, z) for i, (x, z) in enumerate([(0, 100), (10, 101), (10, 101), (40, 102), (90, 103)])],
        f"out_id long, r_key long, {columns}, end_zoneid long",
    )
    asked = spark.createDataFrame([(1, 50, 0, 0, 4, 0, 0), (1, 51, 0, 0, 10, 0, 0)], f"out_id long, r_key long, {columns}")
    found = models.knn_probabilities(train, asked, k=4, power=2, gp="0", weights="distance").collect()
    w = {100: 1 / 4, 101: 2 / 6, 102: 1 / 36}
    got = {(r.r_key, r.zoneid): r.p for r in found}
    assert set(got) == {(50, z) for z in w} | {(51, 101)}
    assert all(math.isclose(got[50, z], v / sum(w.values())) for z, v in w.items()) and got[51, 101] == 1.0
    with pytest.raises(ValueError):
        models.knn_probabilities(train, asked, weights="other")
