"""Spark against the independent SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__  # noqa: E402
from check import connect, difference  # noqa: E402

NAMES = (
    "trip_distance",
    "trip_geohash",
    "car_distance_profile",
    "car_geo_footprint_both",
    "trips_scored_cars",
    "car_addresses",
    "address_gaps",
    "zone_dictionary",
    "holdout_latest",
    "features_scaled",
    "label_encode",
    "exception_report",
    "impute_missing",
)


@pytest.fixture(scope="module")
def tables(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf, tables, name):
    ours = __spark_entry__.queries()[name](spark, sf).toPandas()
    assert len(ours)
    assert difference(ours, tables.execute(__spark_entry__.oracle_sql()[name]).df()) is None


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
