"""Draws made by array steps against the library, and against the same draws as an expression."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import forest, md5

KEYS = ["1", "22", None, "", "é€", "x" * 49, "x" * 50, "x" * 54, "x" * 200, "-9223372036854775808", *[str(i * 7919) for i in range(5000)]]


@pytest.mark.parametrize("keys", [KEYS, KEYS[:4], [None], []])
def test_first_words_are_those_of_the_library(keys):
    prefixes = [f"0:{t}" for t in (0, 9, 10, 99, 100)]
    for prefix, words in zip(prefixes, md5.first_words(prefixes, keys), strict=True):
        texts = [prefix if k is None else f"{prefix}:{k}" for k in keys]
        assert words.tolist() == [int.from_bytes(hashlib.md5(t.encode()).digest()[:4]) for t in texts]


def test_bootstrap_draws_the_same_in_tasks_as_in_expressions(spark):
    rows = spark.range(300).select((F.col("id") * 37).alias("r_key"))
    weight = forest.bootstrap(3)
    weights = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda tree: weight(tree).cast("int"))
    each = rows.select("r_key", weights.alias("w")).collect()
    got = weight.matrix([str(r.r_key) for r in each], 12)
    assert np.array_equal(got, np.array([r.w for r in each])) and got.max() > 2


def test_small_cars_draw_in_tasks(spark, monkeypatch):
    """The expression's draws took more time than the trees."""
    train = spark.createDataFrame([(1, r, r % 3, [r % 5, r % 7], 2) for r in range(60)], "out_id long, r_key long, label long, x array<bigint>, n_features int")
    asked = train.drop("label").where("r_key < 5")
    want = {(r.r_key, r.zoneid): pytest.approx(r.p) for r in forest.forest_probabilities(train, asked, trees=9).collect()}
    monkeypatch.setattr(forest.Bootstrap, "__call__", lambda self, tree: F.raise_error(F.lit("drawn by expression")))
    got = {(r.r_key, r.zoneid): r.p for r in forest.forest_probabilities(train, asked, trees=9).collect()}
    assert want and got == want
