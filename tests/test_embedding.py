"""Embedding queries against a decomposition in one place."""

import numpy as np

import __spark_entry__
from waymark.operators import features
from waymark.plans import queries


def test_embedding_equals_plain_decomposition(spark, sf):
    matrix = {r.cell: [r[h] for h in features.HOURS] for r in features.geo_hour_matrix(features.geo_hour_traffic(*queries._split(spark, sf))).collect()}
    rows = __spark_entry__.queries()["geo_embedding"](spark, sf).collect()
    names = [c for c in rows[0].asDict() if c.startswith("geo_rd_c")]
    assert names and sorted(r.cell for r in rows) == sorted(c for c in matrix if c is not None)
    cells = sorted(r.cell for r in rows)
    u, s, _ = np.linalg.svd(np.array([matrix[c] for c in cells], float), full_matrices=False)
    found = {r.cell: [r[n] for n in names] for r in rows}
    for i in range(len(names)):
        ours = np.array([found[c][i] for c in cells])
        assert ours[np.abs(ours).argmax()] > 0
        if min(abs(s[i] - x) for j, x in enumerate(s) if j != i) > 1e-3 * s[0]:  # vectors of equal singular values may turn
            assert abs(abs(ours @ u[:, i]) - 1) < 1e-6
    u = np.array([[found[c][i] for c in cells] for i in range(len(names))])
    assert np.abs(u @ u.T - np.eye(len(names))).max() < 1e-9


def test_few_cells_nulls_and_empty_tables(spark):
    rows = [("a", "in_0", 3), ("a", "out_1", 4), (None, "in_0", 9)]
    traffic = spark.createDataFrame(rows, "cell string, hour_wk string, trips bigint")
    (only,) = features.geo_embedding(traffic, 2).collect()
    assert (only.cell, only.geo_rd_c2_1) == ("a", 0.0) and abs(only.geo_rd_c2_0 - 1) < 1e-12
    assert features.geo_embedding(traffic.limit(0), 2).count() == 0


def test_every_trip_gets_the_embedding_of_its_cell(spark, sf):
    rows = __spark_entry__.queries()["trips_embedded"](spark, sf).collect()
    assert rows and len(rows) == queries._trips(spark, sf).count()
    names = [c for c in rows[0].asDict() if c.startswith("geo_rd_c")]
    assert names and all(r[n] is not None for r in rows for n in names)
