"""Leaf-wise growth bounded by leaves alone, and that the query asks for it."""

from dataclasses import replace

import pytest
from test_boosting import COLUMNS, plain

from waymark.operators import boosting
from waymark.plans import queries

SCHEMA = "out_id long, r_key long, a long, b long, end_zoneid long"


@pytest.fixture(scope="module")
def growing():
    """Zones that alternate along ``a``, ever more finely: cuts lie one below the other, deeper than a full tree of so many leaves."""
    edges = [0]
    for i in range(40):
        edges.append(edges[-1] + 2 + i % 3)
    return [(r, (r, r % 3), 100 + sum(r >= e for e in edges) % 2) for r in range(edges[-1])]


@pytest.mark.parametrize("by_levels", [False, True])
def test_trees_are_bounded_by_leaves_not_by_depth(spark, growing, by_levels):
    s = replace(boosting.LEAF_WISE, rounds=1, leaves=12, least_rows=2)
    asked = [(1000 + r, x, 0) for r, x, _ in growing[::7]]
    train, queries_ = (spark.createDataFrame([(1, r, *x, z) for r, x, z in rows], SCHEMA) for rows in (growing, asked))
    fit = (lambda *a: boosting._by_levels(*a, s, None, ["out_id"])) if by_levels else (lambda *a: boosting.boosted_probabilities(*a, s))
    got = {(r.r_key, r.zoneid): r.p for r in fit(train, queries_.drop("end_zoneid"), COLUMNS).collect()}
    want, sizes = plain(growing, asked, replace(s, depth=1000))
    shallow, _ = plain(growing, asked, replace(s, depth=5))
    assert sizes == [12, 12]
    assert any(want[k] != pytest.approx(shallow[k], abs=1e-6) for k in want)
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_the_query_fits_all_rounds_without_a_bound_on_depth(monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "_boosted", lambda spark, sf, settings, stop_early: asked.append((settings, stop_early)))
    queries.boosted_leafwise(None, "")
    (settings, stop_early), = asked
    assert (settings.rounds, settings.depth, settings.leaves, stop_early) == (50, None, 31, True)
