"""Addresses around few centres, against the same steps in plain Python."""

import random

import pytest

from waymark.operators import zones


def made(cars=2, spots=40, kinds=6):
    draw = random.Random(5)
    rows = []
    for car in range(cars):
        at = [(draw.randint(3_000_000, 3_050_000), draw.randint(12_000_000, 12_050_000)) for _ in range(kinds)]
        for i in range(spots):
            z = i % kinds
            lat, lon = (c + draw.randint(-9_000, 9_000) for c in at[z])
            rows.append((car, lat, lon, 100 + z, z, 50 - z, at[z][0] / 1e5, at[z][1] / 1e5))
    return rows


def plain(rows, centers, rounds):
    """{(car, lat, lon): zone} after at most ``rounds`` rounds from the busiest zones."""
    out = {}
    for car in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == car]
        at = {r[4]: (r[6], r[7]) for r in own if r[4] < centers}

        def near(r):
            return min(((at[c][0] - r[1] / 1e5) ** 2 + (at[c][1] - r[2] / 1e5) ** 2, c) for c in at)[1]

        for _ in range(rounds):
            groups = {}
            for r in own:
                groups.setdefault(near(r), []).append(r)
            moved = at | {c: (sum(r[1] for r in g) / len(g) / 1e5, sum(r[2] for r in g) / len(g) / 1e5) for c, g in groups.items()}
            if moved == at:
                break
            at = moved
        out |= {(car, r[1], r[2]): near(r) for r in own}
    return out


@pytest.mark.parametrize("rounds", [1, 300])
def test_equals_plain_steps(spark, rounds):
    rows = made()
    columns = "out_id bigint, lat_e5 bigint, lon_e5 bigint, zoneid bigint, sn bigint, in_out bigint, center_lat double, center_lon double"
    found = zones.zones_kmeans_reduced(spark.createDataFrame(rows, columns), 3, rounds).collect()
    assert {(r.out_id, r.lat_e5, r.lon_e5): r.zoneid for r in found} == plain(rows, 3, rounds)
