"""Rows of the spatial left join are made by its last step, whatever copies the layer has."""

import random

import pytest

from lotwise.operators import spatial as J


@pytest.mark.parametrize("most", [500_000, 3])
def test_copies_of_a_zone_meet_the_parcels_in_the_last_join(spark, monkeypatch, most):
    monkeypatch.setattr(J, "MAX_COPIES", most)
    r = random.Random(5)
    box = lambda: (x := float(r.randint(0, 60)), y := float(r.randint(0, 60)), x + r.randint(1, 9), y + r.randint(1, 9))
    boxes = [box() for _ in range(12)]
    parcels = [(i, *r.choice(boxes)) for i in range(30)] + [(40, 500.0, 500.0, 501.0, 501.0), (None, *boxes[0]), (41, None, None, None, None)]
    zones = [(i, *r.choice(boxes), r.choice(["U", "A", None])) for i in range(40)] + [(None, *boxes[1], "N"), (60, None, None, None, None, "U")]
    p = spark.createDataFrame(parcels, "parcel_id long, xmin double, ymin double, xmax double, ymax double")
    z = spark.createDataFrame(zones, "zone_id long, xmin double, ymin double, xmax double, ymax double, typezone string")
    touch = lambda a, b: None not in (*a, *b) and a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    want = []
    for i, *a in parcels:
        found = [(i, zone, kind) for zone, *b, kind in zones if touch(a, b)]
        want += found or [(i, None, None)]
    got = J.spatial_left_join(p, z, 10.0)
    assert got.columns == ["parcel_id", "zone_id", "typezone"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    if most > 3:  # no shuffle holds a row for every pair and copy
        assert "BroadcastHashJoin [_number" in got._jdf.queryExecution().executedPlan().toString()
