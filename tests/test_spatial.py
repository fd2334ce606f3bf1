import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions import geometry as G
from lotwise.operators import spatial as J
from lotwise.operators import zonal as Z
from lotwise.sources import readers


def boxes(n, seed, huge=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.uniform(-500, 500), rng.uniform(-500, 500)
        if i % 3 == 0:
            x, y = 10.0, 10.0  # a third of the boxes in one place
        w, h = rng.uniform(0, 20), rng.uniform(0, 20)
        if huge and i % 25 == 1:
            w, h = 5000.0, 3000.0
        out.append((i, x, y, x + w, y + h))
    return out


@pytest.mark.parametrize("size,limit", [(50.0, 10**7), (5.0, 10**7), (50.0, 40)])
def test_box_join_equals_brute_force(spark, size, limit):
    a, b = boxes(150, 1), boxes(60, 2, huge=True)
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    s = "id int, xmin double, ymin double, xmax double, ymax double"
    got = J.box_join(spark.createDataFrame(a, s), spark.createDataFrame(b, s), size, cell_pairs=limit).select("id", "r_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_touching_at_a_corner_counts(spark):
    s = "parcel_id int, xmin double, ymin double, xmax double, ymax double"
    p = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 50.0, 50.0, 60.0, 60.0)], s)
    z = spark.createDataFrame([(10.0, 10.0, 20.0, 20.0, " ub "), (10.0, 10.0, 12.0, 12.0, "AUb")], "xmin double, ymin double, xmax double, ymax double, typezone string")
    got = dict(J.assign_zone(p, z, "typezone", 10.0).collect())
    assert got == {1: "AUB", 2: "inconnu"}


def test_missing_hazard_source_gives_null(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "parcel_id int, xmin double, ymin double, xmax double, ymax double")
    row = J.hazard_flags(p, None, ["argiles"], 10.0).first()
    assert row.brgm_argiles_flag is None


L_SHAPE = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)], dtype=float)
SQUARE = np.array([(2, 2), (5, 2), (5, 5), (2, 5), (2, 2)], dtype=float)


def test_polygon_overlap_of_concave_shapes():
    assert J.overlap_area(L_SHAPE, L_SHAPE) == pytest.approx(7.0)
    assert J.overlap_area(L_SHAPE, SQUARE) == pytest.approx(0.0)
    assert J.overlap_area(L_SHAPE, SQUARE - 1.5) == pytest.approx(0.5 * 3 + 0.5 * 3 - 0.25)
    assert not J.rings_touch(L_SHAPE, SQUARE)
    assert J.rings_touch(L_SHAPE, SQUARE - 1.0)          # meets in a corner
    assert J.rings_touch(np.array([(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.2)]), L_SHAPE)  # inside


def ring_col(points):
    return F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def test_ring_measures_and_membership(spark):
    m = spark.range(1).select(
        G.measures(ring_col(L_SHAPE)).alias("m"), G.contains_point(ring_col(L_SHAPE), F.lit(0.5), F.lit(3.0)).alias("a"),
        G.contains_point(ring_col(L_SHAPE), F.lit(3.0), F.lit(3.0)).alias("b"), G.ring_distance(ring_col(L_SHAPE), F.lit(3.0), F.lit(3.0)).alias("d"),
        G.is_valid_ring(ring_col(L_SHAPE)).alias("v"), G.is_valid_ring(ring_col(L_SHAPE[:3])).alias("w"),
    ).first()
    assert m.m.area == pytest.approx(7.0) and m.m.perimeter == pytest.approx(16.0)
    assert m.m.cx == pytest.approx((4 * 2 + 3 * 0.5) / 7) and m.a and not m.b and m.d == pytest.approx(2.0) and m.v and not m.w


def test_overlap_udf_in_the_coverage_join(spark):
    p = spark.range(1).select(F.lit(1).alias("parcel_id"), ring_col(L_SHAPE).alias("ring"))
    b = spark.range(2).select(ring_col(SQUARE - 1.5).alias("ring"))  # two equal buildings add up
    both = [d.select("*", F.inline(F.array(G.bounds(F.col("ring"))))) for d in (p, b)]
    assert J.built_area(both[0], both[1], 2.0).first().built_area == pytest.approx(2 * 2.75)


def test_nearest_segment_needs_several_rounds(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(0, 4000), rng.uniform(0, 4000)) for i in range(60)]
    segs = [(0.0, 0.0, 100.0, 900.0), (3900.0, 10.0, 3950.0, 10.0), (7.0, 7.0, 7.0, 7.0)]

    def gap(x, y, s):
        d = np.array([s[2] - s[0], s[3] - s[1]])
        t = 0.0 if not d.any() else np.clip(np.dot([x - s[0], y - s[1]], d) / np.dot(d, d), 0, 1)
        return math.hypot(x - s[0] - t * d[0], y - s[1] - t * d[1])

    p = spark.createDataFrame([*pts, (99, None, None)], "parcel_id int, px double, py double")
    got = dict(J.nearest_segment_distance(p, spark.createDataFrame(segs, "x1 double, y1 double, x2 double, y2 double"), 60.0).collect())
    assert len(got) == 61 and got[99] is None
    for i, x, y in pts:
        assert got[i] == pytest.approx(min(gap(x, y, s) for s in segs))


def test_cells_in_a_concave_polygon(spark):
    cells = Z.with_centres(spark.createDataFrame([(r, c, 1.0) for r in range(10) for c in range(10)], "r int, c int, z double"), 0.0, 5.0)
    zone = spark.range(1).select(F.lit(1).alias("parcel_id"), ring_col(L_SHAPE).alias("ring"))
    zone = zone.select("*", F.inline(F.array(G.bounds(F.col("ring")))))
    assert Z.cells_in_polygons(cells, zone).count() == 7 * 4
    within = Z.cells_within(cells, zone, 0.5).count()
    assert within > 28


def test_lambert93_known_point(spark):
    df = spark.createDataFrame([("5.9170", 45.5646)], "lon string, latitude double")
    row = readers.scan_points(df).first()
    assert row.x == pytest.approx(927489.67, abs=0.01) and row.y == pytest.approx(6500324.66, abs=0.01)


def test_cells_of_one_huge_zone_many_small_ones_and_a_pile(spark, monkeypatch):
    from lotwise.operators import zonal

    zones = [(0, -50.0, -50.0, 350.0, 350.0), (1, 0.0, 0.0, 0.0, 0.0)]
    zones += [(10 + i, 3.0 * i, 2.0 * i, 3.0 * i + 1, 2.0 * i + 1) for i in range(40)]
    zones += [(100 + i, 20.0 + i % 3, 20.0, 31.0, 30.0) for i in range(30)] + [(999, None, None, None, None)]
    cells = [(r, c, 2.0 * c, 2.0 * r) for r in range(50) for c in range(60)]
    zdf = spark.createDataFrame(zones, "parcel_id int, xmin double, ymin double, xmax double, ymax double")
    cdf = spark.createDataFrame(cells, "r int, c int, x double, y double")
    inside = lambda z, x, y, d: z[1] is not None and math.hypot(max(z[1] - x, 0, x - z[3]), max(z[2] - y, 0, y - z[4])) <= d
    for d in (0.0, 7.0):
        want = sorted((z[0], r, c) for z in zones for r, c, x, y in cells if inside(z, x, y, d))
        for most, width in ((2_000, None), (4, None), (4, 1.0)):
            monkeypatch.setattr(zonal._near_cells, "__defaults__", (most,))
            got = zonal.cells_within(cdf, zdf, d, width=width) if d else zonal.cells_in_polygons(cdf, zdf, width=width)
            assert sorted((x.parcel_id, x.r, x.c) for x in got.collect()) == want
    assert zonal.cells_in_polygons(cdf, zdf.where("false")).collect() == []


def test_copies_of_a_parcel_or_a_layer_are_compared_once(spark, monkeypatch):
    p = spark.range(300).selectExpr("id as parcel_id", "cast(id%3*10 as double) xmin", "0.0D ymin", "id%3*10+5.0D xmax", "5.0D ymax")
    z = spark.range(40).selectExpr("id as zone_id", "cast(id%2*10 as double) xmin", "0.0D ymin", "id%2*10+2.0D xmax", "2.0D ymax", "case when id<2 then 'A' else 'U' end typezone")
    seen, real = [], J.box_join

    def counted(left, right, *args, **kw):
        seen.append((left.count(), right.count()))
        return real(left, right, *args, **kw)

    monkeypatch.setattr(J, "box_join", counted)
    assert {(r.parcel_id % 3, r.zone_plu) for r in J.assign_zone(p, z, "typezone", 10.0).collect()} == {(0, "U"), (1, "U"), (2, "inconnu")}
    got = J.spatial_left_join(p, z, 10.0)
    assert got.columns == ["parcel_id", "zone_id", "typezone"] and got.count() == 200 * 20 + 100
    assert got.where("zone_id is null").count() == 100 and got.where("zone_id%2 <> parcel_id%3").count() == 0
    layers = p.selectExpr("xmin x", "ymin y", "case when parcel_id%2=0 then 'a' else 'b' end layer").where("x < 20 and (layer='a' or x=0)")
    flags = {(r.parcel_id % 3, r.brgm_a_flag, r.brgm_b_flag) for r in J.hazard_flags(p, layers, ["a", "b"], 10.0).collect()}
    assert flags == {(0, True, True), (1, True, False), (2, False, False)}
    assert {(r.parcel_id % 3, r.built_area) for r in J.built_area(p, z, 10.0).collect()} == {(0, 80.0), (1, 80.0), (2, 0.0)}
    assert seen == [(3, 2), (3, 2), (3, 2), (3, 2)]


def test_parcels_with_equal_rings_are_measured_once(spark, sf, monkeypatch):
    from lotwise.plans import study_area as S

    measured, real = [], S.shape_of
    monkeypatch.setattr(S, "parcels", lambda *_: spark.range(40).selectExpr("id as parcel_id", "0.0D xmin", "0.0D ymin", "id%4+1.0D xmax", "2.0D ymax"))
    monkeypatch.setattr(S, "shape_of", lambda rings: measured.append(rings.count()) or real(rings))
    got = {(r.parcel_id % 4, r.area_m2) for r in S.parcel_shape(spark, sf).collect()}
    assert got == {(i, 2.0 * (i + 1)) for i in range(4)} and measured == [4]
