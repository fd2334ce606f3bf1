"""Geometry as column expressions.

A ring is ``array<struct<x:double,y:double>>``, closed (first point repeated at the end).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def rect_ring(xmin, ymin, xmax, ymax) -> Column:
    x0, y0, x1, y1 = (F.col(c) if isinstance(c, str) else c for c in (xmin, ymin, xmax, ymax))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def _edges(ring: Column, per_edge) -> Column:
    n = F.size(ring)
    heads = F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tails = F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(heads, tails, per_edge)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _cross(a: Column, b: Column, origin: Column) -> Column:
    ax, ay = a["x"] - origin["x"], a["y"] - origin["y"]
    bx, by = b["x"] - origin["x"], b["y"] - origin["y"]
    return ax * by - bx * ay


def signed_area(ring: Column) -> Column:
    first = F.get(ring, F.lit(0))
    return _sum(_edges(ring, lambda a, b: _cross(a, b, first))) / 2.0


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _sum(_edges(ring, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def measures(ring: Column) -> Column:
    """``struct<area,perimeter,cx,cy>`` in one walk around the ring.

    Coordinates are taken relative to the first point to keep the digits of the centroid.
    """
    o = F.get(ring, F.lit(0))
    zero = F.struct(F.lit(0.0).alias("a2"), F.lit(0.0).alias("len"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))
    steps = _edges(
        ring,
        lambda a, b: F.struct(
            (a["x"] - o["x"]).alias("ax"), (a["y"] - o["y"]).alias("ay"), (b["x"] - o["x"]).alias("bx"), (b["y"] - o["y"]).alias("by")
        ),
    )

    def add(acc, e):
        cross = e["ax"] * e["by"] - e["bx"] * e["ay"]
        return F.struct(
            (acc["a2"] + cross).alias("a2"),
            (acc["len"] + F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"])).alias("len"),
            (acc["sx"] + (e["ax"] + e["bx"]) * cross).alias("sx"),
            (acc["sy"] + (e["ay"] + e["by"]) * cross).alias("sy"),
        )

    def finish(acc):
        return F.struct(
            (F.abs(acc["a2"]) / 2.0).alias("area"),
            acc["len"].alias("perimeter"),
            (o["x"] + F.try_divide(acc["sx"], acc["a2"] * 3.0)).alias("cx"),
            (o["y"] + F.try_divide(acc["sy"], acc["a2"] * 3.0)).alias("cy"),
        )

    return F.aggregate(steps, zero, add, finish)


def centroid(ring: Column) -> Column:
    m = measures(ring)
    return point(m["cx"], m["cy"])


def is_valid_ring(ring: Column) -> Column:
    """Closed, at least four points, positive area."""
    closed = (F.get(ring, F.lit(0)) == F.element_at(ring, -1))
    return F.coalesce(F.when(F.size(ring) >= 4, closed & (area(ring) > 0)), F.lit(False))


def compactness(area_: Column, perimeter_: Column) -> Column:
    return F.when((area_ > 0) & (perimeter_ > 0), area_ * (4 * math.pi) / (perimeter_ * perimeter_))


def elongation(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    w, h = xmax - xmin, ymax - ymin
    return F.when(F.least(w, h) > 0, F.greatest(w, h) / F.least(w, h))


def block_id(x: Column, y: Column, size: float) -> Column:
    return F.concat_ws("_", (x / size).cast("int").cast("string"), (y / size).cast("int").cast("string"))


def contains_point(ring: Column, px: Column, py: Column) -> Column:
    """Even-odd ray casting."""
    crossings = _edges(
        ring,
        lambda a, b: F.when(
            ((a["y"] > py) != (b["y"] > py))
            & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]),
            1,
        ).otherwise(0),
    )
    return F.aggregate(crossings, F.lit(0), lambda acc, v: acc + v) % 2 == 1


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - x1) * dx + (py - y1) * dy) / len2).otherwise(0.0)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def ring_distance(ring: Column, px: Column, py: Column) -> Column:
    """Distance from a point to a polygon, zero inside."""
    outside = F.array_min(
        _edges(ring, lambda a, b: segment_distance(px, py, a["x"], a["y"], b["x"], b["y"]))
    )
    return F.when(contains_point(ring, px, py), F.lit(0.0)).otherwise(outside)


# Lambert-93: GRS80 ellipsoid, secant conic (public definition of EPSG:2154)
_A = 6378137.0
_F = 1.0 / 298.257222101
_E = math.sqrt(2 * _F - _F * _F)
_LAT0, _LON0, _LAT1, _LAT2 = (math.radians(v) for v in (46.5, 3.0, 49.0, 44.0))
_X0, _Y0 = 700000.0, 6600000.0


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (_E * math.sin(lat)) ** 2)


def _t(lat: float) -> float:
    es = _E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - es) / (1 + es)) ** (_E / 2)


_N = (math.log(_m(_LAT1)) - math.log(_m(_LAT2))) / (math.log(_t(_LAT1)) - math.log(_t(_LAT2)))
_C = _A * _m(_LAT1) / (_N * _t(_LAT1) ** _N)
_RHO0 = _C * _t(_LAT0) ** _N
LAMBERT93 = {"e": _E, "n": _N, "c": _C, "rho0": _RHO0, "lon0": _LON0, "x0": _X0, "y0": _Y0}


def to_lambert93(lon: Column, lat: Column) -> Column:
    """WGS84 degrees to EPSG:2154 metres, as ``struct<x,y>``."""
    phi = F.radians(lat)
    es = F.sin(phi) * _E
    t = F.tan(F.lit(math.pi / 4) - phi / 2.0) / F.pow((F.lit(1.0) - es) / (F.lit(1.0) + es), F.lit(_E / 2))
    rho = F.pow(t, F.lit(_N)) * _C
    theta = (F.radians(lon) - _LON0) * _N
    return point(rho * F.sin(theta) + _X0, F.lit(_RHO0 + _Y0) - rho * F.cos(theta))
