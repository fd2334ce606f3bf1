"""Spatial joins on a grid: equi-join on cells, box predicate, exact predicate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from lotwise.catalog import MAX_COVERAGE_RATIO
from lotwise.functions import geometry as G
from lotwise.functions.text import zone_code, zone_rank
from lotwise.session import cut_lineage, materialise

BOX = ("xmin", "ymin", "xmax", "ymax")
CELL_PAIRS = 4_000_000   # comparisons within one cell before it is divided further
MAX_DENSE_CELLS = 10_000
MAX_COPIES = 500_000     # rows of a layer, without geometry, that are sent to every task


def _cell(v: Column, size: Column | float) -> Column:
    return F.floor(v / size).cast("long")


def _level(size: float) -> Column:
    """Zero for boxes up to eight cells wide; one more for every doubling beyond."""
    widest = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(widest, F.lit(1e-9)) / (8.0 * size)))).cast("int")


def _levels_present(left: DataFrame, right: DataFrame, size: float) -> tuple[list[int], list[int]]:
    """Levels on each side: a handful of numbers, as a level is the logarithm of a width."""
    both = left.select(_level(size).alias("l"), F.lit(0).alias("side")).unionByName(right.select(_level(size).alias("l"), F.lit(1).alias("side")))
    rows = both.groupBy("side").agg(F.collect_set("l").alias("ls")).collect()
    found = {r["side"]: sorted(r["ls"]) for r in rows}
    return found.get(0, []), found.get(1, [])


def _spread(df: DataFrame, size: float, other: list[int]) -> DataFrame:
    """One row per grid cell that the box touches, at its own level and at every coarser one of the other
    side. A level has cells twice as wide as the one before, so no box is spread over more than some
    eighty cells per level, however large it is."""
    df = df.withColumn("_own", _level(size))
    coarser = [F.when(F.col("_own") < l, F.lit(l)) for l in other if l > 0]
    levels = F.array_compact(F.array(F.col("_own"), *coarser)) if coarser else F.array(F.col("_own"))
    df = df.withColumn("_lvl", F.explode(levels)).withColumn("_s", F.pow(F.lit(2.0), F.col("_lvl")) * size)
    s = F.col("_s")
    xs = F.sequence(_cell(F.col("xmin"), s), _cell(F.col("xmax"), s))
    ys = F.sequence(_cell(F.col("ymin"), s), _cell(F.col("ymax"), s))
    return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def _sub(v: Column, cell: Column, size: Column, k: Column) -> Column:
    at = F.floor((v - cell * size) / size * k).cast("long")
    return F.least(F.greatest(at, F.lit(0)), k - 1)


def _divide(df: DataFrame, dense: DataFrame | None) -> DataFrame:
    """Within dense cells, one row per sub-cell that the box touches."""
    if dense is None:
        return df.withColumn("_k", F.lit(1)).withColumn("_sx", F.lit(0)).withColumn("_sy", F.lit(0))
    df = df.join(F.broadcast(dense), ["_lvl", "_cx", "_cy"], "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    k, cx, cy, s = F.col("_k"), F.col("_cx"), F.col("_cy"), F.col("_s")
    xs = F.sequence(_sub(F.col("xmin"), cx, s, k), _sub(F.col("xmax"), cx, s, k))
    ys = F.sequence(_sub(F.col("ymin"), cy, s, k), _sub(F.col("ymax"), cy, s, k))
    return df.withColumn("_sx", F.explode(xs)).withColumn("_sy", F.explode(ys))


def _dense_cells(left: DataFrame, right: DataFrame, cell_pairs: int):
    """The densest cells with too many comparisons, their division factor, and whether there were more."""
    at = ["_lvl", "_cx", "_cy"]
    side = lambda df, l, r: df.select(*at, F.lit(l).alias("_l"), F.lit(r).alias("_r"))
    work = F.col("_l") * F.col("_r")
    factor = F.least(F.ceil(F.sqrt(work / F.lit(float(cell_pairs)))), F.lit(64)).cast("int")
    dense = (
        side(left, 1, 0).unionByName(side(right, 0, 1))
        .groupBy(*at).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
        .where(work > cell_pairs)
        .select(*at, factor.alias("_k"), work.alias("_work"))
    )
    rows = dense.orderBy(F.col("_work").desc(), *at).limit(MAX_DENSE_CELLS + 1).collect()
    table = left.sparkSession.createDataFrame(rows[:MAX_DENSE_CELLS], dense.schema).drop("_work") if rows else None
    return table, len(rows) > MAX_DENSE_CELLS


def box_join(
    left: DataFrame, right: DataFrame, size: float, prefix: str = "r_", cell_pairs: int = CELL_PAIRS, retries: int = 2
) -> DataFrame:
    """Inner join of all pairs whose boxes touch (boundaries count).

    A pair meets at the coarser of its two levels. One that shares several cells there is kept only in the
    cell of its corner (greatest xmin, greatest ymin), so no ``distinct`` is needed. Cells where both
    sides pile up are divided. With too many of them the whole grid is made finer first; what is dense
    even then (copies of one box) is left to the skew handling of the join itself.
    """
    in_left, in_right = _levels_present(left, right, size)
    lcells, rcells = _spread(left, size, in_right), _spread(right, size, in_left)
    dense, more = _dense_cells(lcells, rcells, cell_pairs)
    if more and retries:
        return box_join(left, right, size / 8.0, prefix, cell_pairs, retries - 1)
    lcells, rcells = _divide(lcells, dense), _divide(rcells, dense)
    keys = ["_lvl", "_cx", "_cy", "_sx", "_sy"]
    rcells = rcells.select(*keys, F.col("_own").alias("_rown"), *[F.col(c).alias(prefix + c) for c in right.columns])
    r = lambda c: F.col(prefix + c)
    corner_x, corner_y, s = F.greatest("xmin", r("xmin")), F.greatest("ymin", r("ymin")), F.col("_s")
    pairs = lcells.join(rcells, keys).where(
        (F.col("xmin") <= r("xmax")) & (r("xmin") <= F.col("xmax"))
        & (F.col("ymin") <= r("ymax")) & (r("ymin") <= F.col("ymax"))
        & (F.col("_lvl") == F.greatest("_own", "_rown"))
        & (_cell(corner_x, s) == F.col("_cx")) & (_cell(corner_y, s) == F.col("_cy"))
        & (_sub(corner_x, F.col("_cx"), s, F.col("_k")) == F.col("_sx"))
        & (_sub(corner_y, F.col("_cy"), s, F.col("_k")) == F.col("_sy"))
    )
    return pairs.drop(*keys, "_k", "_s", "_own", "_rown")


# --- exact predicates for general polygons ---------------------------------------------------------
def _arr(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], dtype=float)


def _orient(a, b, c):
    return np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))


def _on_box(a, b, p):
    return ((np.minimum(a, b) <= p) & (p <= np.maximum(a, b))).all(axis=-1)


def _inside(ring: np.ndarray, p: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]
    up = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[up], b[up]
    x = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((p[0] < x).sum() % 2)


def rings_touch(p: np.ndarray, q: np.ndarray) -> bool:
    """Closed polygons share at least one point: an edge pair meets, or one holds the other."""
    a, b = p[:-1, None, :], p[1:, None, :]
    c, d = q[None, :-1, :], q[None, 1:, :]
    o1, o2, o3, o4 = _orient(a, b, c), _orient(a, b, d), _orient(c, d, a), _orient(c, d, b)
    meets = (o1 * o2 < 0) & (o3 * o4 < 0)
    for o, s, e, x in ((o1, a, b, c), (o2, a, b, d), (o3, c, d, a), (o4, c, d, b)):
        meets |= (o == 0) & _on_box(s, e, x)
    return bool(meets.any()) or _inside(q, p[0]) or _inside(p, q[0])


def _clip_triangle(poly: np.ndarray, tri: np.ndarray) -> float:
    """Area of a convex polygon cut by a counter-clockwise triangle."""
    for i in range(3):
        if len(poly) == 0:
            return 0.0
        s, e = tri[i], tri[(i + 1) % 3]
        side = (e[0] - s[0]) * (poly[:, 1] - s[1]) - (e[1] - s[1]) * (poly[:, 0] - s[0])
        kept = []
        for j in range(len(poly)):
            k = (j + 1) % len(poly)
            if side[j] >= 0:
                kept.append(poly[j])
            if side[j] * side[k] < 0:
                kept.append(poly[j] + (poly[k] - poly[j]) * (side[j] / (side[j] - side[k])))
        poly = np.array(kept).reshape(-1, 2)
    if len(poly) < 3:
        return 0.0
    x, y = poly[:, 0], poly[:, 1]
    return 0.5 * abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))))


def _fan(ring: np.ndarray):
    for i in range(1, len(ring) - 2):
        t = np.array([ring[0], ring[i], ring[i + 1]])
        twice = (t[1, 0] - t[0, 0]) * (t[2, 1] - t[0, 1]) - (t[1, 1] - t[0, 1]) * (t[2, 0] - t[0, 0])
        if twice:
            yield (1.0, t) if twice > 0 else (-1.0, t[::-1])


def overlap_area(p: np.ndarray, q: np.ndarray) -> float:
    """Area shared by two simple polygons, convex or not: signed sum over triangle fans."""
    origin = p[0].copy()
    left, right = list(_fan(p - origin)), list(_fan(q - origin))
    return abs(sum(sp * sq * _clip_triangle(tp, tq) for sp, tp in left for sq, tq in right))


@F.pandas_udf(BooleanType())
def touch_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([rings_touch(_arr(x), _arr(y)) for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def overlap_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([overlap_area(_arr(x), _arr(y)) for x, y in zip(a, b)])


def touching_pairs(left: DataFrame, right: DataFrame, size: float, prefix: str = "r_", **kw) -> DataFrame:
    """Pairs of polygons that intersect; without a ``ring`` column the boxes are the geometry."""
    pairs = box_join(left, right, size, prefix, **kw)
    if "ring" in left.columns and "ring" in right.columns:
        pairs = pairs.where(touch_udf(F.col("ring"), F.col(prefix + "ring")))
    return pairs


# --- joins ------------------------------------------------------------------------------------------
def _shape(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns that are the geometry of a join: the ring where both sides have one, besides the box."""
    return [*BOX, "ring"] if "ring" in left.columns and "ring" in right.columns else list(BOX)


def _shapes(df: DataFrame, shape: list[str], *facts: Column) -> DataFrame:
    """Each geometry once, with ``facts`` about its copies; written, as a box join reads it three times."""
    folded = df.groupBy(*shape).agg(*facts) if facts else df.select(*shape).distinct()
    return materialise(folded, "shapes")


def _by_shape(parcels: DataFrame, found: DataFrame, shape: list[str], key: str) -> DataFrame:
    """What was found for a geometry, for every parcel that has it. Shuffled: an estimate by file size may be far too small to broadcast."""
    return parcels.select(key, *shape).join(found.hint("merge"), shape, "left").drop(*shape)


def spatial_left_join(parcels: DataFrame, layer: DataFrame, size: float, key: str = "parcel_id") -> DataFrame:
    """Polygon x polygon, *intersects*, left outer: parcels without a match keep one row of nulls.

    Only geometries are compared. A pair of them is kept as the left geometry and the number of the right one, and the rows of the
    result are made by the last joins and not moved any more; only a layer of more than ``MAX_COPIES`` rows is joined to the pairs before.
    """
    shape = _shape(parcels, layer)
    right = ["_of_" + c for c in layer.columns if c not in (*BOX, "ring")]
    numbered = materialise(layer.select(*shape).distinct().withColumn("_number", F.monotonically_increasing_id()), "shapes")
    pairs = touching_pairs(_shapes(parcels, shape), numbered, size).select(*shape, F.col("r__number").alias("_number"))
    copies = layer.join(numbered.hint("merge"), shape).select("_number", *[F.col(c.removeprefix("_of_")).alias(c) for c in right])
    copies = materialise(copies, "copies")
    if copies.count() <= MAX_COPIES:
        rows = _by_shape(parcels, pairs, shape, key).join(F.broadcast(copies), "_number", "left")
    else:
        rows = _by_shape(parcels, pairs.join(copies.hint("merge"), "_number").drop("_number"), shape, key)
    return rows.select(key, *[F.col(c).alias(c.removeprefix("_of_")) for c in right])


def assign_zone(parcels: DataFrame, zones: DataFrame, zone_col: str, size: float, key: str = "parcel_id") -> DataFrame:
    """Best zone per parcel: AU, then U, N, A, unknown; equal ranks by zone name. Copies of a parcel or
    of a zone are folded before the join."""
    shape = _shape(parcels, zones)
    zone = zone_code(F.col(zone_col))
    right = _shapes(zones, shape, F.min(F.struct(zone_rank(zone).alias("rank"), zone.alias("zone"))).alias("best"))
    pairs = touching_pairs(_shapes(parcels, shape), right, size)
    best = pairs.groupBy(*shape).agg(F.min("r_best")["zone"].alias("zone_plu"))
    return _by_shape(parcels, best, shape, key).withColumn("zone_plu", F.coalesce("zone_plu", F.lit("inconnu")))


def hazard_flags(
    parcels: DataFrame, hazards: DataFrame | None, layers: list[str], size: float, key: str = "parcel_id"
) -> DataFrame:
    """One boolean per layer: at least one hazard geometry touches the parcel. No source: NULL.

    Equal parcels and equal hazards are folded first, so a pile of copies costs one comparison.
    """
    names = [f"brgm_{name}_flag" for name in layers]
    if hazards is None:
        return parcels.select(key, *[F.lit(None).cast("boolean").alias(n) for n in names])
    if "xmin" not in hazards.columns:
        hazards = hazards.select("layer", *[F.col(c).alias(n) for n, c in zip(BOX, ("x", "y", "x", "y"))])
    shape = _shape(parcels, hazards)
    of_layer = [F.bool_or(F.col("layer") == l).alias(n) for l, n in zip(layers, names)]
    pairs = touching_pairs(_shapes(parcels, shape), _shapes(hazards, shape, *of_layer), size)
    hit = pairs.groupBy(*shape).agg(*[F.bool_or("r_" + n).alias(n) for n in names])
    return _by_shape(parcels, hit, shape, key).select(key, *[F.coalesce(n, F.lit(False)).alias(n) for n in names])


def built_area(parcels: DataFrame, buildings: DataFrame, size: float, key: str = "parcel_id") -> DataFrame:
    """Sum of parcel-building overlaps per parcel, zero without buildings; overlapping buildings add up.

    Equal parcels, and equal buildings with their count, are folded into one row before the join.
    """
    shape = _shape(parcels, buildings)
    pairs = box_join(_shapes(parcels, shape), _shapes(buildings, shape, F.count(F.lit(1)).alias("copies")), size)
    if "ring" in shape:
        shared = overlap_udf(F.col("ring"), F.col("r_ring"))
    else:
        w = F.least("xmax", "r_xmax") - F.greatest("xmin", "r_xmin")
        h = F.least("ymax", "r_ymax") - F.greatest("ymin", "r_ymin")
        shared = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    summed = pairs.groupBy(*shape).agg(F.sum(shared * F.col("r_copies")).alias("built_area"))
    return _by_shape(parcels, summed, shape, key).withColumn("built_area", F.coalesce("built_area", F.lit(0.0)))


def coverage(areas: DataFrame, max_ratio: float = MAX_COVERAGE_RATIO) -> DataFrame:
    """From ``area_m2`` and ``built_area``: existing ratio (clipped), residual ratio, residual footprint."""
    ces = F.least(F.greatest(F.try_divide(F.col("built_area"), F.col("area_m2")), F.lit(0.0)), F.lit(1.0))
    return (
        areas.withColumn("ces_existant", ces)
        .withColumn("ces_residuel", F.greatest(F.lit(0.0), F.lit(max_ratio) - F.col("ces_existant")))
        .withColumn("emprise_residuelle_m2", F.col("ces_residuel") * F.col("area_m2"))
    )


def _pieces(segments: DataFrame, longest: float) -> DataFrame:
    """Long segments cut into equal pieces, so that their boxes stay small."""
    span = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.ceil(span / longest), F.lit(1)).cast("int")
    cut = segments.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1)))
    along = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * (i / F.col("_n"))
    i, j = F.col("_i"), F.col("_i") + 1
    return cut.select(
        "x1", "y1", "x2", "y2",
        along("x1", "x2", i).alias("_x1"), along("y1", "y2", i).alias("_y1"), along("x1", "x2", j).alias("_x2"), along("y1", "y2", j).alias("_y2"),
    )


def nearest_segment_distance(
    points: DataFrame, segments: DataFrame, size: float, key: str = "parcel_id", out: str = "dist_road_m"
) -> DataFrame:
    """Distance from each point (``px``, ``py``) to its nearest segment (``x1 y1 x2 y2``).

    Each round registers a segment in the cells it may serve within one cell size and answers the points
    whose nearest candidate is that close; the rest go to the next round on a grid twice as coarse.
    Without segments the distance is NULL.
    """
    edge = segments.agg(
        F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))
    ).first()
    if edge[0] is None:
        return points.select(key, F.lit(None).cast("double").alias(out))
    ext = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if ext[0] is None:
        return points.select(key, F.lit(None).cast("double").alias(out))
    span = math.hypot(max(edge[1], ext[1]) - min(edge[0], ext[0]), max(edge[3], ext[3]) - min(edge[2], ext[2]))

    located = points.where(F.col("px").isNotNull() & F.col("py").isNotNull())
    answers = points.where(F.col("px").isNull() | F.col("py").isNull()).select(key, F.lit(None).cast("double").alias(out))
    todo = located.select(key, "px", "py")
    while True:
        last = size > span
        near = size * (1 + math.sqrt(0.5)) + 1e-6
        pieces = _pieces(segments.select("x1", "y1", "x2", "y2").distinct(), 8.0 * size)
        reach = lambda lo, hi: F.sequence(_cell(lo - near, size), _cell(hi + near, size))
        seg = (
            pieces
            .withColumn("_cx", F.explode(reach(F.least("_x1", "_x2"), F.greatest("_x1", "_x2"))))
            .withColumn("_cy", F.explode(reach(F.least("_y1", "_y2"), F.greatest("_y1", "_y2"))))
        )
        s = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
        piece = [F.col(c) for c in ("_x1", "_y1", "_x2", "_y2")]
        centre = G.segment_distance((F.col("_cx") + 0.5) * size, (F.col("_cy") + 0.5) * size, *piece)
        seg = seg.where(centre <= near).select("_cx", "_cy", "x1", "y1", "x2", "y2").distinct()
        cells = todo.withColumn("_cx", _cell(F.col("px"), size)).withColumn("_cy", _cell(F.col("py"), size))
        got = (
            cells.join(seg, ["_cx", "_cy"])
            .groupBy(key)
            .agg(F.min(G.segment_distance(F.col("px"), F.col("py"), *s)).alias(out))
        )
        if not last:
            got = got.where(F.col(out) <= size)
        got = cut_lineage(got)
        answers = answers.unionByName(got)
        if last:
            return answers
        todo = cut_lineage(todo.join(got.select(key), key, "left_anti"))
        if todo.isEmpty():
            return answers
        size *= 2
