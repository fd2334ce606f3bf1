"""Raster cells against polygons: membership by cell centre, then plain grouped aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.functions import geometry as G
from lotwise.operators.order_stats import grouped_quantiles


def with_centres(cells: DataFrame, x0: float, y0: float, size: float = K.CELL_SIZE_M) -> DataFrame:
    """Centre coordinates of cells; rows run south from ``y0``, columns run east from ``x0``."""
    return cells.withColumns({"x": F.lit(x0) + (F.col("c") + 0.5) * size, "y": F.lit(y0) - (F.col("r") + 0.5) * size})


BUCKET_M = 16.0     # width of the finest buckets
SPAN = 8.0          # buckets that a zone is wide at most
MOST_ZONES = 2_000  # zones of one bucket in one part


def _bucket(v: Column, width: Column | float) -> Column:
    return F.floor(v / width).cast("long")


def _near_cells(cells: DataFrame, zones: DataFrame, key: str, reach: float, width: float | None, most: int = MOST_ZONES) -> DataFrame:
    """Cells within the box of each zone, widened by ``reach``: equi-join on buckets, then the box.

    Zones are on levels by their size: a level has buckets four times as wide as the one before, and a zone is on the first
    level where it is at most ``SPAN`` buckets wide, so it is spread over some eighty buckets at most, however large it is. A cell
    lies in one bucket of each level that has zones. Buckets with more than ``most`` zones are divided: their zones are dealt over
    parts and their cells go to each part, so a pile of zones is no single task.
    """
    base = width or BUCKET_M
    shape = ["xmin", "ymin", "xmax", "ymax", *(["ring"] if "ring" in zones.columns else [])]
    widest = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) + 2 * reach
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(widest, F.lit(1e-9)) / (SPAN * base)) / 2)).cast("int")
    leveled = zones.select(key, *shape).withColumn("_lvl", level)
    levels = sorted(r["_lvl"] for r in leveled.where("_lvl is not null").select("_lvl").distinct().collect())  # logarithms of widths
    side = F.pow(F.lit(4.0), F.col("_lvl")) * base
    span = lambda lo, hi: F.sequence(_bucket(F.col(lo) - reach, side), _bucket(F.col(hi) + reach, side))
    spread = leveled.withColumn("_bx", F.explode(span("xmin", "xmax"))).withColumn("_by", F.explode(span("ymin", "ymax")))
    at = ["_lvl", "_bx", "_by"]
    piles = spread.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")).where("_parts > 1")  # one row per ``most`` zones
    parts = F.coalesce("_parts", F.lit(1))
    spread = spread.join(piles, at, "left").withColumn("_part", F.pmod(F.xxhash64(key), parts).cast("int")).drop("_parts")
    placed = cells.withColumn("_lvl", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    placed = placed.withColumns({"_bx": _bucket(F.col("x"), side), "_by": _bucket(F.col("y"), side)})
    placed = placed.join(piles, at, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    x, y = F.col("x"), F.col("y")
    inside = (
        (x >= F.col("xmin") - reach) & (x <= F.col("xmax") + reach) & (y >= F.col("ymin") - reach) & (y <= F.col("ymax") + reach)
    )
    # shuffled: zones are small by the size of their file, but not spread over buckets
    return placed.join(spread.hint("merge"), [*at, "_part"]).where(inside).drop(*at, "_part")


def cells_in_polygons(cells: DataFrame, zones: DataFrame, key: str = "parcel_id", width: float | None = None) -> DataFrame:
    """Pairs (zone, cell) whose centre lies inside the polygon."""
    near = _near_cells(cells, zones, key, 0.0, width)
    if "ring" in zones.columns:
        near = near.where(G.contains_point(F.col("ring"), F.col("x"), F.col("y"))).drop("ring")
    return near.drop("xmin", "ymin", "xmax", "ymax")


def cells_within(cells: DataFrame, zones: DataFrame, distance: float = K.HEIGHT_BUFFER_M, key: str = "parcel_id", width: float | None = None) -> DataFrame:
    """Pairs (zone, cell) whose centre lies within ``distance`` of the polygon."""
    near = _near_cells(cells, zones, key, distance, width)
    x, y = F.col("x"), F.col("y")
    if "ring" in zones.columns:
        gap = G.ring_distance(F.col("ring"), x, y)
    else:
        dx = F.greatest(F.col("xmin") - x, F.lit(0.0), x - F.col("xmax"))
        dy = F.greatest(F.col("ymin") - y, F.lit(0.0), y - F.col("ymax"))
        gap = F.sqrt(dx * dx + dy * dy)
    near = near.where(gap <= distance)
    return near.drop("xmin", "ymin", "xmax", "ymax", "ring")


def zonal_stats(zones: DataFrame, members: DataFrame, value: str, prefix: str, stats: Sequence[str] = ("mean", "max", "min", "std", "count"), key: str = "parcel_id") -> DataFrame:
    """Mean, max, min, population std and count per zone; a zone without a known cell gets NULLs."""
    agg = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_pop, "count": F.count}
    got = members.groupBy(key).agg(*[agg[s](value).alias(f"{prefix}_{s}") for s in stats])
    return zones.select(key).join(got.hint("merge"), key, "left")


def zonal_percentiles(
    zones: DataFrame, members: DataFrame, value: str, prefix: str, percents: Sequence[int] = (50, 90),
    key: str = "parcel_id", size: float = K.CELL_SIZE_M,
) -> DataFrame:
    """Exact percentiles and population std per zone. Zone boxes bound the cells of a zone."""
    widest = zones.agg(F.max((F.col("xmax") - F.col("xmin") + size) * (F.col("ymax") - F.col("ymin") + size))).first()[0]
    bound = math.ceil((widest or 0.0) / (size * size))
    got = grouped_quantiles(
        members, [key], [(F.col(value), {f"{prefix}_p{p}": p / 100.0 for p in percents})],
        [F.stddev_pop(value).alias(f"{prefix}_std")], known_max=bound,
    )
    return zones.select(key).join(got.hint("merge"), key, "left")


def flat_area(zones: DataFrame, members: DataFrame, key: str = "parcel_id", area: str = "area_m2") -> DataFrame:
    """Share of flat cells, and the area it amounts to (the total, not the largest patch)."""
    got = members.groupBy(key).agg(F.avg("flat").alias("flat_area_ratio"))
    return zones.select(key, area).join(got.hint("merge"), key, "left").select(
        key, "flat_area_ratio", (F.col(area) * F.col("flat_area_ratio")).alias("max_flat_area_m2")
    )
