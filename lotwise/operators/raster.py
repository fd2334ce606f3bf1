"""Focal operators on a cell table (``r``, ``c``, ``z``; NULL is nodata, the grid is dense).

Cells are sent once to fixed-size tiles, with a rim of copies from the neighbouring tiles. Windows along
rows and columns then run inside a tile, so one shuffle serves the whole stencil and no task ever holds
more than a tile.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.functions.numeric import add_all
from lotwise.operators.order_stats import medians

TILE = 256
RING = ("nw", "n", "ne", "w", "e", "sw", "s", "se")


def scan_cells(df: DataFrame, nodata: float = K.NODATA) -> DataFrame:
    """Nodata and NaN to NULL."""
    z = F.col("z").cast("double")
    return df.withColumn("z", F.when((z == nodata) | F.isnan(z), None).otherwise(z))


def mosaic(cells: DataFrame, order: str = "tile_order", null_yields: bool = True) -> DataFrame:
    """Union of overlapping tiles: per cell the first tile in order that has a value."""
    known = F.when(F.col("z").isNotNull(), F.col(order))
    first = F.min_by("z", known if null_yields else F.col(order))
    return cells.groupBy("r", "c").agg(first.alias("z"))


def raster_profile(cells: DataFrame, size: float, expected: float = K.CELL_SIZE_M) -> DataFrame:
    """Extent, size and nodata count, with the checks as columns."""
    return cells.agg(
        F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"),
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("z").isNull()).alias("n_nodata"),
    ).withColumns(
        {
            "n_rows": F.col("r_max") - F.col("r_min") + 1,
            "n_cols": F.col("c_max") - F.col("c_min") + 1,
            "res_ok": F.lit(abs(size - expected) < 0.01),
        }
    ).withColumn("dense", F.col("n_rows") * F.col("n_cols") == F.col("n_cells"))


def with_halo(cells: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """Cells copied to every tile whose rim they belong to; ``core`` marks the tile that owns the cell."""
    reach = lambda v: F.sequence(F.floor((v - halo) / tile), F.floor((v + halo) / tile))
    spread = cells.withColumn("tr", F.explode(reach(F.col("r")))).withColumn("tc", F.explode(reach(F.col("c"))))
    core = (F.floor(F.col("r") / tile) == F.col("tr")) & (F.floor(F.col("c") / tile) == F.col("tc"))
    return spread.withColumn("core", core).repartition("tr", "tc")


def _step(name: str, along: str, column: Column, back: bool, window) -> Column:
    """Neighbour's value one step along an axis; at the raster edge the cell itself (nearest)."""
    shift = F.lag if back else F.lead
    beside = shift(F.col(along)).over(window) == F.col(along) + (-1 if back else 1)
    return F.when(beside, shift(column).over(window)).otherwise(column).alias(name)


def neighbours(cells: DataFrame, tile: int = TILE, value: str = "z") -> DataFrame:
    """The 3x3 surroundings of every cell, edges replicated, and flags for the raster edge."""
    df = with_halo(cells, 1, tile)
    row = W.partitionBy("tr", "tc", "r").orderBy("c")
    col = W.partitionBy("tr", "tc", "c").orderBy("r")
    v = F.col(value)
    other = [c for c in cells.columns if c not in ("r", "c", value)]
    df = df.select(
        "tr", "tc", "core", "r", "c", *other, v.alias(value),
        _step("w", "c", v, True, row), _step("e", "c", v, False, row),
        F.coalesce(F.lag("c").over(row) == F.col("c") - 1, F.lit(False)).alias("has_w"),
        F.coalesce(F.lead("c").over(row) == F.col("c") + 1, F.lit(False)).alias("has_e"),
    )
    line = F.struct("w", value, "e")
    df = df.select(
        "*", _step("_u", "r", line, True, col), _step("_d", "r", line, False, col),
        F.coalesce(F.lag("r").over(col) == F.col("r") - 1, F.lit(False)).alias("has_n"),
        F.coalesce(F.lead("r").over(col) == F.col("r") + 1, F.lit(False)).alias("has_s"),
    ).where("core")
    u, d = F.col("_u"), F.col("_d")
    return df.select(
        "r", "c", *other, value,
        u["w"].alias("nw"), u[value].alias("n"), u["e"].alias("ne"), "w", "e",
        d["w"].alias("sw"), d[value].alias("s"), d["e"].alias("se"),
        "has_w", "has_e", "has_n", "has_s",
    )


def horn_slope(size: float = K.CELL_SIZE_M) -> Column:
    """Slope in degrees from the columns of ``neighbours``; any null neighbour gives NULL."""
    c = {k: F.col(k) for k in (*RING, "z")}
    dx = ((c["ne"] + c["e"] * 2.0 + c["se"]) - (c["nw"] + c["w"] * 2.0 + c["sw"])) / (8 * size)
    dy = ((c["sw"] + c["s"] * 2.0 + c["se"]) - (c["nw"] + c["n"] * 2.0 + c["ne"])) / (8 * size)
    # the centre has no weight in the kernel but must be known
    return F.when(c["z"].isNotNull(), F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))))


def slope(cells: DataFrame, size: float = K.CELL_SIZE_M, tile: int = TILE) -> DataFrame:
    return neighbours(cells, tile).select("r", "c", "z", horn_slope(size).alias("slope_deg"))


def tri_riley(cells: DataFrame, tile: int = TILE) -> DataFrame:
    squares = [(F.col(k) - F.col("z")) * (F.col(k) - F.col("z")) for k in RING]
    return neighbours(cells, tile).select("r", "c", F.sqrt(add_all(squares)).alias("tri"))


def _gradient(low: str, high: str, has_low: str, has_high: str, size: float) -> Column:
    """Central inside, one-sided at the edge."""
    lo, hi, z = F.col(low), F.col(high), F.col("z")
    return (
        F.when(F.col(has_low) & F.col(has_high), (hi - lo) / (2 * size))
        .when(F.col(has_high), (hi - z) / size)
        .when(F.col(has_low), (z - lo) / size)
    )


def gradients(cells: DataFrame, size: float = K.CELL_SIZE_M, tile: int = TILE) -> DataFrame:
    """``dx`` along columns and ``dy`` along rows."""
    return neighbours(cells, tile).select(
        "r", "c", "z",
        _gradient("w", "e", "has_w", "has_e", size).alias("dx"),
        _gradient("n", "s", "has_n", "has_s", size).alias("dy"),
    )


def hillshade_winter(cells: DataFrame, size: float = K.CELL_SIZE_M, tile: int = TILE) -> DataFrame:
    """Illumination at noon of the winter solstice, 0..1."""
    elevation = math.radians(90.0 - K.SUN_LATITUDE_DEG + K.SUN_DECLINATION_DEG)
    zenith = math.pi / 2 - elevation
    dx, dy = F.col("dx"), F.col("dy")
    tilt = F.atan(F.sqrt(dx * dx + dy * dy))
    aspect = F.atan2(-dy, dx)
    light = F.cos(tilt) * math.cos(zenith) + F.sin(tilt) * math.sin(zenith) * F.cos(aspect - math.pi)
    shade = F.when(light.isNotNull() & F.col("z").isNotNull(), F.least(F.greatest(light, F.lit(0.0)), F.lit(1.0)))
    return gradients(cells, size, tile).select("r", "c", shade.alias("hillshade"))


def aspect_south(cells: DataFrame, size: float = K.CELL_SIZE_M, tile: int = TILE) -> DataFrame:
    """1 where the mathematical angle lies in 135..225 degrees. Only a null centre is NULL."""
    angle = F.pmod(F.degrees(F.atan2(-F.col("dy"), F.col("dx"))), F.lit(360.0))
    south = F.coalesce((angle >= 135) & (angle <= 225), F.lit(False)).cast("int")
    return gradients(cells, size, tile).select("r", "c", F.when(F.col("z").isNotNull(), south).alias("aspect_south"))


def curvature(cells: DataFrame, size: float = K.CELL_SIZE_M, tile: int = TILE) -> DataFrame:
    """Laplacian of the median-filled surface, smoothed by a 5x5 mean with reflected edges."""
    fill = medians(cells, ["z"])["z"]
    edge = cells.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    if edge[0] is None:
        return cells.select("r", "c", F.lit(None).cast("double").alias("curvature"))
    df = with_halo(cells, 3, tile).withColumn("f", F.coalesce("z", F.lit(0.0 if fill is None else fill)))
    row = W.partitionBy("tr", "tc", "r").orderBy("c")
    col = W.partitionBy("tr", "tc", "c").orderBy("r")
    f = F.col("f")
    df = df.select("*", _step("w", "c", f, True, row), _step("e", "c", f, False, row))
    df = df.select("*", _step("n", "r", f, True, col), _step("s", "r", f, False, col))
    lap = (F.col("n") + F.col("s") + F.col("w") + F.col("e") - f * 4.0) / (size * size)
    df = df.withColumn("lap", lap)

    def mirrored(v: str, low: int, high: int) -> Column:
        x = F.col(v)
        return F.array_compact(
            F.array(x, F.when(x - low < 2, F.lit(2 * low - 1) - x), F.when(F.lit(high) - x < 2, F.lit(2 * high + 1) - x))
        )

    df = df.select("tr", "tc", "core", "z", "lap", F.col("r").alias("r0"), F.col("c").alias("c0"),
                   F.explode(mirrored("r", edge[0], edge[1])).alias("r"), "c")
    df = df.select("tr", "tc", "core", "z", "lap", "r0", "c0", "r", F.explode(mirrored("c", edge[2], edge[3])).alias("c"))
    df = df.withColumn("_m", F.avg("lap").over(row.rowsBetween(-2, 2)))
    df = df.withColumn("_m", F.avg("_m").over(col.rowsBetween(-2, 2)))
    real = F.col("core") & (F.col("r") == F.col("r0")) & (F.col("c") == F.col("c0"))
    return df.where(real).select("r", "c", F.when(F.col("z").isNotNull(), F.col("_m")).alias("curvature"))


def flat_mask(slopes: DataFrame, limit: float = K.FLAT_SLOPE_DEG) -> DataFrame:
    flat = F.when(F.col("slope_deg").isNotNull(), (F.col("slope_deg") <= limit).cast("int"))
    return slopes.withColumn("flat", flat)


def raster_summary(df: DataFrame, column: str) -> DataFrame:
    """Mean and minimum over known cells, number of ones and their share of all cells."""
    ones = F.count_if(F.col(column) == 1)
    return df.agg(
        F.avg(column).alias("mean_value"), F.min(column).cast("double").alias("min_value"),
        ones.alias("n_ones"), (ones / F.count(F.lit(1))).alias("share_ones"),
    )


def twi(df: DataFrame, size: float = K.CELL_SIZE_M) -> DataFrame:
    """Topographic wetness from ``accumulation`` and ``slope_deg``, capped."""
    steep = F.greatest(F.radians("slope_deg"), F.lit(math.radians(K.TWI_MIN_SLOPE_DEG)))
    area = F.greatest(F.col("accumulation") * (size * size), F.lit(size * size))
    index = F.least(F.log(area / F.tan(steep)), F.lit(K.TWI_CAP))
    known = F.col("slope_deg").isNotNull() & F.col("accumulation").isNotNull()
    return df.withColumn("twi", F.when(known, index))


def thalweg_mask(df: DataFrame, min_cells: int = K.THALWEG_MIN_CELLS) -> DataFrame:
    wet = (F.col("accumulation") >= min_cells).cast("int")
    return df.withColumn("thalweg", F.when(F.col("z").isNotNull(), wet))
