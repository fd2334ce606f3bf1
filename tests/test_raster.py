from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import raster as R
from lotwise.operators import terrain_flow as T

ROWS, COLS = 23, 17


@pytest.fixture(scope="module")
def grid():
    rng = np.random.default_rng(5)
    z = np.round(rng.uniform(0, 20, (ROWS, COLS)), 2)
    z[3, 4] = z[10, 0] = np.nan
    return z


@pytest.fixture(scope="module")
def cells(spark, grid):
    rows = [(r, c, None if np.isnan(grid[r, c]) else float(grid[r, c])) for r in range(ROWS) for c in range(COLS)]
    return spark.createDataFrame(rows, "r long, c long, z double").cache()


def to_grid(df, col):
    out = np.full((ROWS, COLS), np.nan)
    for r in df.select("r", "c", F.col(col).cast("double").alias("v")).collect():
        out[r.r, r.c] = np.nan if r.v is None else r.v
    return out


def around(z, mode="edge"):
    p = np.pad(z, 1, mode=mode)
    return {k: p[1 + a : 1 + a + ROWS, 1 + b : 1 + b + COLS] for k, (a, b) in T.OFFSETS.items()}


@pytest.mark.parametrize("tile", [256, 5])
def test_slope_and_tri(cells, grid, tile):
    n = around(grid)
    dx = (n["ne"] + 2 * n["e"] + n["se"] - n["nw"] - 2 * n["w"] - n["sw"]) / 4
    dy = (n["sw"] + 2 * n["s"] + n["se"] - n["nw"] - 2 * n["n"] - n["ne"]) / 4
    want = np.where(np.isnan(grid), np.nan, np.degrees(np.arctan(np.hypot(dx, dy))))
    assert np.allclose(to_grid(R.slope(cells, tile=tile), "slope_deg"), want, equal_nan=True)
    tri = np.sqrt(sum((v - grid) ** 2 for v in n.values()))
    assert np.allclose(to_grid(R.tri_riley(cells, tile), "tri"), tri, equal_nan=True)


def test_aspect_and_hillshade(cells, grid):
    dy, dx = np.gradient(grid, 0.5)
    ang = np.degrees(np.arctan2(-dy, dx)) % 360
    want = np.where(np.isnan(grid), np.nan, ((ang >= 135) & (ang <= 225)).astype(float))
    assert np.allclose(to_grid(R.aspect_south(cells, tile=6), "aspect_south"), want, equal_nan=True)
    zen = np.pi / 2 - np.deg2rad(90 - 45.57 - 23.45)
    tilt = np.arctan(np.hypot(dx, dy))
    hs = np.clip(np.cos(zen) * np.cos(tilt) + np.sin(zen) * np.sin(tilt) * np.cos(np.arctan2(-dy, dx) - np.pi), 0, 1)
    hs[np.isnan(grid)] = np.nan
    assert np.allclose(to_grid(R.hillshade_winter(cells, tile=6), "hillshade"), hs, equal_nan=True)


@pytest.mark.parametrize("tile", [256, 4])
def test_curvature_with_reflected_edges(cells, grid, tile):
    f = np.where(np.isnan(grid), np.nanmedian(grid), grid)
    n = around(f)
    lap = (n["n"] + n["s"] + n["w"] + n["e"] - 4 * f) / 0.25
    p = np.pad(lap, 2, mode="symmetric")
    want = sum(p[a : a + ROWS, b : b + COLS] for a in range(5) for b in range(5)) / 25
    want[np.isnan(grid)] = np.nan
    assert np.allclose(to_grid(R.curvature(cells, tile=tile), "curvature"), want, equal_nan=True)


@pytest.mark.parametrize("tile", [256, 4])
def test_flat_components(spark, grid, tile):
    flat = np.nan_to_num(grid) > 8
    want, seen = {}, set()
    for start in zip(*np.where(flat)):
        if start in seen:
            continue
        part, queue = [], deque([start])
        seen.add(start)
        while queue:
            r, c = queue.popleft()
            part.append((r, c))
            for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= q[0] < ROWS and 0 <= q[1] < COLS and flat[q] and q not in seen:
                    seen.add(q)
                    queue.append(q)
        root = min((int(r) << 31) + int(c) for r, c in part)
        want.update({(int(r), int(c)): root for r, c in part})
    df = spark.createDataFrame([(r, c, int(flat[r, c])) for r in range(ROWS) for c in range(COLS)], "r long, c long, flat int")
    got = {(r.r, r.c): r.component for r in T.flat_components(df, tile).collect()}
    assert got == want


@pytest.mark.parametrize("tile", [256, 5])
def test_fill_and_drainage(cells, grid, tile):
    eps = 1e-3
    filled = to_grid(T.fill_depressions(cells, eps, tile), "filled")
    n = around(filled)
    p = np.pad(grid, 1, constant_values=np.nan)
    outlet = np.zeros((ROWS, COLS), bool)
    for a, b in T.OFFSETS.values():
        outlet |= np.isnan(p[1 + a : 1 + a + ROWS, 1 + b : 1 + b + COLS])
    low = np.fmin.reduce(list(n.values()))
    inner = ~outlet & ~np.isnan(grid)
    assert np.allclose(filled[~inner], grid[~inner], equal_nan=True)
    assert (filled[inner] >= grid[inner] - 1e-12).all()
    assert np.allclose(filled[inner], np.maximum(grid[inner], low[inner] + eps))  # least such surface drains

    df = T.fill_depressions(cells, eps, tile)
    pointers = T.d8_pointers(df, tile=tile)
    down = {r.key: r.to for r in pointers.where("z is not null").collect()}
    count = dict.fromkeys(down, 0)
    for k in down:
        while k is not None:
            count[k] += 1
            k = down[k]
    got = {(r.r << 31) + r.c: r.accumulation for r in T.flow_accumulation(pointers, tile).where("z is not null").collect()}
    assert got == count


def test_drainage_over_many_tiles_and_down_one_long_channel(spark):
    """A snake through all cells: every tile border is crossed many times."""
    side = 12
    path = [(r, c if r % 2 == 0 else side - 1 - c) for r in range(side) for c in range(side)]
    rows = [(r, c, float(-i), (r << 31) + c, (path[i + 1][0] << 31) + path[i + 1][1] if i + 1 < len(path) else None) for i, (r, c) in enumerate(path)]
    rows.append((side + 3, 0, None, (side + 3) << 31, None))
    df = spark.createDataFrame(rows, "r long, c long, z double, key long, to long")
    for tile in (1, 3, 5, 100):
        got = {(r.r, r.c): r.accumulation for r in T.flow_accumulation(df, tile).collect()}
        assert got == {rc: i + 1 for i, rc in enumerate(path)} | {(side + 3, 0): None}
    assert T.flow_accumulation(df.where("false")).collect() == []


def test_sky_view_is_one_on_a_plain_and_less_in_a_pit(spark):
    rows = [(r, c, 0.0 if (r, c) == (6, 6) else 5.0) for r in range(13) for c in range(13)]
    df = spark.createDataFrame(rows, "r long, c long, z double")
    got = {(r.r, r.c): r.svf for r in T.sky_view_factor(df, 1.0, tile=5).collect()}
    assert got[(0, 0)] == pytest.approx(1.0) and got[(6, 6)] < 0.2


def test_mosaic_first_tile_wins(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 1), (0, 0, 2.0, 2), (0, 1, None, 1), (0, 1, 7.0, 2), (1, 0, None, 1)], "r int, c int, z double, tile_order int")
    assert {(r.r, r.c): r.z for r in R.mosaic(df).collect()} == {(0, 0): 1.0, (0, 1): 7.0, (1, 0): None}
