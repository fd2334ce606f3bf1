"""Iterative terrain operators: connected flat areas, depression filling, drainage, sky view.

Work inside a tile of fixed size is done by numpy in one task per tile; what crosses tiles is exchanged
by Spark. Every round ends in a reliable checkpoint, and results do not depend on tiles or partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.operators.raster import RING, TILE, neighbours, with_halo
from lotwise.session import cut_lineage

OFFSETS = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}


def cell_key(r: Column, c: Column) -> Column:
    return F.shiftleft(r.cast("long"), 31) + c.cast("long")


# --- connected components ------------------------------------------------------------------------------
def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """4-connected components within one tile, named by their smallest cell key.

    Every pair of neighbours pulls the roots of both to the lesser one, and roots are then looked up until they are their own: a few
    rounds over arrays, whatever the shape.
    """
    keys = (pdf["r"].to_numpy(np.int64) << 31) + pdf["c"].to_numpy(np.int64)
    order = np.argsort(keys, kind="stable")
    cells = keys[order]
    ends = []
    for step in (1, 1 << 31):  # the cell to the right, the cell below
        at = np.minimum(np.searchsorted(cells, cells + step), len(cells) - 1)
        here = np.flatnonzero(cells[at] == cells + step)
        ends.append((here, at[here]))
    a, b = (np.concatenate(x) for x in zip(*ends))
    root = np.arange(len(cells))
    while True:
        low = np.minimum(root[a], root[b])
        if (low == root[a]).all() and (low == root[b]).all():
            break
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    label = np.empty(len(cells), np.int64)
    label[order] = cells[root]
    return pdf.assign(local=label)[["r", "c", "local"]]


def connected_groups(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of an undirected graph (``a``, ``b``) -> (``node``, ``root``).

    Each round takes the least root among the neighbours and then the root's own root.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        near = (
            both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("_r")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("_r").alias("_near"))
        )
        low = roots.join(near, "node").select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("_low"))
        jump = roots.select(F.col("node").alias("_low"), F.col("root").alias("_far"))
        step = low.join(jump, "_low", "left").select("node", "_old", F.least("_low", "_far").alias("root"))
        step = cut_lineage(step)
        moved = step.where(F.col("root") < F.col("_old")).limit(1).count()
        roots = step.select("node", "root")
        if not moved:
            return roots


def flat_components(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """Component of every flat cell: labels within tiles, then merged over tile borders."""
    flat = mask.where(F.col("flat") == 1).select("r", "c")
    tiled = flat.withColumn("tr", F.floor(F.col("r") / tile)).withColumn("tc", F.floor(F.col("c") / tile))
    local = tiled.groupBy("tr", "tc").applyInPandas(_label_tile, "r long, c long, local long")
    local = cut_lineage(local)
    right = local.where(F.pmod("c", F.lit(tile)) == tile - 1).select("r", (F.col("c") + 1).alias("c"), F.col("local").alias("a"))
    below = local.where(F.pmod("r", F.lit(tile)) == tile - 1).select((F.col("r") + 1).alias("r"), "c", F.col("local").alias("a"))
    firsts = local.where((F.pmod("c", F.lit(tile)) == 0) | (F.pmod("r", F.lit(tile)) == 0)).withColumnRenamed("local", "b")
    links = right.unionByName(below).join(firsts, ["r", "c"]).select("a", "b").distinct()
    groups = connected_groups(links).withColumnRenamed("node", "local")
    return local.join(groups, "local", "left").select("r", "c", F.coalesce("root", "local").alias("component"))


# --- depression filling ----------------------------------------------------------------------------------
def _grid(pdf: pd.DataFrame, name: str, fill: float = np.nan):
    r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
    shape = (int(pdf["r"].max()) - r0 + 1, int(pdf["c"].max()) - c0 + 1)
    out = np.full(shape, fill)
    at = (pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0)
    out[at] = pdf[name].to_numpy(dtype=float)
    return out, at


def _relax(z: np.ndarray, w: np.ndarray, free: np.ndarray, eps: float) -> np.ndarray:
    """Lower the water of free cells until each stands at its ground or just above a neighbour."""
    while True:
        p = np.pad(np.where(np.isnan(w), np.inf, w), 1, constant_values=np.inf)
        low = np.full(z.shape, np.inf)
        for dr, dc in OFFSETS.values():
            low = np.minimum(low, p[1 + dr : 1 + dr + z.shape[0], 1 + dc : 1 + dc + z.shape[1]])
        target = np.maximum(z, low + eps)
        better = free & (target < w)
        if not better.any():
            return w
        w = np.where(better, target, w)


def fill_depressions(cells: DataFrame, eps: float = 1e-4, tile: int = TILE) -> DataFrame:
    """Raised surface on which every cell drains (``filled``): least ``w >= z`` with a neighbour below it.

    Cells at the raster edge or beside nodata are outlets. A tile is relaxed to rest against its rim; the
    rounds go on while any tile still changes.
    """
    ring_known = F.lit(True)
    for k in RING:
        ring_known = ring_known & F.col(k).isNotNull()
    inner = F.col("has_w") & F.col("has_e") & F.col("has_n") & F.col("has_s") & ring_known
    start = neighbours(cells, tile).select(
        "r", "c", "z", (inner & F.col("z").isNotNull()).alias("free")
    ).withColumn("w", F.when(F.col("free"), F.lit(float("inf"))).otherwise(F.col("z")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, at = _grid(pdf, "z")
        w, _ = _grid(pdf, "w")
        free, _ = _grid(pdf.assign(f=(pdf["free"] & pdf["core"]).astype(float)), "f", 0.0)
        new = _relax(z, w, free > 0, eps)
        out = pdf.assign(new=new[at])
        out = out[out["core"]]
        return out.assign(moved=(out["new"] < out["w"]), w=out["new"])[["r", "c", "z", "free", "w", "moved"]]

    state = cut_lineage(start)
    while True:
        tiles = with_halo(state, 1, tile)
        state = cut_lineage(tiles.groupBy("tr", "tc").applyInPandas(run, "r long, c long, z double, free boolean, w double, moved boolean"))
        moved = state.where("moved").limit(1).count()
        state = state.drop("moved")
        if not moved:
            known = F.when(F.isnan("w"), None).otherwise(F.col("w"))
            z = F.when(F.isnan("z"), None).otherwise(F.col("z"))
            return state.select("r", "c", z.alias("z"), known.alias("filled"))


# --- drainage ----------------------------------------------------------------------------------------------
def d8_pointers(surface: DataFrame, value: str = "filled", tile: int = TILE) -> DataFrame:
    """Key of the cell each cell drains to: steepest drop among eight, ties in reading order."""
    near = neighbours(surface.select("r", "c", F.col(value).alias("z")), tile)
    drops = []
    for i, (k, (dr, dc)) in enumerate(OFFSETS.items()):
        drop = (F.col("z") - F.col(k)) / math.hypot(dr, dc)
        to = cell_key(F.col("r") + dr, F.col("c") + dc)
        drops.append(F.when(drop > 0, F.struct(drop.alias("drop"), F.lit(-i).alias("order"), to.alias("to"))))
    best = F.array_max(F.array_compact(F.array(*drops)))
    return near.select("r", "c", "z", cell_key(F.col("r"), F.col("c")).alias("key"), best["to"].alias("to"))


def _local_flow(pdf: pd.DataFrame, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What drains through each cell of a tile when ``start`` begins in each, and the cell in another tile where its water goes (-1: none)."""
    keys = pdf["key"].to_numpy(np.int64)
    to = np.where(pdf["to"].isna(), -1, pdf["to"].fillna(-1)).astype(np.int64) if len(pdf) else np.zeros(0, np.int64)
    order = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys[order], to), max(0, len(keys) - 1))
    down = np.where((to >= 0) & (keys[order][at] == to), order[at], -1) if len(pdf) else to
    waiting = np.bincount(down[down >= 0], minlength=len(keys))
    flow, steps, ready = start.astype(np.int64), [], np.flatnonzero(waiting == 0)
    while len(ready):  # all cells that wait for no other, then those that these were waited for by
        steps.append(ready)
        into = down[ready]
        onward = into >= 0
        np.add.at(flow, into[onward], flow[ready][onward])
        np.subtract.at(waiting, into[onward], 1)
        into = np.unique(into[onward])
        ready = into[waiting[into] == 0]
    leaves = np.where(down >= 0, -1, to)
    for ready in reversed(steps):
        into = down[ready]
        leaves[ready] = np.where(into >= 0, leaves[into], leaves[ready])
    return flow, leaves


def _accumulated_forest(nodes: DataFrame) -> DataFrame:
    """``acc`` of each node (``key``, ``to``, ``acc``) and of all nodes above it, by pointer doubling.

    After round i every node knows those up to ``2**i`` steps upstream, so the rounds grow with the logarithm of the longest
    path. What is sent to one node is summed before it is shuffled.
    """
    nodes = cut_lineage(nodes)
    while True:
        active = nodes.where(F.col("to").isNotNull())
        if active.limit(1).count() == 0:
            return nodes.select("key", "acc")
        gain = active.groupBy(F.col("to").alias("key")).agg(F.sum("acc").alias("gain"))
        hop = nodes.select(F.col("key").alias("to"), F.col("to").alias("next"))
        summed = nodes.join(gain, "key", "left").withColumn("acc", F.col("acc") + F.coalesce("gain", F.lit(0))).drop("gain")
        moved = summed.where(F.col("to").isNotNull()).join(hop, "to", "left").select("key", F.col("next").alias("to"), "acc")
        rest = summed.where(F.col("to").isNull()).select("key", "to", "acc")
        nodes = cut_lineage(moved.unionByName(rest))


def flow_accumulation(pointers: DataFrame, tile: int = TILE) -> DataFrame:
    """Number of cells that drain through each cell, itself included.

    Each tile is drained by itself in the order of the water. What leaves it enters another tile at one of its border cells, and
    each border cell drains to one border cell of another tile or to none: this forest, a sixtieth of the cells, is
    accumulated by doubling. A second pass drains each tile with what enters it.
    """
    cells = pointers.select("r", "c", "z", "key", F.when(F.col("z").isNotNull(), F.col("to")).alias("to"))
    tile_of = lambda x: F.floor(F.col(x) / tile)
    tiled = cells.withColumns({"tr": tile_of("r"), "tc": tile_of("c")})

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["z"].notna()].reset_index(drop=True)
        flow, leaves = _local_flow(pdf, np.ones(len(pdf)))
        rim = np.flatnonzero(pdf["r"].mod(tile).isin((0, tile - 1)) | pdf["c"].mod(tile).isin((0, tile - 1)))
        out = np.flatnonzero(leaves >= 0)
        out = out[pdf["to"].to_numpy()[out] == leaves[out]]  # the cells that drain out of the tile themselves
        known = pd.DataFrame({"key": pdf["key"].to_numpy()[rim], "to": pd.array(np.where(leaves[rim] >= 0, leaves[rim], 0), "Int64"), "acc": 0})
        known.loc[leaves[rim] < 0, "to"] = pd.NA
        sent = pd.DataFrame({"key": leaves[out], "to": pd.array([pd.NA] * len(out), "Int64"), "acc": flow[out]})
        return pd.concat([known, sent])

    rims = tiled.groupBy("tr", "tc").applyInPandas(borders, "key long, to long, acc long")
    entering = _accumulated_forest(rims.groupBy("key").agg(F.max("to").alias("to"), F.sum("acc").alias("acc"))).where("acc > 0")

    def drain(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["r"].notna()
        enters = pdf[~known].set_index("key")["acc"]
        out = pdf[known & pdf["z"].notna()].reset_index(drop=True)
        flow, _ = _local_flow(out, 1 + out["key"].map(enters).fillna(0).to_numpy(np.int64))
        dry = pdf[known & pdf["z"].isna()]
        both = pd.concat([out.assign(accumulation=pd.array(flow, "Int64")), dry.assign(accumulation=pd.array([pd.NA] * len(dry), "Int64"))])
        return both[["r", "c", "z", "accumulation"]]

    nothing = lambda kind: F.lit(None).cast(kind)
    r, c = F.shiftright("key", 31), F.col("key").bitwiseAND((1 << 31) - 1)
    enters = entering.select(
        nothing("long").alias("r"), nothing("long").alias("c"), nothing("double").alias("z"), "key", nothing("long").alias("to"),
        F.floor(r / tile).alias("tr"), F.floor(c / tile).alias("tc"), "acc",
    )
    return tiled.withColumn("acc", F.lit(0).cast("long")).unionByName(enters).groupBy("tr", "tc").applyInPandas(drain, "r long, c long, z double, accumulation long")


# --- sky view ------------------------------------------------------------------------------------------------
def sky_offsets(directions: int = 16, radius: int = 10) -> list[list[tuple[int, int]]]:
    """Cells met along each direction, nearest first, by rounding third-of-a-cell steps."""
    out = []
    for d in range(directions):
        angle = 2 * math.pi * d / directions
        seen: list[tuple[int, int]] = []
        for step in range(3 * (radius - 1) + 1):
            dist = 1 + step / 3
            cell = (int(round(-math.sin(angle) * dist)), int(round(math.cos(angle) * dist)))
            if cell not in seen:
                seen.append(cell)
        out.append(seen)
    return out


def sky_view_factor(cells: DataFrame, size: float = K.CELL_SIZE_M, directions: int = 16, radius: int = 10, tile: int = TILE) -> DataFrame:
    """One minus the mean sine of the horizon angle over the directions; cells without a value hide nothing."""
    offsets = sky_offsets(directions, radius)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, at = _grid(pdf, "z")
        h, w = z.shape
        padded = np.pad(z, radius, constant_values=np.nan)
        total = np.zeros(z.shape)
        for line in offsets:
            steepest = np.zeros(z.shape)
            for dr, dc in line:
                seen = padded[radius + dr : radius + dr + h, radius + dc : radius + dc + w]
                rise = (seen - z) / (math.hypot(dr, dc) * size)
                steepest = np.fmax(steepest, rise)
            total += np.sin(np.arctan(steepest))
        svf = 1.0 - total / len(offsets)
        svf[np.isnan(z)] = np.nan
        out = pdf.assign(svf=svf[at])
        return out[out["core"]][["r", "c", "svf"]]

    tiles = with_halo(cells.select("r", "c", "z"), radius, tile)
    out = tiles.groupBy("tr", "tc").applyInPandas(run, "r long, c long, svf double")
    return out.withColumn("svf", F.when(~F.isnan("svf"), F.col("svf")))
