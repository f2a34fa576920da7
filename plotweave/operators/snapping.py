"""Snapping of end points to nodes, and arrows between the nodes.

Points come in an order. A point belongs to the first node, in that order, that lies within ``tol``; where there is
none it becomes a node. So a point is a node exactly if no earlier node is within ``tol`` of it.

Drawings of moderate size are walked as they are. Points of larger ones are dealt to tiles of many tolerances. A tile gets the points around it as well and is walked in order; it
decides its own points as far as all earlier points near them are decided, and leaves the others to the next round,
when the tiles beside it have gone on. So chains of decisions run through a tile in one round, and rounds only count
how often a chain crosses tiles. No list of pairs is made.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plotweave.plans.durable import Scratch
from plotweave.plans.groups import over_groups

TILE = 64  # tolerances a tile is wide
WHOLE = 100_000  # segments of a drawing that one task walks
_OPEN, _NODE, _TAKEN = 0, 1, 2
_STATE = "drawing long, x double, y double, at long, state int"


def _dealt(points: DataFrame, tol: float) -> DataFrame:
    """``points`` with the tile u, v, once for each tile that they lie in or within ``tol`` of."""
    side = TILE * tol
    tiles = lambda c: F.sequence(F.floor((F.col(c) - tol) / side), F.floor((F.col(c) + tol) / side))
    out = points.withColumn("u", F.explode(tiles("x"))).withColumn("v", F.explode(tiles("y")))
    return out.withColumn("own", (F.floor(F.col("x") / side) == F.col("u")) & (F.floor(F.col("y") / side) == F.col("v")))


class _Near:
    """Points of a tile by cells of the tolerance."""

    def __init__(self, tol: float):
        self.tol, self.cells = tol, {}

    def add(self, x: float, y: float, at: int) -> None:
        self.cells.setdefault((math.floor(x / self.tol), math.floor(y / self.tol)), []).append((at, x, y))

    def least(self, x: float, y: float) -> int | None:
        """The least number of the points within the tolerance."""
        u, v, best = math.floor(x / self.tol), math.floor(y / self.tol), None
        for i in (u - 1, u, u + 1):
            for j in (v - 1, v, v + 1):
                for at, px, py in self.cells.get((i, j), ()):
                    if (best is None or at < best) and math.sqrt((px - x) * (px - x) + (py - y) * (py - y)) <= self.tol:
                        best = at
        return best


def _walk(tol: float):
    def walk(tile: pd.DataFrame) -> pd.DataFrame:
        """The tile's own points, decided as far as they can be."""
        tile = tile.sort_values("at", kind="stable")
        nodes, waiting, found = _Near(tol), _Near(tol), []
        for at, x, y, state, own in zip(tile["at"], tile["x"], tile["y"], tile["state"], tile["own"]):
            if state == _OPEN:
                if nodes.least(x, y) is not None:
                    state = _TAKEN
                elif own and waiting.least(x, y) is None:
                    state = _NODE
                else:
                    waiting.add(x, y, at)
            if state == _NODE:
                nodes.add(x, y, at)
            if own:
                found.append(state)
        out = tile[tile["own"]]
        return out.assign(state=found)[["drawing", "x", "y", "at", "state"]]

    return walk


def _assign(tol: float):
    def assign(tile: pd.DataFrame) -> pd.DataFrame:
        """The first node within the tolerance of each of the tile's own points."""
        nodes = _Near(tol)
        for at, x, y, state in zip(tile["at"], tile["x"], tile["y"], tile["state"]):
            if state == _NODE:
                nodes.add(x, y, at)
        out = tile[tile["own"]]
        return out.assign(node=[nodes.least(x, y) for x, y in zip(out["x"], out["y"])])[["drawing", "x", "y", "node"]]

    return assign


def snapped(points: DataFrame, tol: float = 2.0) -> DataFrame:
    """The rows of ``points`` (drawing, at, x, y, ...) with node, node_x, node_y.

    ``at`` orders a drawing's points and is unique in it; a node has the ``at`` of the point that it began with. Equal
    places are decided once, by their first point. Rows without a drawing, number or finite place get no node. Drawings
    are apart. An empty table gives an empty result. A tile holds the different places of 64 x 64 tolerances.
    """
    scratch = Scratch(points.sparkSession, "snapping")
    fit = F.col("drawing").isNotNull() & F.col("at").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    own = points.where(fit).select(F.col("drawing").cast("long").alias("drawing"), (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"), F.col("at").cast("long").alias("at"))
    now = scratch.write(own.groupBy("drawing", "x", "y").agg(F.min("at").alias("at")).withColumn("state", F.lit(_OPEN)), "state")
    while not now.where(F.col("state") == _OPEN).isEmpty():
        now = scratch.write(_dealt(now, tol).groupBy("drawing", "u", "v").applyInPandas(_walk(tol), _STATE), "state")
    places = _dealt(now, tol).groupBy("drawing", "u", "v").applyInPandas(_assign(tol), "drawing long, x double, y double, node long")
    nodes = now.where(F.col("state") == _NODE).select(F.col("drawing").alias("n_drawing"), F.col("at").alias("n_at"), F.col("x").alias("node_x"), F.col("y").alias("node_y"))
    found = places.join(nodes, (F.col("drawing") == F.col("n_drawing")) & (F.col("node") == F.col("n_at"))).select(
        F.col("drawing").alias("p_drawing"), F.col("x").alias("p_x"), F.col("y").alias("p_y"), "node", "node_x", "node_y")
    found = scratch.write(found, "found")
    scratch.drop("state")
    return points.join(found, (F.col("drawing") == F.col("p_drawing")) & (F.col("x") == F.col("p_x")) & (F.col("y") == F.col("p_y")) & F.col("at").isNotNull(), "left").drop("p_drawing", "p_x", "p_y")


def _drawings(tol: float):
    def walk(columns: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
        """Both nodes of each segment of whole drawings, whose segments come in order."""
        n = len(columns["segment"])
        sides = [(columns[f"x{k}"] + 0.0, columns[f"y{k}"] + 0.0) for k in (0, 1)]
        fit = [np.isfinite(x) & np.isfinite(y) for x, y in sides]
        xs, ys, fits = [x.tolist() for x, _ in sides], [y.tolist() for _, y in sides], [f.tolist() for f in fit]
        node = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
        segment, first = columns["segment"].tolist(), set(starts.tolist())
        spots: dict[int, tuple[float, float]] = {}  # of a drawing's nodes
        at_x, at_y = [[0.0] * n, [0.0] * n], [[0.0] * n, [0.0] * n]
        for row in range(n):
            if row in first:
                nodes, spots, known = _Near(tol), {}, {}
            for k in (0, 1):
                if not fits[k][row]:
                    continue
                x, y = xs[k][row], ys[k][row]
                at = known.get((x, y))
                if at is None:
                    at = nodes.least(x, y)
                    if at is None:
                        at = segment[row] * 2 + k
                        nodes.add(x, y, at)
                        spots[at] = (x, y)
                    known[x, y] = at
                node[k][row] = at
                at_x[k][row], at_y[k][row] = spots[at]
        out: dict[str, np.ndarray | pa.Array] = {"drawing": columns["drawing"], "segment": columns["segment"]}
        for k, name in enumerate("ab"):
            for c, values in ((name, node[k]), (f"{name}x", np.array(at_x[k])), (f"{name}y", np.array(at_y[k]))):
                out[c] = pa.array(values, mask=~fit[k])
        return out

    return walk


def snapped_segments(segments: DataFrame, tol: float = 2.0) -> DataFrame:
    """drawing, segment, a, ax, ay, b, bx, by: segments between nodes; ``segments`` has drawing, segment, x0, y0, x1, y1.

    Points come segment by segment, the start before the end. Drawings of up to WHOLE segments are walked as they are,
    many in a task; larger ones, and those with segments without a number, go by tiles.
    """
    rows = segments.select(F.col("drawing").cast("long").alias("drawing"), F.col("segment").cast("long").alias("segment"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    scratch = Scratch(segments.sparkSession, "segments")
    counts = rows.groupBy("drawing").agg(F.count(F.lit(1)).alias("n"), F.count("segment").alias("numbered"))
    hard = scratch.write(counts.where(f"drawing is null or n > {WHOLE} or numbered < n").select(F.col("drawing").alias("hard")), "hard")
    none = hard.isEmpty()
    plain = rows if none else rows.where("drawing is not null").join(hard, F.col("drawing") == F.col("hard"), "left_anti")
    found = over_groups(plain, ["drawing"], ["segment"], _drawings(tol), "drawing long, segment long, a long, ax double, ay double, b long, bx double, by double")
    if none:
        return found
    return found.union(_tiled_segments(rows.join(hard, F.col("drawing").eqNullSafe(F.col("hard")), "left_semi"), tol))


def _tiled_segments(segments: DataFrame, tol: float) -> DataFrame:
    ends = F.array(*(F.struct((F.col("segment") * 2 + k).alias("at"), F.lit(k).alias("side"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)))
    points = snapped(segments.select("drawing", "segment", F.inline(ends)), tol)
    of = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    return points.groupBy("drawing", "segment").agg(of(0, "node").alias("a"), of(0, "node_x").alias("ax"), of(0, "node_y").alias("ay"), of(1, "node").alias("b"), of(1, "node_x").alias("bx"), of(1, "node_y").alias("by"))


def angle_between(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Degrees between two vectors; 180 where one is shorter than a millionth."""
    nu, nv = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / (nu * nv)))
    return F.when((nu < 1e-6) | (nv < 1e-6), 180.0).otherwise(F.degrees(F.acos(cos)))


def arrows(segments: DataFrame, tol: float = 2.0, least: float = 20.0, most: float = 140.0) -> DataFrame:
    """drawing, tip, first, second, tip_x, tip_y, dir_x, dir_y: each pair of segments at a node whose angle lies between the bounds.

    ``first`` and ``second`` number the segments, in their order. The direction is the unit mean of both vectors away from the
    tip; pairs whose mean vanishes are left out, as are segments that snap to one node. The result has a row for each pair,
    so a node of many segments has many.
    """
    s = snapped_segments(segments, tol).where("a != b")
    out = s.select("drawing", F.inline(F.array(
        F.struct(F.col("a").alias("tip"), "segment", F.col("ax").alias("x"), F.col("ay").alias("y"), (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy")),
        F.struct(F.col("b").alias("tip"), "segment", F.col("bx").alias("x"), F.col("by").alias("y"), (F.col("ax") - F.col("bx")).alias("dx"), (F.col("ay") - F.col("by")).alias("dy")))))
    out = Scratch(segments.sparkSession, "arrows").write(out, "spokes")  # read twice below
    other = out.select("drawing", "tip", F.col("segment").alias("second"), F.col("dx").alias("ex"), F.col("dy").alias("ey"))
    met = out.withColumnRenamed("segment", "first").join(other, ["drawing", "tip"]).where("first < second")
    angle = angle_between(F.col("dx"), F.col("dy"), F.col("ex"), F.col("ey"))
    mx, my = (F.col("dx") + F.col("ex")) * 0.5, (F.col("dy") + F.col("ey")) * 0.5
    long = F.sqrt(mx * mx + my * my)
    return met.where((angle > least) & (angle < most) & (long >= 1e-3)).select("drawing", "tip", "first", "second", F.col("x").alias("tip_x"), F.col("y").alias("tip_y"), (mx / long).alias("dir_x"), (my / long).alias("dir_y"))


def arrow_direction(segments: DataFrame, rects: DataFrame) -> DataFrame:
    """drawing, direction: Inward, Outward or Unknown by the first arrow head among the segments inside each drawing's rectangle.

    ``rects`` has drawing, x0, y0, x1, y1. Segments count whose ends lie in the rectangle grown by its margin, 5 % of the
    smaller side between 1 and 8; their ends snap at 1.2 margins. The head is the first node, by the order of points, with an arrow.
    Near the far end of the longer axis (a tenth of it, 3 at least) it points outward, near the other inward; between them the middle decides.
    """
    w, h = F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0")
    r = rects.select(F.col("drawing"), *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1"))).withColumn("margin", F.least(F.greatest(F.least(w, h) * 0.05, F.lit(1.0)), F.lit(8.0)))
    inside = lambda x, y: F.col(x).between(F.col("rx0") - F.col("margin"), F.col("rx1") + F.col("margin")) & F.col(y).between(F.col("ry0") - F.col("margin"), F.col("ry1") + F.col("margin"))
    lines = segments.join(r, "drawing").where(inside("x0", "y0") & inside("x1", "y1"))
    # tolerances differ, so places are measured in them: one tolerance is one unit
    unit = F.col("margin") * 1.2
    scaled = lines.select("drawing", "segment", *((F.col(c) / unit).alias(c) for c in ("x0", "y0", "x1", "y1")))
    first = arrows(scaled, 1.0).groupBy("drawing").agg(F.min(F.struct("tip", "tip_x", "tip_y")).alias("head"))
    found = r.join(first, "drawing", "left")
    flat = w >= h
    head = F.when(flat, F.col("head.tip_x")).otherwise(F.col("head.tip_y")) * unit
    low, high = F.when(flat, F.col("rx0")).otherwise(F.col("ry0")), F.when(flat, F.col("rx1")).otherwise(F.col("ry1"))
    long = high - low
    near = F.greatest(long * 0.1, F.lit(3.0))
    side = F.when(head.isNull() | (long <= 0), "Unknown").when(F.abs(head - high) < near, "Outward").when(F.abs(head - low) < near, "Inward").when(head >= (low + high) * 0.5, "Outward").otherwise("Inward")
    return found.select("drawing", side.alias("direction"))
