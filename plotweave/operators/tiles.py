"""Components of boxes that are near each other, without a list of pairs.

A box is filed in the tiles that it touches, as in ``spatial``; pairs that meet share a tile. Inside a tile boxes are
united as a sweep along x finds them, and only boxes that are still apart are compared, so a tile hands on one row a box
with the least key of its part. Boxes that lie in several tiles then join parts, which are far fewer than pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plotweave.functions import geometry as g
from plotweave.operators.graph import connected_components
from plotweave.operators.spatial import level, levels_of, tiled
from plotweave.plans.durable import Scratch
from plotweave.plans.groups import over_groups

Test = Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]  # the sides of boxes, and the rows of each pair
_AT_ONCE = 100_000  # pairs that are held before they are united


def _gaps(box: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x0, y0, x1, y1 = box
    return np.maximum(x0[p] - x1[q], x0[q] - x1[p]), np.maximum(y0[p] - y1[q], y0[q] - y1[p])


def near(tol: float) -> Test:
    """``geometry.near`` of rows."""

    def test(box: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
        gx, gy = _gaps(box, p, q)
        return (gx <= tol) & (gy <= tol)

    return test


def merges(gap: float, ratio: float | None = None) -> Test:
    """``geometry.merges`` of rows."""

    def test(box: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
        gx, gy = _gaps(box, p, q)
        ux, uy = np.maximum(gx, 0.0), np.maximum(gy, 0.0)
        close = (np.sqrt(ux * ux + uy * uy) < gap) | ((gx <= 0.0) & (gy <= 0.0))
        if ratio is None:
            return close
        x0, y0, x1, y1 = box
        area = lambda r: (x1[r] - x0[r]) * (y1[r] - y0[r])
        a, b = area(p), area(q)
        small, large = np.minimum(a, b), np.maximum(a, b)
        return (small > 0) & (large >= ratio * small) & close

    return test


def _unite(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Give the rows of each pair, and all that hang on them, the least label."""
    while len(p):
        a, b = label[p], label[q]
        apart = a != b
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            deeper = label[label]
            if np.array_equal(deeper, label):
                break
            label[:] = deeper


class _Found:
    """Pairs that are held for a while."""

    def __init__(self, label: np.ndarray):
        self.label, self.pairs, self.size = label, [], 0

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        if len(p):
            self.pairs.append((p, q))
            self.size += len(p)
        if self.size > _AT_ONCE:
            self.settle()

    def settle(self) -> None:
        if self.pairs:
            _unite(self.label, *(np.concatenate(side) for side in zip(*self.pairs)))
            self.pairs, self.size = [], 0


def _sweep(box: list[np.ndarray], rows: np.ndarray, tile: np.ndarray, found: _Found, tol: float, test: Test) -> None:
    """Unite ``rows``, which are sorted by tile and x0; the d-th step asks each row's d-th follower, until that lies beyond its reach."""
    x0, x1, own, label = box[0][rows], box[2][rows], tile[rows], found.label
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(rows) else np.array([], int)
    number = np.repeat(np.arange(len(first)), np.diff([*first, len(rows)]))
    end = np.append(first[1:], len(rows))[number] if len(rows) else number
    now, step = np.arange(len(rows)), 1
    while len(now):
        now = now[now + step < end[now]]
        now = now[x0[now + step] - x1[now] <= tol]
        p, q = rows[now], rows[now + step]
        apart = label[p] != label[q]
        p, q = p[apart], q[apart]
        met = test(box, p, q)
        found.add(p[met], q[met])
        if step & (step - 1) == 0 or step % 32 == 0:
            found.settle()
            whole = np.minimum.reduceat(label[rows], first) == np.maximum.reduceat(label[rows], first)
            now = now[~whole[number[now]]]  # a tile in one part needs no more
        step += 1
    found.settle()


def _parts(tol: float, test: Test):
    def walk(columns: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        """For each row of some tiles the least key of its part."""
        key = columns["node"]
        box = [columns[c] for c in g.BOX]
        native = columns["level"] == columns["grid"]
        ends = np.append(starts[1:], len(key))
        tile = np.repeat(np.arange(len(starts)), ends - starts)
        found = _Found(np.arange(len(key)))
        _sweep(box, np.flatnonzero(native), tile, found, tol, test)
        # boxes of finer grids meet those of this grid alone; among themselves they meet in their own
        mixed = np.add.reduceat(~native, starts) * np.add.reduceat(native, starts) if len(key) else []
        for k in np.flatnonzero(mixed):
            own = np.arange(starts[k], ends[k])
            guests = own[~native[own]]
            for row in own[native[own]]:
                others = guests[found.label[guests] != found.label[row]]
                met = others[test(box, np.full(len(others), row), others)]
                found.add(met, np.full(len(met), row))
        found.settle()
        least = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(least, found.label, key)
        return {"node": key, "root": least[found.label]}

    return walk


def near_components(boxes: DataFrame, on: list[str], key: str, tol: float, test: Test, cell: float = 32.0) -> DataFrame:
    """(node, component) of the boxes with a place, node being ``key`` (whole numbers): the least key that is reached.

    Boxes link that have equal ``on`` and meet ``test``, which implies gaps of at most ``tol``. A tile's boxes are held by one task.
    """
    scratch = Scratch(boxes.sparkSession, "tiles")
    rows = boxes.select(*on, F.col(key).cast("long").alias("node"), *(F.col(c).cast("double").alias(c) for c in g.BOX)).dropna().withColumn("level", level(cell, tol))
    found = levels_of(rows)
    filed = tiled(rows, found, cell, tol)
    place = [*on, "grid", "gx", "gy"]
    if len(found) > 1:  # a box of a finer grid goes where one of this grid is
        native = filed.where("level = grid")
        filed = native.union(filed.where("level < grid").join(native.select(*place).distinct(), place, "left_semi").select(*native.columns))
    parts = over_groups(filed, place, ["x0"], _parts(tol, test), "node long, root long")
    roots = scratch.write(parts.groupBy("node").agg(F.collect_set("root").alias("roots")), "roots")
    first = F.array_min("roots")
    links = roots.where("size(roots) > 1").select(F.explode("roots").alias("src"), first.alias("dst")).where("src != dst").distinct()
    joined = connected_components(links).select(F.col("node").alias("root"), "component")
    return roots.select("node", first.alias("root")).join(joined, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
