"""Spatial joins by grid buckets: equi-joins on cells with the exact predicate behind.

A box is filed in every cell that it touches, grown by the tolerance; of the cells that two boxes share, only the one
with the least coordinates reports the pair, so no pair is made twice and no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotweave.functions import geometry as g

MAX_CELLS = 64  # boxes over more cells are filed in a coarser grid


def cells(df: DataFrame, cell: float, grow: float = 0.0, keys: tuple[str, str] = ("cx", "cy")) -> DataFrame:
    """One row for each grid cell that a box touches."""
    x0, y0, x1, y1 = g.box()
    span = lambda a, b: F.sequence(F.floor((a - grow) / cell), F.floor((b + grow) / cell))
    return df.withColumn(keys[0], F.explode(span(x0, x1))).withColumn(keys[1], F.explode(span(y0, y1)))


def level(cell: float, grow: float) -> Column:
    """Doublings of the cell after which a box touches at most MAX_CELLS cells."""
    x0, y0, x1, y1 = g.box()
    side = F.greatest(x1 - x0, y1 - y0) + 2 * grow
    reach = MAX_CELLS**0.5 - 1
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(1e-9)) / (cell * reach)))).cast("int")


def levels_of(*sides: DataFrame) -> list[int]:
    """The levels that any of the tables has, a few whole numbers."""
    return sorted({x[0] for side in sides for x in side.select("level").distinct().collect()})


def tiled(df: DataFrame, levels: list[int], cell: float, tol: float) -> DataFrame:
    """One row for each cell (grid, gx, gy) that a box touches, grown by half of ``tol``, in the grids of its own level and all coarser ones."""
    every = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    out = df.withColumn("grid", F.explode(F.filter(every, lambda v: v >= F.col("level"))))
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("grid"))
    x0, y0, x1, y1 = g.box()
    span = lambda a, b: F.sequence(F.floor((a - tol / 2) / size), F.floor((b + tol / 2) / size))
    return out.withColumn("gx", F.explode(span(x0, x1))).withColumn("gy", F.explode(span(y0, y1)))


def band_join(left: DataFrame, right: DataFrame, on: list[str], cell: float, tol: float, predicate: Column) -> DataFrame:
    """Pairs of boxes, as columns l_* and r_*, with equal ``on`` that meet ``predicate``, which implies nearness ``tol``.

    Boxes of all sizes are taken: each carries the level of its grid. A box is filed at its own level, and looks into
    the grids of all levels that the other side has; these are logarithmic in the largest box.
    """
    l, r = left.withColumn("level", level(cell, tol)), right.withColumn("level", level(cell, tol))
    levels = levels_of(l, r)

    def filed(df: DataFrame, prefix: str) -> DataFrame:
        out = tiled(df, levels, cell, tol)
        return out.select(*[F.col(c).alias(f"{prefix}{c}") for c in out.columns])

    a, b = filed(l, "l_"), filed(r, "r_")
    same = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in [*on, "grid", "gx", "gy"]]
    met = a.join(b, same)
    # the pair is reported at the coarser level of the two, in the first cell that both touch
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("l_grid"))
    low = lambda axis: F.greatest(F.floor((F.col(f"l_{axis}0") - tol / 2) / size), F.floor((F.col(f"r_{axis}0") - tol / 2) / size))
    once = (F.col("l_grid") == F.greatest("l_level", "r_level")) & (F.col("l_gx") == low("x")) & (F.col("l_gy") == low("y"))
    return met.where(once & predicate).drop(*[f"{p}{c}" for p in ("l_", "r_") for c in ("level", "grid", "gx", "gy")])


def near_pairs(boxes: DataFrame, on: list[str], key: str, tol: float, cell: float = 32.0) -> DataFrame:
    """Pairs l_key < r_key of boxes whose gaps are at most ``tol`` along both axes."""
    return band_join(boxes, boxes, on, cell, tol, g.near("l_", "r_", tol) & (F.col(f"l_{key}") < F.col(f"r_{key}")))


def within(boxes: DataFrame, points: DataFrame, on: list[str], cell: float = 32.0) -> DataFrame:
    """Pairs of a box (l_*) and a point box (r_*) that lies in it."""
    return band_join(boxes, points, on, cell, 0.0, g.contains("l_", "r_"))


def window_select(boxes: DataFrame, x0: float, y0: float, x1: float, y1: float, tol: float = 0.0) -> DataFrame:
    """Boxes that meet a window, with ``full`` for those that lie in it; plain range predicates that reach the scan."""
    a = g.box()
    meets = (a[0] <= x1 + tol) & (a[2] >= x0 - tol) & (a[1] <= y1 + tol) & (a[3] >= y0 - tol)
    return boxes.where(meets).withColumn("full", (a[0] >= x0 - tol) & (a[2] <= x1 + tol) & (a[1] >= y0 - tol) & (a[3] <= y1 + tol))
