"""Drawing frames and title blocks, by what hangs together with long lines at the edges.

Entities touch where their connection points fall on the same grid point. A flood from the seeds reaches exactly the
entities in the connected components of the seeds, so components are built once, for all drawings together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotweave.operators.graph import connected_components
from plotweave.plans.durable import Scratch

SPAN = 0.8  # share of the extent that a seed spans, and that a title block may not
TITLE = 0.3  # share of width and height of the zone at the lower right


def _edge(c: str, bound: str, eps: float) -> Column:
    return F.abs(F.col(c) - F.col(bound)) < eps


def touching(items: DataFrame, tol: float) -> DataFrame:
    """drawing, handle, component: entities that share grid points of side ``tol``, directly or through others.

    ``items`` has drawing, handle, points (array of x, y). The entities at a point hang on the least of them, so a point
    shared by many makes as many edges.
    """
    spots = items.select("drawing", "handle", F.explode("points").alias("p")).select("drawing", "handle", F.rint(F.col("p.x") / tol).cast("long").alias("u"), F.rint(F.col("p.y") / tol).cast("long").alias("v"))
    name = F.struct("drawing", "handle")
    least = spots.groupBy("drawing", "u", "v").agg(F.min("handle").alias("least"))
    edges = spots.join(least, ["drawing", "u", "v"]).select(name.alias("src"), F.struct("drawing", F.col("least").alias("handle")).alias("dst")).distinct()
    numbers = items.select("drawing", "handle").distinct().withColumn("n", F.monotonically_increasing_id())
    numbers = Scratch(items.sparkSession, "frames").write(numbers, "numbers")  # written, so that numbers stay
    side = lambda end: numbers.select(F.struct("drawing", "handle").alias(end), F.col("n").alias(f"{end}_n"))
    linked = edges.join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst"))
    found = connected_components(linked)
    return numbers.join(found, F.col("n") == F.col("node"), "left").select("drawing", "handle", F.coalesce("component", "n").alias("component"))


def frames(items: DataFrame, extents: DataFrame, frame_tol: float = 1.0, tol: float = 1.0) -> DataFrame:
    """drawing, handle, in_frame, on_border, in_title of every item.

    ``items`` has drawing, handle, x0, y0, x1, y1, points; ``extents`` drawing, x0, y0, x1, y1 of all its entities.
    Seeds lie at an edge and span more than SPAN of it, or have the extents themselves as their box; the frame is what
    touches them, directly or not. The border is those of the frame that lie flat at an edge over its span, or have the
    box of the extents. Inside is the frame without its border, or everything where there is no frame. The title zone
    holds what is inside and has its middle in the lower right TITLE by TITLE; see ``title_blocks``. Drawings without an area have no rows.
    """
    eps = max(2.0 * frame_tol, 5.0 * tol)
    e = extents.select(F.col("drawing").alias("of"), *(F.col(c).alias(f"e{c}") for c in ("x0", "y0", "x1", "y1"))).where("ex1 > ex0 and ey1 > ey0")
    w, h = F.col("ex1") - F.col("ex0"), F.col("ey1") - F.col("ey0")
    rows = items.join(e, F.col("drawing") == F.col("of")).drop("of")
    wide, high = (F.col("x1") - F.col("x0")) > w * SPAN, (F.col("y1") - F.col("y0")) > h * SPAN
    whole = _edge("x0", "ex0", eps) & _edge("y0", "ey0", eps) & _edge("x1", "ex1", eps) & _edge("y1", "ey1", eps)
    seed = ((_edge("y0", "ey0", eps) | _edge("y1", "ey1", eps)) & wide) | ((_edge("x0", "ex0", eps) | _edge("x1", "ex1", eps)) & high) | whole
    flat = lambda c, bound: _edge(f"{c}0", bound, eps) & _edge(f"{c}1", bound, eps)
    border = (wide & (flat("y", "ey0") | flat("y", "ey1"))) | (high & (flat("x", "ex0") | flat("x", "ex1"))) | whole
    scratch = Scratch(items.sparkSession, "frames")
    parts = touching(items, frame_tol).select(F.col("drawing").alias("c_drawing"), F.col("handle").alias("c_handle"), "component")
    marked = rows.join(parts, (F.col("drawing") == F.col("c_drawing")) & (F.col("handle") == F.col("c_handle"))).withColumns({"seed": seed, "border": border})
    marked = scratch.write(marked.select("drawing", "handle", "x0", "y0", "x1", "y1", "ex0", "ey0", "ex1", "ey1", "component", "seed", "border"), "marked")
    reached = marked.where("seed").select("component").distinct().withColumn("in_frame", F.lit(True))
    framed = marked.where("seed").select("drawing").distinct().withColumn("framed", F.lit(True))
    out = marked.join(reached, "component", "left").join(framed, "drawing", "left").withColumn("in_frame", F.coalesce("in_frame", F.lit(False)))
    out = out.withColumn("on_border", F.col("in_frame") & F.col("border"))
    inside = F.when(F.coalesce("framed", F.lit(False)), F.col("in_frame") & ~F.col("on_border")).otherwise(True)
    zone = ((F.col("x0") + F.col("x1")) * 0.5 >= F.col("ex1") - w * TITLE - eps) & ((F.col("y0") + F.col("y1")) * 0.5 <= F.col("ey0") + h * TITLE + eps)
    return out.select("drawing", "handle", "in_frame", "on_border", (inside & zone).alias("in_title"))


def title_blocks(items: DataFrame, extents: DataFrame, frame_tol: float = 1.0, tol: float = 1.0) -> DataFrame:
    """drawing, x0, y0, x1, y1: the box of what lies in the title zone; none where it spans over SPAN of the extent."""
    marked = frames(items, extents, frame_tol, tol).where("in_title").select("drawing", "handle")
    box = items.join(marked, ["drawing", "handle"]).groupBy("drawing").agg(*(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")))
    e = extents.select("drawing", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    small = (F.col("x1") - F.col("x0") <= F.col("w") * SPAN) & (F.col("y1") - F.col("y0") <= F.col("h") * SPAN)
    return box.join(e, "drawing").where(small).drop("w", "h")
