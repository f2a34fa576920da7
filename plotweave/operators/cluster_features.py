"""Features of clusters of entities, as the ordered rules ask for them: their main rectangle and what lies in it.

``members`` has key (the cluster), seq (the order of its entities), type, pts (array of x, y: ends, vertices or
centre), closed, radius. Pairs are made inside a cluster only, and only of the kinds that a feature speaks of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotweave.functions import geometry as g
from plotweave.operators import features, loops, snapping
from plotweave.plans.durable import Scratch


def lines(members: DataFrame) -> DataFrame:
    """key, seq, ax, ay, bx, by of the lines."""
    p, q = F.get("pts", F.lit(0)), F.get("pts", F.lit(1))
    return members.where("type = 'LINE' and size(pts) >= 2").select("key", "seq", p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))


def circles(members: DataFrame) -> DataFrame:
    """key, circle, cx, cy, r."""
    p = F.get("pts", F.lit(0))
    return members.where("type = 'CIRCLE'").select("key", F.col("seq").alias("circle"), p["x"].alias("cx"), p["y"].alias("cy"), F.col("radius").alias("r"))


def outlines(members: DataFrame) -> DataFrame:
    """key, owner, closed, pts, n and the box of the lightweight polylines."""
    rows = members.where("type = 'LWPOLYLINE' and size(pts) > 0")
    return rows.select("key", F.col("seq").alias("owner"), F.coalesce("closed", F.lit(False)).alias("closed"), "pts", F.size("pts").alias("n"), F.array_min("pts.x").alias("x0"), F.array_min("pts.y").alias("y0"), F.array_max("pts.x").alias("x1"), F.array_max("pts.y").alias("y1"))


def segments(members: DataFrame) -> DataFrame:
    """key, segment, x0, y0, x1, y1: the lines, then the segments of polylines, the closing one last."""
    of_lines = lines(members).select("key", F.col("seq").alias("owner"), F.lit(0).alias("part"), F.lit(0).alias("at"), F.col("ax").alias("x0"), F.col("ay").alias("y0"), F.col("bx").alias("x1"), F.col("by").alias("y1"))
    o = outlines(members).withColumn("seq", F.when(F.col("closed"), F.concat("pts", F.slice("pts", 1, 1))).otherwise(F.col("pts")))
    pair = F.zip_with(F.slice("seq", 1, F.size("seq") - 1), F.slice("seq", 2, F.size("seq") - 1), lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")))
    of_outlines = o.where("size(seq) > 1").select("key", "owner", F.lit(1).alias("part"), F.posexplode(pair).alias("at", "s")).select("key", "owner", "part", "at", "s.*")
    return of_lines.union(of_outlines)


def main_rectangles(members: DataFrame) -> DataFrame:
    """key, x0, y0, x1, y1, n_rects: the box of the largest rectangle of a cluster, of equals the first.

    Rectangles are closed polylines along their box; where there is none, the first loop of four lines counts, however many lines the cluster has.
    """
    rects = outlines(members).where(features.is_rectangle())
    w, h = features.sides()
    best = F.min(F.struct((-(w * h)).alias("less"), "owner", "x0", "y0", "x1", "y1")).alias("best")
    found = rects.groupBy("key").agg(best, F.count(F.lit(1)).alias("n_rects")).select("key", "best.x0", "best.y0", "best.x1", "best.y1", "n_rects")
    own = lines(members).join(found.select("key"), "key", "left_anti")
    loop = loops.four_line_loops(own.select(F.col("key").alias("cluster"), F.col("seq").alias("line"), F.col("ax").alias("x0"), F.col("ay").alias("y0"), F.col("bx").alias("x1"), F.col("by").alias("y1")), most=None)
    low, high = (lambda c: F.least(*(F.col(f"{c}{k}") for k in range(4)))), (lambda c: F.greatest(*(F.col(f"{c}{k}") for k in range(4))))
    return found.union(loop.select(F.col("cluster"), low("x"), low("y"), high("x"), high("y"), F.lit(0).cast("long")))


def fan_circles(members: DataFrame) -> DataFrame:
    """key, circle, cx, cy, r of the circles that three lines at least run through.

    Such a line ends within 1.8 radii of the centre on both sides and passes it within 0.4 radii, 3 at least.
    """
    c, s = circles(members), lines(members)
    away = lambda x, y: F.hypot(F.col(x) - F.col("cx"), F.col(y) - F.col("cy"))
    near = F.greatest(F.col("r") * 0.4, F.lit(3.0))
    within = (away("ax", "ay") <= F.col("r") * 1.8) & (away("bx", "by") <= F.col("r") * 1.8)
    past = g.distance_to_segment(*(F.col(n) for n in ("cx", "cy", "ax", "ay", "bx", "by")))
    met = c.join(s, "key").where(within & ((away("ax", "ay") < near) | (away("bx", "by") < near) | (past < near)))
    return met.groupBy("key", "circle", "cx", "cy", "r").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")


def inside(x: str, y: str, margin: Column | float = 0.0) -> Column:
    """Whether a point lies in the rectangle rx0, ry0, rx1, ry1 grown by ``margin``, its sides included."""
    return (F.col(x) >= F.col("rx0") - margin) & (F.col(x) <= F.col("rx1") + margin) & (F.col(y) >= F.col("ry0") - margin) & (F.col(y) <= F.col("ry1") + margin)


def _flag(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("key").distinct().withColumn(name, F.lit(True))


def joined_rectangles(members: DataFrame) -> DataFrame:
    """key of the clusters whose two largest rectangles are joined: by a line that ends at both, or another polyline with vertices at both; at is within 5 of the box."""
    rects = outlines(members).where(features.is_rectangle())
    w, h = features.sides()
    two = rects.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct((-(w * h)).alias("less"), "owner", "x0", "y0", "x1", "y1"))), 1, 2).alias("two")).where("size(two) = 2")
    at = lambda k, x, y: (x >= F.col("two")[k]["x0"] - 5.0) & (x <= F.col("two")[k]["x1"] + 5.0) & (y >= F.col("two")[k]["y0"] - 5.0) & (y <= F.col("two")[k]["y1"] + 5.0)
    by_line = lines(members).join(two, "key").where((at(0, F.col("ax"), F.col("ay")) | at(0, F.col("bx"), F.col("by"))) & (at(1, F.col("ax"), F.col("ay")) | at(1, F.col("bx"), F.col("by"))))
    others = outlines(members).select("key", "owner", "pts").join(two, "key").where((F.col("owner") != F.col("two")[0]["owner"]) & (F.col("owner") != F.col("two")[1]["owner"]))
    by_outline = others.where(F.exists("pts", lambda v: at(0, v["x"], v["y"])) & F.exists("pts", lambda v: at(1, v["x"], v["y"])))
    return by_line.select("key").union(by_outline.select("key")).distinct()


def air_curtains(members: DataFrame, rects: DataFrame) -> DataFrame:
    """key of the clusters with a rectangle of 3 to 1 or longer and three arrows at least on its right that point to the right on the whole."""
    r = _named(rects)
    w, h = F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0")
    long = r.where((w > 0) & (h > 0) & (F.greatest(w, h) >= 3.0 * F.least(w, h)))
    margin = F.least(F.greatest(F.least(w, h) * 0.8, F.lit(5.0)), F.lit(80.0))
    boxes = members.where("type in ('LINE', 'LWPOLYLINE') and size(pts) > 1").select("key", F.col("seq").alias("owner"), F.array_min("pts.x").alias("bx0"), F.array_min("pts.y").alias("by0"), F.array_max("pts.x").alias("bx1"), F.array_max("pts.y").alias("by1")).join(long, "key")
    close = boxes.where((F.col("bx0") <= F.col("rx1") + margin) & (F.col("bx1") >= F.col("rx0") - margin) & (F.col("by0") <= F.col("ry1") + margin) & (F.col("by1") >= F.col("ry0") - margin))
    near = segments(members).join(close.select("key", "owner"), ["key", "owner"])
    number = (F.col("part") * 1_000_000_000 + F.col("owner") * 10_000 + F.col("at")).cast("long")  # lines first, then polylines, as they are walked
    arrows = snapping.arrows(near.select(F.col("key").alias("drawing"), number.alias("segment"), "x0", "y0", "x1", "y1"))
    seen = arrows.withColumnRenamed("drawing", "key").join(long, "key")
    right = (F.col("tip_x") >= F.col("rx1") - 1.0) & (F.col("tip_x") <= F.col("rx1") + F.greatest(w * 1.5, F.lit(10.0))) & (F.col("tip_y") >= F.col("ry0") - 5.0) & (F.col("tip_y") <= F.col("ry1") + 5.0)
    total = seen.groupBy("key").agg(F.count_if(right).alias("n_right"), F.avg("dir_x").alias("mx"), F.avg("dir_y").alias("my")).withColumn("long", F.hypot("mx", "my"))
    return total.where((F.col("n_right") >= 3) & (F.col("long") >= 1e-3) & (F.col("mx") >= 0.2 * F.col("long"))).select("key")


def _named(rects: DataFrame) -> DataFrame:
    return rects.select("key", *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))


def cluster_features(members: DataFrame) -> DataFrame:
    """The feature columns of every cluster, but for its texts and block names, which the caller joins.

    has_rect, ratio (longer over shorter side), n_rects, joined, fan_like, fan_in_rect, circle_in_rect, m_shape,
    w_shape, diamonds (inside), diagonal, air_curtain, arrow_way (Inward, Outward or null), n_lines, n_circles.
    Clusters of any size are taken; one without entities doesn't exist. Entities without points have no part but in counts.
    """
    scratch = Scratch(members.sparkSession, "features")
    members = scratch.write(members.select("key", "seq", "type", "pts", "closed", "radius"), "members")  # every feature reads them
    rects = scratch.write(main_rectangles(members), "rects")
    r = _named(rects)
    w, h = F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0")
    counts = members.groupBy("key").agg(F.count_if(F.col("type") == "LINE").alias("n_lines"), F.count_if(F.col("type") == "CIRCLE").alias("n_circles"))
    fans = fan_circles(members)
    tol = F.least(F.greatest(F.least(w, h) * 0.05, F.lit(1.0)), F.lit(10.0))
    fan_in = fans.join(r, "key").where((F.col("cx") - F.col("r") >= F.col("rx0") - tol) & (F.col("cy") - F.col("r") >= F.col("ry0") - tol) & (F.col("cx") + F.col("r") <= F.col("rx1") + tol) & (F.col("cy") + F.col("r") <= F.col("ry1") + tol))
    circle_in = circles(members).join(r, "key").where(inside("cx", "cy"))
    within = lines(members).join(r, "key").where(inside("ax", "ay") & inside("bx", "by"))
    m_lines = features.m_lines(within.select("key", (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy")), ["key"]).where("m_shape")
    o = outlines(members).join(r, "key").where(inside("x0", "y0", tol) & inside("x1", "y1", tol))
    w_shape = o.where(features.is_w_shape(w, h))
    diamonds = o.where(features.is_diamond()).groupBy("key").agg(F.count(F.lit(1)).alias("diamonds"))
    s = segments(members).join(r, "key").where(inside("x0", "y0") & inside("x1", "y1"))
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    diagonal = s.where((dx >= 1.0) & (dy >= 1.0) & (F.hypot(dx, dy) >= F.greatest(F.least(w, h) * 0.3, F.lit(5.0))))
    ways = snapping.arrow_direction(lines(members).select(F.col("key").alias("drawing"), F.col("seq").alias("segment"), F.col("ax").alias("x0"), F.col("ay").alias("y0"), F.col("bx").alias("x1"), F.col("by").alias("y1")), rects.withColumnRenamed("key", "drawing"))
    out = counts.join(rects, "key", "left")
    for part, name in ((fans, "has_fan"), (fan_in, "fan_in_rect"), (circle_in, "circle_in_rect"), (m_lines, "m_of_lines"), (w_shape, "w_shape"), (diagonal, "diagonal"), (joined_rectangles(members), "joined"), (air_curtains(members, rects), "air_curtain")):
        out = out.join(_flag(part, name), "key", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    out = out.join(diamonds, "key", "left").join(ways.select(F.col("drawing").alias("key"), F.when(F.col("direction") != "Unknown", F.col("direction")).alias("arrow_way")), "key", "left")
    round_ = circles(members).groupBy("key").agg(F.min(F.col("cx") - F.col("r")).alias("cx0"), F.max(F.col("cx") + F.col("r")).alias("cx1"), F.min(F.col("cy") - F.col("r")).alias("cy0"), F.max(F.col("cy") + F.col("r")).alias("cy1"))
    spread = members.select("key", F.explode("pts").alias("p")).groupBy("key").agg(*(f(F.col(f"p.{a}")).alias(n) for f, a, n in ((F.min, "x", "mx0"), (F.max, "x", "mx1"), (F.min, "y", "my0"), (F.max, "y", "my1"))))
    out = out.join(spread, "key", "left").join(round_, "key", "left")
    cw, ch = F.greatest("mx1", "cx1") - F.least("mx0", "cx0"), F.greatest("my1", "cy1") - F.least("my0", "cy0")
    simple = (F.col("n_circles") == 1) & (F.col("n_lines") >= 3) & (cw > 5) & (cw < 50) & (ch > 5) & (ch < 50)
    own_w, own_h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return out.select(
        "key", F.col("x0").isNotNull().alias("has_rect"), F.when((own_w > 0) & (own_h > 0), F.greatest(own_w, own_h) / F.least(own_w, own_h)).alias("ratio"), F.coalesce("n_rects", F.lit(0)).alias("n_rects"), "joined", (F.col("has_fan") | F.coalesce(simple, F.lit(False))).alias("fan_like"),
        "fan_in_rect", "circle_in_rect", (F.col("w_shape") | F.col("m_of_lines")).alias("m_shape"), "w_shape", F.coalesce("diamonds", F.lit(0)).alias("diamonds"), "diagonal", "air_curtain", "arrow_way", "n_lines", "n_circles")
