"""Curves as points: polygons of arcs, ellipses and bulged polylines, their boxes, and dashes along them. All in the row."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from plotweave.operators.blocks import bulge_points

POLYLINE_PRECISION, ARC_PRECISION, ELLIPSE_PRECISION = 255, 256, 100  # points of a curve that its box is taken from


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _checked(precision: int) -> int:
    if precision < 2:
        raise ValueError("the precision must be equal or greater than two")
    return precision


def arc_polygon(cx: Column, cy: Column, r: Column, start_deg: Column, stop_deg: Column, precision: int) -> Column:
    """``precision`` points of an arc from its start anticlockwise to its end, both included; equal angles make a whole turn."""
    n = _checked(precision)
    turn = F.pmod(stop_deg - start_deg, F.lit(360.0))
    turn = F.when(turn == 0, 360.0).otherwise(turn)
    angle = lambda i: F.radians(start_deg + turn * i / float(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _point(cx + r * F.cos(angle(i)), cy + r * F.sin(angle(i))))


def circle_polygon(cx: Column, cy: Column, r: Column, precision: int) -> Column:
    """``precision`` points of a circle, the first not repeated."""
    n = _checked(precision)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _point(cx + r * F.cos(i * (2 * math.pi / n)), cy + r * F.sin(i * (2 * math.pi / n))))


def ellipse_polygon(cx: Column, cy: Column, major_x: Column, major_y: Column, ratio: Column, start: Column, stop: Column, precision: int) -> Column:
    """``precision`` points of an ellipse by its parameter: of a whole one the first isn't repeated, of a part both ends are included."""
    n = _checked(precision)
    turn = F.when(stop <= start, stop - start + 2 * math.pi).otherwise(stop - start)
    whole = turn >= 2 * math.pi - 1e-9
    step = turn / F.when(whole, float(n)).otherwise(float(n - 1))

    def at(i: Column) -> Column:
        c, s = F.cos(start + step * i), F.sin(start + step * i) * ratio
        return _point(cx + major_x * c - major_y * s, cy + major_y * c + major_x * s)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def polyline_polygon(vertices: Column, closed: Column, precision: int, start: bool = True) -> Column:
    """The points of a polyline (array of x, y, bulge), with ``precision`` points for each bulged segment.

    Ends of segments appear once. ``start`` False leaves out the first vertex where the first segment is bulged, as
    consumers of the older form expect. A polyline of one vertex has that point, unless it is closed, when it has none of its own.
    """
    n = _checked(precision)

    def curve(s: Column, t: Column, bulge: Column) -> Column:
        return F.slice(bulge_points(s["x"], s["y"], t["x"], t["y"], bulge, n - 1), 2, n - 1)

    first = F.transform(F.slice(vertices, 1, 1), lambda v: _point(v["x"], v["y"]))
    if not start:
        first = F.filter(first, lambda v: F.coalesce(F.get(vertices, F.lit(0))["bulge"], F.lit(0.0)) == 0)
    return F.concat(first, _rests(vertices, closed, curve))


def _rests(vertices: Column, closed: Column, curve: Callable[[Column, Column, Column], Column]) -> Column:
    """The points of all segments after their first, ``curve`` being those of a bulged one."""
    nexts = F.when(F.coalesce(closed, F.lit(False)), F.concat(F.slice(vertices, 2, F.size(vertices)), F.slice(vertices, 1, 1))).otherwise(F.slice(vertices, 2, F.size(vertices)))
    pairs = F.arrays_zip(F.slice(vertices, 1, F.size(nexts)).alias("s"), nexts.alias("t"))

    def rest(z: Column) -> Column:
        s, t = z["s"], z["t"]
        bulge = F.coalesce(s["bulge"], F.lit(0.0))
        return F.when(bulge == 0, F.array(_point(t["x"], t["y"]))).otherwise(curve(s, t, bulge))

    return F.flatten(F.transform(pairs, rest))


def _outermost(s: Column, t: Column, bulge: Column, parts: int) -> Column:
    """Those of the points 1 to ``parts`` of an arc that any of its least and greatest x and y are at.

    Between the ends x and y turn only at quarters of the circle, so the points on both sides of each quarter do.
    """
    off = (1 - bulge * bulge) / (4 * bulge)
    cx, cy = (s["x"] + t["x"]) / 2 - (t["y"] - s["y"]) * off, (s["y"] + t["y"]) / 2 + (t["x"] - s["x"]) * off
    first, turn = F.atan2(s["y"] - cy, s["x"] - cx), 4 * F.atan(bulge)
    steps = [F.lit(1), F.lit(parts)]
    for quarter in range(4):
        ahead = F.pmod((quarter * math.pi / 2 - first) * F.signum(turn), F.lit(2 * math.pi))
        before = F.floor(F.least(ahead / F.abs(turn), F.lit(1.0)) * parts).cast("int")
        steps += [F.greatest(before, F.lit(1)), F.least(before + 1, F.lit(parts))]
    return bulge_points(s["x"], s["y"], t["x"], t["y"], bulge, parts, F.array(*steps))


def box_of(points: Column) -> dict[str, Column]:
    """The box of an array of points; nulls where it is empty."""
    return {"x0": F.array_min(points["x"]), "y0": F.array_min(points["y"]), "x1": F.array_max(points["x"]), "y1": F.array_max(points["y"])}


def polyline_bounds(vertices: Column, closed: Column) -> Column:
    """The points of a polyline that its box may rest on; a column of their own, as each side of the box asks for them."""
    bulged = F.exists(vertices, lambda v: F.coalesce(v["bulge"], F.lit(0.0)) != 0)
    plain = F.transform(vertices, lambda v: _point(v["x"], v["y"]))
    ends = F.slice(plain, 1, 1)
    return F.when(bulged, F.concat(ends, _rests(vertices, closed, lambda s, t, bulge: _outermost(s, t, bulge, POLYLINE_PRECISION - 1)))).otherwise(plain)


def polyline_box(vertices: Column, closed: Column) -> dict[str, Column]:
    """The box of a polyline: of its vertices, or if any segment is bulged, of the points of its arcs."""
    return box_of(polyline_bounds(vertices, closed))


def boundary_points(edges: Column, precision: int = 16) -> Column:
    """The points of a hatch's boundary path, edge after edge.

    An edge has kind (line, arc, ellipse, polyline), pts (x, y, bulge: ends, centre, or vertices), radius, start_deg,
    stop_deg, major_x, major_y, ratio, closed. Edges of other kinds have none.
    """

    def one(e: Column) -> Column:
        c = F.get(e["pts"], F.lit(0))
        return (
            F.when(e["kind"] == "line", F.transform(e["pts"], lambda p: _point(p["x"], p["y"])))
            .when(e["kind"] == "arc", arc_polygon(c["x"], c["y"], e["radius"], e["start_deg"], e["stop_deg"], precision))
            .when(e["kind"] == "ellipse", ellipse_polygon(c["x"], c["y"], e["major_x"], e["major_y"], e["ratio"], F.radians(e["start_deg"]), F.radians(e["stop_deg"]), precision))
            .when(e["kind"] == "polyline", polyline_polygon(e["pts"], e["closed"], precision))
            .otherwise(F.slice(F.transform(e["pts"], lambda p: _point(p["x"], p["y"])), 1, 0)))

    return F.flatten(F.transform(edges, one))


def dashes(points: Column, closed: Column, pattern: Column, point_size: Column | float = 0.0) -> Column:
    """array<struct<x0, y0, x1, y1>>: the dashes and dots of a line type along a path, in its order.

    ``pattern`` has the lengths of its parts: positive a dash, negative a gap, zero a dot, which is drawn
    ``point_size`` long. Each segment of the path begins the pattern anew; what reaches beyond a segment's end is cut. A pattern that
    is empty or has no length is a continuous line. Segments without a length have nothing.
    """
    ends = F.when(F.coalesce(closed, F.lit(False)), F.concat(points, F.slice(points, 1, 1))).otherwise(points)
    pairs = F.arrays_zip(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))).alias("s"), F.slice(ends, 2, F.greatest(F.size(ends) - 1, F.lit(0))).alias("t"))
    size = point_size if isinstance(point_size, Column) else F.lit(float(point_size))
    whole = F.aggregate(pattern, F.lit(0.0), lambda t, v: t + F.abs(v))
    before = lambda k: F.aggregate(F.slice(pattern, 1, k), F.lit(0.0), lambda t, v: t + F.abs(v))

    def along(z: Column) -> Column:
        s, t = z["s"], z["t"]
        long = F.hypot(t["x"] - s["x"], t["y"] - s["y"])
        some = F.when(long > 0, long).otherwise(1.0)
        ux, uy = (t["x"] - s["x"]) / some, (t["y"] - s["y"]) / some
        piece = lambda a, b: F.struct((s["x"] + ux * a).alias("x0"), (s["y"] + uy * a).alias("y0"), (s["x"] + ux * b).alias("x1"), (s["y"] + uy * b).alias("y1"))
        rounds = F.greatest(F.ceil(long / whole).cast("int"), F.lit(1))

        def turn(c: Column) -> Column:
            placed = F.transform(pattern, lambda v, k: F.struct(v.alias("v"), (c * whole + before(k)).alias("at")))
            drawn = F.filter(placed, lambda d: (d["v"] >= 0) & (d["at"] < long))
            return F.transform(drawn, lambda d: piece(d["at"], F.least(long, d["at"] + F.when(d["v"] == 0, size).otherwise(d["v"]))))

        none = F.filter(F.array(piece(F.lit(0.0), long)), lambda d: F.lit(False))
        cut = F.flatten(F.transform(F.sequence(F.lit(0), rounds - 1), turn))
        return F.when(long <= 0, none).when(F.coalesce(whole, F.lit(0.0)) <= 0, F.array(piece(F.lit(0.0), long))).otherwise(cut)

    return F.flatten(F.transform(pairs, along))


def gathered_vertices(vertices: DataFrame) -> DataFrame:
    """owner, vertices: the vertices (owner, seq, x, y, bulge) of each polyline in order."""
    held = F.sort_array(F.collect_list(F.struct("seq", "x", "y", "bulge")))
    return vertices.groupBy("owner").agg(held.alias("held")).select("owner", F.transform("held", lambda v: F.struct(v["x"], v["y"], v["bulge"])).alias("vertices"))
