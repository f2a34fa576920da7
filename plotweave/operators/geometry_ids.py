"""Canonical forms of shapes and their SHA-1 ids, in the row.

A shape's points are moved to their mean, measured in the largest distance from it, and rounded to a grid; so are its
lines, arcs and circles. Both lists are sorted and written as JSON without blanks, keys in alphabetical order, so the
id does not depend on the order of the members.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

ARC_POINTS, CIRCLE_POINTS = 7, 8
_FLAT = 1e-9  # bulges below it are straight


def _p(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _image(m: Column, x: Column, y: Column) -> Column:
    """A point under the member's map."""
    a = m["map"]
    return F.when(a.isNull(), _p(x, y)).otherwise(_p(a["a"] * x + a["c"] * y + a["e"], a["b"] * x + a["d"] * y + a["f"]))


def _arc(m: Column, cx: Column, cy: Column, r: Column, first: Column, last: Column) -> Column:
    """Seven points of an arc from ``first`` anticlockwise to ``last``, in radians."""
    step = (F.when(last < first, last + 2 * math.pi).otherwise(last) - first) / float(ARC_POINTS - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(ARC_POINTS - 1)), lambda i: _image(m, cx + r * F.cos(first + step * i), cy + r * F.sin(first + step * i)))


def _apart(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


_PRIM = "struct<type: string, c: struct<x: double, y: double>, r: double, p: struct<x: double, y: double>, q: struct<x: double, y: double>>"


def _prim(kind: str, c: Column | None, r: Column | None, p: Column | None, q: Column | None) -> Column:
    point = F.lit(None).cast("struct<x: double, y: double>")
    return F.struct(F.lit(kind).alias("type"), (point if c is None else c).alias("c"), (F.lit(None).cast("double") if r is None else r).alias("r"), (point if p is None else p).alias("p"), (point if q is None else q).alias("q")).cast(_PRIM)


def _polyline(m: Column) -> Column:
    """(points, primitive) of each segment of a polyline."""
    v = m["pts"]
    nexts = F.when(F.coalesce(m["closed"], F.lit(False)), F.concat(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1))).otherwise(F.slice(v, 2, F.size(v)))
    pairs = F.arrays_zip(F.slice(v, 1, F.size(nexts)).alias("s"), nexts.alias("t"))

    def one(z: Column) -> Column:
        s, t, b = z["s"], z["t"], F.coalesce(z["s"]["bulge"], F.lit(0.0))
        dx, dy = t["x"] - s["x"], t["y"] - s["y"]
        off = (1 - b * b) / (4 * b)
        cx, cy, r = (s["x"] + t["x"]) / 2 - dy * off, (s["y"] + t["y"]) / 2 + dx * off, F.hypot(dx, dy) * (1 + b * b) / (4 * F.abs(b))
        begin, end = F.atan2(s["y"] - cy, s["x"] - cx), F.atan2(t["y"] - cy, t["x"] - cx)
        p, q, c = _image(m, s["x"], s["y"]), _image(m, t["x"], t["y"]), _image(m, cx, cy)
        straight = (F.abs(b) < _FLAT) | ((dx == 0) & (dy == 0))
        spots = F.when(straight, F.array(p, q)).otherwise(_arc(m, cx, cy, r, F.when(b > 0, begin).otherwise(end), F.when(b > 0, end).otherwise(begin)))
        return F.struct(spots.alias("spots"), F.when(straight, _prim("LINE", None, None, p, q)).otherwise(_prim("ARC", c, _apart(p, c), p, q)).alias("prim"))

    return F.transform(pairs, one)


def parts(m: Column) -> Column:
    """array<struct<spots, prim>> of a member: type, pts (x, y, bulge), closed, radius, start_deg, stop_deg, map (a to f, or null)."""
    first, second = F.get(m["pts"], F.lit(0)), F.get(m["pts"], F.lit(1))
    cx, cy, r = first["x"], first["y"], m["radius"]
    centre = _image(m, cx, cy)
    rim = _apart(_image(m, cx + r, cy), centre)
    p, q = _image(m, cx, cy), _image(m, second["x"], second["y"])
    a0, a1 = F.radians(m["start_deg"]), F.radians(m["stop_deg"])
    arc = _arc(m, cx, cy, r, a0, a1)
    ring = F.transform(F.sequence(F.lit(0), F.lit(CIRCLE_POINTS - 1)), lambda i: _image(m, cx + r * F.cos(i * (2 * math.pi) / float(CIRCLE_POINTS)), cy + r * F.sin(i * (2 * math.pi) / float(CIRCLE_POINTS))))
    one = lambda spots, prim: F.array(F.struct(spots.alias("spots"), prim.alias("prim")))
    return (
        F.when((m["type"] == "LINE") & (F.size(m["pts"]) >= 2), one(F.array(p, q), _prim("LINE", None, None, p, q)))
        .when(m["type"] == "CIRCLE", one(ring, _prim("CIRCLE", centre, rim, None, None)))
        .when(m["type"] == "ARC", one(arc, _prim("ARC", centre, rim, F.get(arc, F.lit(0)), F.get(arc, F.lit(ARC_POINTS - 1)))))
        .when(m["type"].isin("LWPOLYLINE", "POLYLINE") & (F.size(m["pts"]) >= 2), _polyline(m))
        .otherwise(F.slice(one(F.array(p), _prim("LINE", None, None, p, p)), 1, 0)))


def geometry_ids(members: DataFrame, grid: float = 0.01) -> DataFrame:
    """key, geom_id, canonical, n_points, n_primitives, n_line, n_arc, n_circle of each shape.

    ``members`` has key, seq, type, pts, closed, radius, start_deg, stop_deg and may have map. Shapes whose members have neither points nor
    primitives have no row. A grid that isn't positive counts as 0.01. Numbers round half to even. The members of a shape meet in one row.
    """
    grid = grid if grid > 0 else 0.01
    if "map" not in members.columns:
        members = members.withColumn("map", F.lit(None).cast("struct<a: double, b: double, c: double, d: double, e: double, f: double>"))
    m = members.select("key", "seq", parts(F.struct("type", "pts", "closed", "radius", "start_deg", "stop_deg", "map")).alias("parts"))
    g = m.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "parts"))).alias("held"))
    g = g.select("key", F.flatten(F.transform("held", lambda h: h["parts"])).alias("parts")).where(F.size("parts") > 0)
    g = g.select("key", F.flatten(F.transform("parts", lambda p: p["spots"])).alias("spots"), F.transform("parts", lambda p: p["prim"]).alias("prims"))
    mean = lambda c: F.aggregate("spots", F.lit(0.0), lambda t, p: t + p[c]) / F.size("spots")
    g = g.withColumns({"mx": mean("x"), "my": mean("y")})
    far = F.array_max(F.transform("spots", lambda p: F.hypot(p["x"] - F.col("mx"), p["y"] - F.col("my"))))
    g = g.withColumn("far", F.when(far > 0, far).otherwise(1.0))
    whole = lambda v: F.rint(v / grid).cast("long")
    x, y = lambda p: whole((p["x"] - F.col("mx")) / F.col("far")), lambda p: whole((p["y"] - F.col("my")) / F.col("far"))
    text = lambda p: F.concat(F.lit("["), x(p).cast("string"), F.lit(","), y(p).cast("string"), F.lit("]"))
    spots = F.array_distinct(F.array_sort(F.transform("spots", lambda p: F.struct(x(p).alias("x"), y(p).alias("y")))))
    listed = F.array_join(F.transform(spots, lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))), ",")
    radius = lambda p: whole(p["r"] / F.col("far")).cast("string")
    shown = F.array_sort(F.transform("prims", lambda p: F.when(p["type"] == "LINE", F.concat(F.lit('{"p0":'), text(p["p"]), F.lit(',"p1":'), text(p["q"]), F.lit(',"type":"LINE"}')))
                                     .when(p["type"] == "ARC", F.concat(F.lit('{"center":'), text(p["c"]), F.lit(',"p0":'), text(p["p"]), F.lit(',"p1":'), text(p["q"]), F.lit(',"radius":'), radius(p), F.lit(',"type":"ARC"}')))
                                     .otherwise(F.concat(F.lit('{"center":'), text(p["c"]), F.lit(',"radius":'), radius(p), F.lit(',"type":"CIRCLE"}')))))
    count = lambda k: F.size(F.filter("prims", lambda p: p["type"] == k))
    out = g.withColumn("canonical", F.concat(F.lit('{"points":['), listed, F.lit('],"prims":['), F.array_join(shown, ","), F.lit("]}")))
    return out.select("key", F.sha1("canonical").alias("geom_id"), "canonical", F.size("spots").alias("n_points"), F.size("prims").alias("n_primitives"), count("LINE").alias("n_line"), count("ARC").alias("n_arc"), count("CIRCLE").alias("n_circle"))
