"""Polygons, boxes and dashes of curves against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plotweave.operators import curve_paths as cp

VERTEX = "array<struct<x: double, y: double, bulge: double>>"


def plain_points(vs, closed, n):
    out = [vs[0][:2]]
    for (x0, y0, b), (x1, y1, _) in zip(vs, vs[1:] + (vs[:1] if closed else [])):
        if not b or (x0, y0) == (x1, y1):
            out += [(x1, y1)] if not b else [(x1, y1)] * (n - 1)
            continue
        off = (1 - b * b) / (4 * b)
        cx, cy = (x0 + x1) / 2 - (y1 - y0) * off, (y0 + y1) / 2 + (x1 - x0) * off
        r, a = math.dist((cx, cy), (x0, y0)), math.atan2(y0 - cy, x0 - cx)
        out += [(cx + r * math.cos(a + 4 * math.atan(b) * i / (n - 1)), cy + r * math.sin(a + 4 * math.atan(b) * i / (n - 1))) for i in range(1, n)]
    return out


def test_polylines(spark):
    rng = random.Random(1)
    rows = [(k, [(float(rng.randrange(9)), float(rng.randrange(9)), rng.choice([0.0, 0.5, -1.2, None])) for _ in range(rng.randrange(1, 6))], k % 2 == 0) for k in range(40)]
    df = spark.createDataFrame(rows, f"k long, v {VERTEX}, closed boolean")
    got = df.select("k", cp.polyline_polygon(F.col("v"), F.col("closed"), 9).alias("p"), F.struct(*(c.alias(n) for n, c in cp.polyline_box(F.col("v"), F.col("closed")).items())).alias("b")).collect()
    for r in got:
        _, vs, closed = rows[r["k"]]
        assert [(p["x"], p["y"]) for p in r["p"]] == [pytest.approx(q, abs=1e-9) for q in plain_points(vs, closed, 9)]
        pts = plain_points(vs, closed, 255) if any(v[2] for v in vs) else [v[:2] for v in vs]
        assert tuple(r["b"]) == pytest.approx((min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts)), abs=1e-9)
    one = spark.createDataFrame([([(1.0, 0.0, 1.0), (-1.0, 0.0, 0.0), (-1.0, -2.0, 0.0)],)], f"v {VERTEX}")
    short = one.select(cp.polyline_polygon(F.col("v"), F.lit(False), 3, start=False)).first()[0]
    assert [(round(p["x"], 9), round(p["y"], 9)) for p in short] == [(0.0, 1.0), (-1.0, 0.0), (-1.0, -2.0)]
    empty = spark.createDataFrame([([],)], f"v {VERTEX}").select(*cp.polyline_box(F.col("v"), F.lit(True)).values()).first()
    assert tuple(empty) == (None,) * 4


def test_round_curves(spark):
    df = spark.range(1)
    xy = lambda c: [(round(p["x"], 9) + 0.0, round(p["y"], 9) + 0.0) for p in df.select(c).first()[0]]
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert xy(cp.arc_polygon(*lit(1, 1, 2, 270, 90), 3)) == [(1.0, -1.0), (3.0, 1.0), (1.0, 3.0)]
    assert xy(cp.circle_polygon(*lit(0, 0, 1), 4)) == [(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)]
    assert xy(cp.ellipse_polygon(*lit(0, 0, 0, 2, 0.5, 0, 2 * math.pi), 4)) == [(0.0, 2.0), (-1.0, 0.0), (0.0, -2.0), (1.0, 0.0)]
    assert xy(cp.ellipse_polygon(*lit(0, 0, 2, 0, 0.5, 1.5 * math.pi, 0.5 * math.pi), 3)) == [(0.0, -1.0), (2.0, 0.0), (0.0, 1.0)]
    for make in (lambda: cp.arc_polygon(*lit(0, 0, 1, 0, 1), 1), lambda: cp.circle_polygon(*lit(0, 0, 1), 1), lambda: cp.polyline_polygon(F.array(), F.lit(True), 1)):
        with pytest.raises(ValueError, match="two"):
            make()


def test_boundaries(spark):
    edge = f"array<struct<kind: string, pts: {VERTEX}, radius: double, start_deg: double, stop_deg: double, major_x: double, major_y: double, ratio: double, closed: boolean>>"
    none = (None,) * 6
    edges = [("line", [(0.0, 0.0, None), (4.0, 0.0, None)], *none, None), ("arc", [(4.0, 2.0, None)], 2.0, 270.0, 90.0, None, None, None, None), ("polyline", [(4.0, 4.0, 0.0), (0.0, 4.0, 1.0)], *none, True), ("ellipse", [(0.0, 0.0, None)], None, 0.0, 360.0, 1.0, 0.0, 0.5, None), ("spline", [(99.0, 99.0, None)], *none, None)]
    pts = spark.createDataFrame([(edges,)], f"e {edge}").select(cp.boundary_points(F.col("e"), 16).alias("p"))
    n, x0, y0, x1, y1 = pts.select(F.size("p"), *cp.box_of(F.col("p")).values()).first()
    assert n == 2 + 16 + 2 + 15 + 16 and (x0, round(x1, 1), y1) == (-1.0, 6.0, pytest.approx(4.0 - -0.0, abs=2.1)) and y0 >= -1


def plain_dashes(pts, closed, pattern, dot):
    out, whole = [], sum(map(abs, pattern))
    for p, q in zip(pts, pts[1:] + (pts[:1] if closed else [])):
        d = math.dist(p, q)
        if d == 0:
            continue
        u, at, k = ((q[0] - p[0]) / d, (q[1] - p[1]) / d), 0.0, 0
        if whole == 0:
            out.append((*p, *q))
            continue
        while at < d:
            v = pattern[k % len(pattern)]
            if v >= 0:
                end = min(d, at + (v or dot))
                out.append((p[0] + u[0] * at, p[1] + u[1] * at, p[0] + u[0] * end, p[1] + u[1] * end))
            at += abs(v)
            k += 1
    return out


def test_dashes(spark):
    rng = random.Random(2)
    rows = [(k, [(float(rng.randrange(30)), float(rng.randrange(30))) for _ in range(rng.randrange(1, 5))], bool(k % 2), rng.choice([[3.0, -1.0], [5.0, -2.0, 0.0, -2.0], [], [0.0], [-4.0, 2.0]])) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, p array<struct<x: double, y: double>>, closed boolean, pattern array<double>")
    for r in df.select("k", cp.dashes(F.col("p"), F.col("closed"), F.col("pattern"), 0.25).alias("d")).collect():
        _, pts, closed, pattern = rows[r["k"]]
        want = plain_dashes(pts, closed and len(pts) > 0, pattern, 0.25)
        assert [tuple(x) for x in r["d"]] == [pytest.approx(w, abs=1e-9) for w in want]


def test_boxes_ask_few_points_of_an_arc(spark):
    rng = random.Random(4)
    rows = [(k, [(rng.uniform(-9, 9), rng.uniform(-9, 9), rng.choice([0.0, 1e-9, rng.uniform(-3, 3), 40.0, -1.0])) for _ in range(rng.randrange(1, 6))], k % 2 == 0) for k in range(400)]
    rows += [(400 + k, [(0.0, 0.0, b), (1.0, 0.0, -b), (1.0, 0.0, b)], True) for k, b in enumerate((1.0, -1.0, math.tan(math.pi / 8), 1e6))]
    df = spark.createDataFrame(rows, f"k long, v {VERTEX}, closed boolean")
    box = cp.polyline_box(F.col("v"), F.col("closed"))
    whole = cp.box_of(cp.polyline_polygon(F.col("v"), F.col("closed"), cp.POLYLINE_PRECISION))
    assert df.where(F.expr("exists(v, q -> q.bulge <> 0)")).where(~F.forall(F.array(*(F.struct(box[n], whole[n]) for n in box)), lambda p: p["col1"] == p["col2"])).count() == 0
    points = spark.createDataFrame(rows[400:401], df.schema).select(cp._outermost(F.col("v")[0], F.col("v")[1], F.lit(1.0), 254).alias("p")).first()["p"]
    assert len(points) == 10
