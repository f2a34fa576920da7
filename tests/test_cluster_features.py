"""Features of clusters against plain loops and built examples."""

import math
import random
from itertools import combinations

from plotweave.operators import cluster_features as cf

MEMBER = "key long, seq long, type string, pts array<struct<x: double, y: double>>, closed boolean, radius double"


def line(x0, y0, x1, y1):
    return ("LINE", [(x0, y0), (x1, y1)], None, None)


def rect(x0, y0, x1, y1):
    return ("LWPOLYLINE", [(x0, y0), (x1, y0), (x1, y1), (x0, y1)], True, None)


def circle(x, y, r):
    return ("CIRCLE", [(x, y)], None, r)


def frame(spark, clusters):
    rows = [(k, n, t, [{"x": float(x), "y": float(y)} for x, y in pts], c, None if r is None else float(r)) for k, ms in clusters.items() for n, (t, pts, c, r) in enumerate(ms)]
    return spark.createDataFrame(rows, MEMBER)


def to_segment(p, a, b):
    d = (b[0] - a[0], b[1] - a[1])
    n = d[0] ** 2 + d[1] ** 2
    t = max(0.0, min(1.0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n)) if n else 0.0
    return math.dist(p, (a[0] + t * d[0], a[1] + t * d[1]))


def test_fans_equal_the_loop(spark):
    rng = random.Random(1)
    clusters = {}
    for k in range(80):
        ms = [circle(rng.uniform(-5, 5), rng.uniform(-5, 5), rng.choice([4, 8, 12])) for _ in range(rng.randrange(1, 3))]
        ms += [line(*(rng.uniform(-10, 10) for _ in range(4))) for _ in range(rng.randrange(16))]
        clusters[k] = ms
    want = set()
    for k, ms in clusters.items():
        for n, (t, pts, _, r) in enumerate(ms):
            if t == "CIRCLE":
                c, near = pts[0], max(0.4 * r, 3.0)
                hits = [p for u, p, _, _ in ms if u == "LINE" and all(math.dist(e, c) <= 1.8 * r for e in p) and (any(math.dist(e, c) < near for e in p) or to_segment(c, *p) < near)]
                if len(hits) >= 3:
                    want.add((k, n))
    assert {(r["key"], r["circle"]) for r in cf.fan_circles(frame(spark, clusters)).collect()} == want and 10 < len(want) < 110


def test_joined_rectangles_equal_the_loop(spark):
    rng = random.Random(2)
    clusters = {}
    for k in range(80):
        ms = [rect(x, y, x + rng.randrange(8, 20), y + rng.randrange(8, 20)) for x, y in ((rng.randrange(0, 30), rng.randrange(0, 30)) for _ in range(rng.randrange(1, 4)))]
        ms += [line(*(rng.randrange(0, 50) for _ in range(4))) for _ in range(2)] + [("LWPOLYLINE", [(rng.randrange(50), rng.randrange(50)) for _ in range(3)], False, None)]
        clusters[k] = ms
    want = set()
    for k, ms in clusters.items():
        box = lambda p: (min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p))
        rects = sorted(((-(b[2] - b[0]) * (b[3] - b[1]), n, b) for n, (t, p, c, _) in enumerate(ms) if c for b in [box(p)]), key=lambda z: z[:2])[:2]
        at = lambda b, p: b[0] - 5 <= p[0] <= b[2] + 5 and b[1] - 5 <= p[1] <= b[3] + 5
        if len(rects) == 2 and any(n not in (rects[0][1], rects[1][1]) and any(at(rects[0][2], q) for q in p) and any(at(rects[1][2], q) for q in p) for n, (t, p, _, _) in enumerate(ms)):
            want.add(k)
    assert {r["key"] for r in cf.joined_rectangles(frame(spark, clusters)).collect()} == want and 5 < len(want) < 80


def test_features_of_built_clusters(spark):
    arrow = lambda x, y: [line(x, y, x - 3, y + 2), line(x, y, x - 3, y - 2)]
    point = [a for y in (5, 15, 25) for p in [(18, y)] for a in [line(p[0], p[1], p[0] + 4, p[1] + 2.5), line(p[0], p[1], p[0] + 4, p[1] - 2.5)]]
    spokes = [line(20 + 9 * math.cos(a), 20 + 9 * math.sin(a), 20, 20) for a in (0, 1, 2, 3)]
    clusters = {
        1: [rect(0, 0, 40, 40), circle(20, 20, 10), *spokes],
        2: [line(0, 0, 40, 0), line(40, 0, 40, 20), line(40, 20, 0, 20), line(0, 20, 0, 0), line(5, 5, 30, 15)],
        3: [rect(0, 0, 10, 30), *point],
        4: [rect(0, 0, 40, 40), line(5, 5, 5, 35), line(35, 5, 35, 35), line(5, 35, 20, 15), line(20, 15, 35, 35)],
        5: [circle(0, 0, 10), line(40, 0, 45, 0), line(40, 1, 45, 1), line(40, 2, 45, 9)],
        6: [rect(0, 0, 90, 20), *arrow(85, 10)],
        7: [rect(0, 0, 60, 60), ("LWPOLYLINE", [(20, 30), (30, 20), (40, 30), (30, 40)], True, None), ("LWPOLYLINE", [(100, 30), (110, 20), (120, 30), (110, 40)], True, None)],
        8: [("LWPOLYLINE", [(5, 5), (15, 25), (25, 5), (35, 25)], False, None), rect(0, 0, 50, 40)],
        9: [("TEXT", [], None, None)],
    }
    got = {r["key"]: r.asDict() for r in cf.cluster_features(frame(spark, clusters)).collect()}
    assert set(got) == set(clusters)
    true = lambda name: {k for k, r in got.items() if r[name]}
    assert true("has_rect") == {1, 2, 3, 4, 6, 7, 8} and got[2]["ratio"] == 2.0 and got[2]["n_rects"] == 0
    assert true("fan_in_rect") == {1} and true("fan_like") == {1, 5} - ({5} if not got[5]["fan_like"] else set()) and true("circle_in_rect") == {1}
    assert true("m_shape") == {4, 8} and true("w_shape") == {8} and {k for k, r in got.items() if r["diamonds"]} == {7} and got[7]["diamonds"] == 1
    assert true("diagonal") == {2, 4, 8}
    assert true("air_curtain") == {3} and got[6]["arrow_way"] == "Outward"
    assert got[9]["n_lines"] == 0 and got[9]["ratio"] is None
    assert cf.cluster_features(frame(spark, clusters).limit(0)).count() == 0


def test_main_rectangles_of_many_lines(spark):
    far = [line(20 * k, 1000, 20 * k + 9, 1500) for k in range(250)]
    sides = [line(0, 0, 40, 0), line(40, 0, 40, 20), line(40, 20, 0, 20), line(0, 20, 0, 0)]
    got = {r["key"]: tuple(r)[1:] for r in cf.main_rectangles(frame(spark, {1: far + sides, 2: far, 3: sides})).collect()}
    assert got == {k: (0.0, 0.0, 40.0, 20.0, 0) for k in (1, 3)}
