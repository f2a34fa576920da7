"""Frames, closures and geometry ids against plain loops."""

import hashlib
import json
import math
import random

from plotweave.operators import catalogue, closure, frames, geometry_ids
from plotweave.operators.catalogue_shapes import _symbol_members  # noqa: F401 (registers its queries)
from tests.conftest import DATA

ITEM = "drawing long, handle long, x0 double, y0 double, x1 double, y1 double, points array<struct<x: double, y: double>>"


def line(d, h, x0, y0, x1, y1):
    return (d, h, float(min(x0, x1)), float(min(y0, y1)), float(max(x0, x1)), float(max(y0, y1)), [{"x": float(x0), "y": float(y0)}, {"x": float(x1), "y": float(y1)}])


def plain_frames(items, eps=5.0, tol=1.0):
    out = {}
    for d in {i[0] for i in items}:
        own = [i for i in items if i[0] == d]
        x0, y0, x1, y1 = min(i[2] for i in own), min(i[3] for i in own), max(i[4] for i in own), max(i[5] for i in own)
        w, h = x1 - x0, y1 - y0
        if w <= 0 or h <= 0:
            continue
        near = lambda a, b: abs(a - b) < eps
        key = lambda p: (round(p["x"] / tol), round(p["y"] / tol))
        whole = lambda i: near(i[2], x0) and near(i[3], y0) and near(i[4], x1) and near(i[5], y1)
        seen = [i for i in own if ((near(i[3], y0) or near(i[5], y1)) and i[4] - i[2] > 0.8 * w) or ((near(i[2], x0) or near(i[4], x1)) and i[5] - i[3] > 0.8 * h) or whole(i)]
        at = 0
        while at < len(seen):
            keys = {key(p) for p in seen[at][6]}
            seen += [j for j in own if j not in seen and keys & {key(p) for p in j[6]}]
            at += 1
        border = [i for i in seen if (i[4] - i[2] > 0.8 * w and (near(i[3], y0) and near(i[5], y0) or near(i[3], y1) and near(i[5], y1))) or (i[5] - i[3] > 0.8 * h and (near(i[2], x0) and near(i[4], x0) or near(i[2], x1) and near(i[4], x1))) or whole(i)]
        inner = [i for i in seen if i not in border] if seen else own
        title = [i for i in inner if (i[2] + i[4]) / 2 >= x1 - 0.3 * w - eps and (i[3] + i[5]) / 2 <= y0 + 0.3 * h + eps]
        out |= {(d, i[1]): (i in seen, i in border, i in title) for i in own}
    return out


def test_frames_equal_the_flood(spark):
    rng = random.Random(4)
    items = []
    for d in range(6):
        n = 0
        if d != 3:
            for x0, y0, x1, y1 in ((0, 0, 200, 0), (200, 0, 200, 100), (0, 100, 200, 100), (0, 0, 0, 100))[: d + 1]:
                items.append(line(d, n := n + 1, x0, y0, x1, y1))
        for _ in range(60):
            x, y = rng.randrange(0, 200, 10), rng.randrange(0, 100, 10)
            items.append(line(d, n := n + 1, x, y, min(200, x + rng.choice([0, 10, 30])), min(100, y + rng.choice([0, 10]))))
    items.append(line(9, 1, 0, 0, 10, 0))
    df = spark.createDataFrame(items, ITEM)
    extents = df.groupBy("drawing").agg({"x0": "min", "y0": "min", "x1": "max", "y1": "max"}).selectExpr("drawing", "`min(x0)` x0", "`min(y0)` y0", "`max(x1)` x1", "`max(y1)` y1")
    got = {(r["drawing"], r["handle"]): (r["in_frame"], r["on_border"], r["in_title"]) for r in frames.frames(df, extents).collect()}
    want = plain_frames(items)
    assert got == want and {v for v in want.values()} >= {(True, True, False), (True, False, True), (True, False, False), (False, False, False)}
    blocks = {r["drawing"]: r for r in frames.title_blocks(df, extents).collect()}
    for d, r in blocks.items():
        mine = [i for i in items if want.get((d, i[1]), (0, 0, 0))[2] and i[0] == d]
        assert (r["x0"], r["y1"]) == (min(i[2] for i in mine), max(i[5] for i in mine))
    assert frames.frames(df.limit(0), extents).count() == 0


def test_closure_of_cycles_and_missing_handles(spark):
    objects = spark.createDataFrame([(1, h) for h in (1, 2, 3, 4, 9)] + [(2, 1)], "doc long, handle long")
    refs = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, 77), (1, 2, 77), (1, 2, 0), (1, 2, None), (1, 9, 4), (1, 3, 3)], "doc long, src long, dst long")
    roots = spark.createDataFrame([(1, 1), (2, 5), (2, 0), (2, None)], "doc long, handle long")
    seen, missing = closure.reachable(roots, objects, refs)
    assert sorted(map(tuple, seen.collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert sorted(map(tuple, missing.collect())) == [(1, 77, 2), (2, 5, 1)]
    entries = spark.createDataFrame([(1, 10, "A", 11), (1, 11, "b", 12), (1, 12, "C", 10), (1, 11, "d", None), (1, 99, "x", 1)], "doc long, handle long, name string, target long")
    top = spark.createDataFrame([(1, 10)], "doc long, handle long")
    assert sorted(map(tuple, closure.dictionary_paths(top, entries).collect())) == [(1, "A", 11), (1, "A/b", 12), (1, "A/b/C", 10)]
    assert closure.lookup(top, entries, "a/B").collect() == [(1, 12)] and closure.lookup(top, entries, "a/x").count() == 0


def plain_id(ms, grid=0.01):
    pts, prims = [], []
    for _, _, kind, spots, closed, r, a, b, m in sorted(ms, key=lambda x: x[1]):
        at = (lambda x, y: (x, y)) if m is None else (lambda x, y, m=m: (m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]))

        def arc(cx, cy, r, a0, a1):
            a1 += math.tau if a1 < a0 else 0
            return [at(cx + r * math.cos(a0 + (a1 - a0) / 6 * i), cy + r * math.sin(a0 + (a1 - a0) / 6 * i)) for i in range(7)]

        p = [(s["x"], s["y"], s["bulge"] or 0.0) for s in spots]
        if kind == "LINE":
            ends = [at(*p[0][:2]), at(*p[1][:2])]
            pts += ends
            prims.append({"type": "LINE", "p0": ends[0], "p1": ends[1]})
        elif kind in ("CIRCLE", "ARC"):
            c = at(*p[0][:2])
            rim = at(p[0][0] + r, p[0][1])
            spots_ = [at(p[0][0] + r * math.cos(math.tau * i / 8), p[0][1] + r * math.sin(math.tau * i / 8)) for i in range(8)] if kind == "CIRCLE" else arc(*p[0][:2], r, math.radians(a), math.radians(b))
            pts += spots_
            prims.append({"type": kind, "center": c, "radius": math.dist(c, rim)} | ({} if kind == "CIRCLE" else {"p0": spots_[0], "p1": spots_[-1]}))
        elif kind == "LWPOLYLINE" and len(p) > 1:
            for (x0, y0, bulge), (x1, y1, _) in zip(p, p[1:] + (p[:1] if closed else [])):
                if abs(bulge) < 1e-9 or (x0, y0) == (x1, y1):
                    pts += [at(x0, y0), at(x1, y1)]
                    prims.append({"type": "LINE", "p0": at(x0, y0), "p1": at(x1, y1)})
                    continue
                off = (1 - bulge**2) / (4 * bulge)
                cx, cy = (x0 + x1) / 2 - (y1 - y0) * off, (y0 + y1) / 2 + (x1 - x0) * off
                rr = math.dist((x0, y0), (x1, y1)) * (1 + bulge**2) / (4 * abs(bulge))
                s, t = math.atan2(y0 - cy, x0 - cx), math.atan2(y1 - cy, x1 - cx)
                pts += arc(cx, cy, rr, *((s, t) if bulge > 0 else (t, s)))
                prims.append({"type": "ARC", "center": at(cx, cy), "radius": math.dist(at(x0, y0), at(cx, cy)), "p0": at(x0, y0), "p1": at(x1, y1)})
    if not prims:
        return None
    mx, my = (sum(v) / len(pts) for v in zip(*pts))
    far = max(math.hypot(x - mx, y - my) for x, y in pts) or 1.0
    q = lambda v: round(v / far / grid)
    spot = lambda v: [q(v[0] - mx), q(v[1] - my)]
    shown = [{k: v if k == "type" else q(v) if k == "radius" else spot(v) for k, v in p.items()} for p in prims]
    unique = [list(v) for v in sorted({tuple(spot(v)) for v in pts})]
    canon = json.dumps({"points": unique, "prims": sorted(shown, key=lambda d: json.dumps(d, sort_keys=True, separators=(",", ":")))}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha1(canon.encode()).hexdigest(), canon, len(pts), len(prims)


def test_geometry_ids_equal_json_digests(spark):
    rng = random.Random(7)
    rows = []
    for key in range(60):
        kinds = [rng.choice(["LINE", "CIRCLE", "ARC", "LWPOLYLINE", "TEXT"]) for _ in range(rng.randrange(1, 6))]
        m = rng.choice([None, {"a": 1.5, "b": 0.3, "c": -0.4, "d": 1.2, "e": 5.0, "f": -2.0}, {"a": -1.0, "b": 0.0, "c": 0.0, "d": 1.0, "e": 0.0, "f": 0.0}])
        for n, k in enumerate(kinds):
            spots = [{"x": rng.uniform(-9, 9), "y": rng.uniform(-9, 9), "bulge": rng.choice([None, 0.0, 0.4, -1.0])} for _ in range({"LINE": 2, "LWPOLYLINE": rng.randrange(1, 5)}.get(k, 1))]
            rows.append((key, n, k, spots, rng.choice([None, True, False]), 2.5 if k in ("CIRCLE", "ARC") else None, 300.0 if k == "ARC" else None, rng.choice([40.0, 350.0]) if k == "ARC" else None, m))
    rows.append((99, 0, "LINE", [{"x": 1.0, "y": 1.0, "bulge": None}] * 2, None, None, None, None, None))
    schema = "key long, seq long, type string, pts array<struct<x: double, y: double, bulge: double>>, closed boolean, radius double, start_deg double, stop_deg double, map struct<a: double, b: double, c: double, d: double, e: double, f: double>"
    got = {r["key"]: (r["geom_id"], r["canonical"], r["n_points"], r["n_primitives"]) for r in geometry_ids.geometry_ids(spark.createDataFrame(rows, schema)).collect()}
    want = {k: plain_id([r for r in rows if r[0] == k]) for k in {r[0] for r in rows}}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 40
    lines = [r for r in rows if r[2] == "LINE" and r[0] < 60][:2]
    both = [(k, n, *r[2:8], None) for k, order in ((0, lines), (1, lines[::-1])) for n, r in enumerate(order)]
    ids = [r["geom_id"] for r in geometry_ids.geometry_ids(spark.createDataFrame(both, schema)).collect()]
    assert len(ids) == 2 and ids[0] == ids[1]
    assert geometry_ids.geometry_ids(spark.createDataFrame([], schema)).count() == 0


def test_geometry_id_query(spark):
    found = catalogue.QUERIES["geometry_ids"](spark, DATA)
    assert found.where("geom_id = sha1(canonical)").count() == found.count() > 100
