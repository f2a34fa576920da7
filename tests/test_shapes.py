"""Block maps, four-line loops and snapping against plain loops."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.operators import blocks, loops, snapping

MAPS = ", ".join(f"{c} double" for c in "abcdef")


def matrix(sx, sy, rot, tx, ty):
    c, s = math.cos(math.radians(rot)), math.sin(math.radians(rot))
    return np.array([[sx * c, -sy * s, tx], [sx * s, sy * c, ty], [0, 0, 1.0]])


def flat(m):
    return tuple(round(float(v) + 0.0, 6) for v in (m[0, 0], m[1, 0], m[0, 1], m[1, 1], m[0, 2], m[1, 2]))


def test_blocks_with_turns_mirrors_and_cycles(spark):
    rng = random.Random(1)
    refs = [(rng.randrange(8), rng.randrange(8), rng.choice([-1.0, 0.5, 2.0]), rng.choice([1.0, -0.5]), rng.choice([0.0, 30.0, 90.0, 215.0]), float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(12)] + [(1, 1, 1.0, 1.0, 0.0, 1.0, 1.0)]
    roots = [(k, rng.randrange(10), rng.choice([1.0, -2.0]), 1.5, 45.0 * k, float(k), 0.0) for k in range(9)]
    mapped = lambda rows, names: spark.createDataFrame(rows, names).withColumns(blocks.reference_map(*(F.col(c) for c in ("sx", "sy", "rot", "tx", "ty"))))
    r = mapped(refs, "owner long, child long, sx double, sy double, rot double, tx double, ty double")
    top = mapped(roots, "root long, block long, sx double, sy double, rot double, tx double, ty double").select("root", "block", *blocks.MAP)

    def walk(block, m, way, level, depth, out):
        out.append((block, level, flat(m)))
        for owner, child, *rest in refs:
            if owner == block and child not in way and (depth is None or level < depth):
                walk(child, m @ matrix(*rest), [*way, child], level + 1, depth, out)
        return out

    for depth in (0, 2, None):
        got = sorted((x["root"], x["inside"], x["level"], tuple(round(x[c] + 0.0, 6) + 0.0 for c in blocks.MAP)) for x in blocks.expanded(top, r, depth).collect())
        want = sorted((root, *rest) for root, block, *m in roots for rest in walk(block, matrix(*m), [block], 0, depth, []))
        assert got == [(*w[:3], tuple(v + 0.0 for v in w[3])) for w in want]


def test_base_point_and_arrays(spark):
    df = spark.createDataFrame([(2.0, 3.0, 90.0, 10.0, 20.0, 3, 2, 5.0, 7.0)], "sx double, sy double, rot_deg double, tx double, ty double, columns int, rows int, column_step double, row_step double")
    got = sorted((round(r["tx"], 6), round(r["ty"], 6)) for r in blocks.cells(df).collect())
    assert got == sorted((10.0 - 7.0 * j, 20.0 + 5.0 * i) for i in range(3) for j in range(2))
    m = blocks.reference_map(F.col("sx"), F.col("sy"), F.col("rot_deg"), F.col("tx"), F.col("ty"), F.lit(1.0), F.lit(2.0))
    x, y = blocks.mapped_point(F.lit(1.0), F.lit(2.0))
    assert df.withColumns(m).select(F.round(x, 6), F.round(y, 6)).first() == (10.0, 20.0)  # the base point lands on the insertion point


def test_circles_and_arcs_become_their_images(spark):
    rng = random.Random(5)
    rows = [(*[rng.uniform(-2, 2) for _ in range(4)], 3.0, -1.0, 1.0, 2.0, 1.5, rng.uniform(0, 6), rng.uniform(0, 6)) for _ in range(40)]
    for s in (1.0, -1.0):
        c, n = math.cos(0.7), math.sin(0.7)
        rows.append((2 * c, 2 * n, -2 * n * s, 2 * c * s, 1.0, 1.0, 0.5, 0.5, 2.0, 0.3, 4.0))
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], f"{MAPS}, cx double, cy double, r double, t0 double, t1 double")
    arc = blocks.mapped_circle(F.col("cx"), F.col("cy"), F.col("r"), F.col("t0"), F.col("t1"))
    got = df.select("*", *(v.alias(f"o_{k}") for k, v in arc.items())).collect()
    for g in got:
        a, b, c, d, e, f = (g[k] for k in blocks.MAP)
        image = lambda t: (a * (g["cx"] + g["r"] * math.cos(t)) + c * (g["cy"] + g["r"] * math.sin(t)) + e, b * (g["cx"] + g["r"] * math.cos(t)) + d * (g["cy"] + g["r"] * math.sin(t)) + f)

        def on(t):
            if g["o_kind"] == "ARC":
                long = math.hypot(g["o_major_x"], g["o_major_y"])
                return g["o_cx"] + long * math.cos(t), g["o_cy"] + long * math.sin(t)
            u, v = math.cos(t), g["o_ratio"] * math.sin(t)
            return g["o_cx"] + u * g["o_major_x"] - v * g["o_major_y"], g["o_cy"] + u * g["o_major_y"] + v * g["o_major_x"]

        mirrored = a * d - b * c < 0
        ends = (g["t1"], g["t0"]) if mirrored else (g["t0"], g["t1"])
        assert on(g["o_start"]) == pytest.approx(image(ends[0]), abs=1e-9) and on(g["o_stop"]) == pytest.approx(image(ends[1]), abs=1e-9)
        middle = (g["t0"] + g["t1"]) / 2
        assert on((g["o_start"] + g["o_stop"]) / 2) == pytest.approx(image(middle), abs=1e-9) and 0 <= g["o_ratio"] <= 1 + 1e-12
    assert [g["o_kind"] for g in got][-2:] == ["ARC", "ARC"] and {g["o_kind"] for g in got[:-2]} == {"ELLIPSE"}
    flatten = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 0.0, 0.0)], MAPS)
    assert flatten.select(blocks.mapped_circle(F.lit(0.0), F.lit(0.0), F.lit(1.0))["ratio"]).first()[0] == 0


def test_bulges_texts_and_boxes(spark):
    df = spark.createDataFrame([(0.0, 2.0, 2.0, 0.0, 1.0, 1.0)], MAPS)  # mirrored, scaled by two
    assert df.select(blocks.mapped_bulge(F.lit(0.5))).first()[0] == -0.5
    t = blocks.mapped_text(F.lit(1.0), F.lit(0.0), F.lit(3.0), F.lit(0.0))
    assert df.select(*(t[k] for k in ("x", "y", "height", "rotation_deg", "mirrored"))).first() == (1.0, 3.0, 6.0, 90.0, True)
    assert df.select(*blocks.mapped_box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0)).values()).first() == (1.0, 1.0, 5.0, 3.0)
    half = df.select(blocks.bulge_points(F.lit(1.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), 2).alias("p")).first()["p"]
    assert [(round(p["x"], 6), round(p["y"], 6)) for p in half] == [(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0)]


# --- loops ---


def near(p, q, tol=5.0):
    return math.dist(p, q) < tol


def plain_loop(lines):
    """The first of all sets of four whose chain closes."""
    for four in combinations(sorted(lines), 4):
        (_, start, now), *rest = four
        corners = [start, now]
        for _ in range(3):
            for r in rest:
                if near(r[1], now) or near(r[2], now):
                    now = r[2] if near(r[1], now) else r[1]
                    rest.remove(r)
                    corners.append(now)
                    break
            else:
                break
        if not rest and near(now, start):
            return [f[0] for f in four], corners[:4]
    return None


def test_loops_equal_all_combinations(spark):
    rng = random.Random(3)
    clusters = {}
    for c in range(150):
        lines = []
        for _ in range(rng.randrange(0, 4)):
            x, y, w, h = rng.randrange(60), rng.randrange(60), rng.randrange(3, 40), rng.randrange(3, 40)
            spots = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
            for k in range(4):
                p, q = ((a + rng.choice([0, 0, 2.0, 4.5]), b) for a, b in (spots[k], spots[(k + 1) % 4]))
                lines.append((p, q) if rng.random() < 0.6 else (q, p))
        lines += [((float(rng.randrange(60)), 0.0), (0.0, float(rng.randrange(60)))) for _ in range(rng.randrange(4))]
        if c == 7:
            lines = [((0.0, 0.0), (1.0, 1.0))] * 9
        if c == 8:
            lines = lines + [((500.0, 0.0), (600.0, 0.0))] * 51
        rng.shuffle(lines)
        clusters[c] = [(k, p, q) for k, (p, q) in enumerate(lines)]
    rows = [(c, k, float(p[0]), float(p[1]), float(q[0]), float(q[1])) for c, ls in clusters.items() for k, p, q in ls]
    got = {r["cluster"]: r for r in loops.four_line_loops(spark.createDataFrame(rows, "cluster long, line long, x0 double, y0 double, x1 double, y1 double")).collect()}
    want = {c: plain_loop(ls) for c, ls in clusters.items() if 4 <= len(ls) <= 50}
    want = {c: w for c, w in want.items() if w}
    assert set(got) == set(want) and len(want) > 40
    for c, (four, corners) in want.items():
        g = got[c]
        assert [g["i"], g["j"], g["k"], g["m"]] == four
        assert [(g[f"x{n}"], g[f"y{n}"]) for n in range(4)] == [tuple(map(float, p)) for p in corners]


def test_loops_of_any_number_of_lines(spark):
    rng = random.Random(5)
    clusters = {}
    for c in range(6):
        lines = [((20.0 * k, 1000.0 + 20 * (k % 7)), (20.0 * k + 9, 1500.0)) for k in range(48)]
        for _ in range(c):
            x, y, w, h = (rng.randrange(10, 60) for _ in range(4))
            spots = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
            lines += [(spots[k], spots[(k + 1) % 4]) for k in range(4)]
        rng.shuffle(lines)
        clusters[c] = [(k, p, q) for k, (p, q) in enumerate(lines)]
    clusters[6] = [(k, (0.0, 0.0), (100.0, 0.0)) for k in range(400)]
    rows = [(c, k, *map(float, (*p, *q))) for c, ls in clusters.items() for k, p, q in ls]
    got = {r["cluster"]: [r[n] for n in "ijkm"] for r in loops.four_line_loops(spark.createDataFrame(rows, "cluster long, line long, x0 double, y0 double, x1 double, y1 double"), most=None).collect()}
    want = {c: plain_loop(ls) for c, ls in clusters.items() if 0 < c < 6}
    assert got == {c: w[0] for c, w in want.items() if w} | {6: [0, 1, 2, 3]} and len(got) > 4


# --- snapping ---


def plain_snap(points, tol):
    nodes, out = [], []
    for p in points:
        k = next((i for i, n in enumerate(nodes) if math.dist(nodes[i], p) <= tol), None)
        if k is None:
            nodes.append(p)
            k = len(nodes) - 1
        out.append(nodes[k])
    return out


def plain_arrows(segments, tol):
    ends = plain_snap([p for s in segments for p in s], tol)
    spokes = {}
    for k in range(len(segments)):
        a, b = ends[2 * k], ends[2 * k + 1]
        if a != b:
            spokes.setdefault(a, []).append((k, b))
            spokes.setdefault(b, []).append((k, a))
    out = []
    for tip, held in spokes.items():
        for (j, p), (k, q) in combinations(held, 2):
            u, v = np.subtract(p, tip), np.subtract(q, tip)
            cos = max(-1.0, min(1.0, float(u @ v) / (math.hypot(*u) * math.hypot(*v))))
            mean = (u + v) / 2
            if 20 < math.degrees(math.acos(cos)) < 140 and math.hypot(*mean) >= 1e-3:
                out.append((min(j, k), max(j, k), tip, tuple(mean / math.hypot(*mean))))
    return out


def random_segments(rng, n, size):
    out = []
    for _ in range(n):
        x, y = rng.uniform(-size, size), rng.uniform(-size, size)
        out.append(((x, y), (x + rng.uniform(-30, 30), y + rng.uniform(-30, 30))))
    return out


def test_snapping_equals_the_sequential_loop(spark):
    rng = random.Random(8)
    drawings = {0: random_segments(rng, 10_000, 400), 1: [((float(k), 0.0), (k + 0.5, 0.0)) for k in range(400)], 2: random_segments(rng, 300, 20), 3: [((0.0, 0.0), (0.0, 0.0))] * 5}
    rows = [(d, k, *p, *q) for d, s in drawings.items() for k, (p, q) in enumerate(s)]
    got = {(r["drawing"], r["segment"]): r for r in snapping.snapped_segments(spark.createDataFrame(rows, "drawing long, segment long, x0 double, y0 double, x1 double, y1 double")).collect()}
    for d, s in drawings.items():
        if d == 0:
            continue
        ends = plain_snap([p for x in s for p in x], 2.0)
        for k in range(len(s)):
            r = got[d, k]
            assert ((r["ax"], r["ay"]), (r["bx"], r["by"])) == (ends[2 * k], ends[2 * k + 1])
    grid, nodes = {}, {}  # the same loop over the large drawing, with cells
    for k, pair in enumerate(drawings[0]):
        for side, p in enumerate(pair):
            u, v = int(p[0] // 2), int(p[1] // 2)
            best = min((n for i in (-1, 0, 1) for j in (-1, 0, 1) for n in grid.get((u + i, v + j), ()) if math.dist(nodes[n], p) <= 2.0), default=None)
            if best is None:
                best = 2 * k + side
                grid.setdefault((u, v), []).append(best)
                nodes[best] = p
            assert got[0, k]["ab"[side]] == best


def test_whole_drawings_snap_as_tiles_do(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(d, k, *p, *q) for d in range(40) for k, (p, q) in enumerate(random_segments(rng, rng.randrange(1, 120), 25))]
    rows += [(50, 0, None, 1.0, 2.0, 3.0), (50, 1, float("nan"), 1.0, 2.5, 3.0), (50, 2, -0.0, 0.0, 0.0, 0.0), (None, 3, 1.0, 1.0, 2.0, 2.0), (51, None, 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "drawing long, segment long, x0 double, y0 double, x1 double, y1 double")
    found = lambda: sorted((str(tuple(r)) for r in snapping.snapped_segments(df).collect()))
    names, dealt = ["drawing", "segment", "a", "ax", "ay", "b", "bx", "by"], []
    tiled = snapping._tiled_segments
    monkeypatch.setattr(snapping, "_tiled_segments", lambda s, tol: dealt.append({r["drawing"] for r in s.select("drawing").distinct().collect()}) or tiled(s, tol))
    whole = found()
    monkeypatch.setattr(snapping, "WHOLE", 60)
    assert found() == whole and len(whole) == len(rows) and snapping.snapped_segments(df).columns == names
    assert dealt[0] == {None, 51} and len(dealt[1]) > 10  # small drawings make no tiles


def test_arrows_equal_the_loop(spark):
    rng = random.Random(9)
    segments = random_segments(rng, 250, 30)
    rows = [(1, k, *p, *q) for k, (p, q) in enumerate(segments)]
    df = spark.createDataFrame(rows, "drawing long, segment long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["first"], r["second"], round(r["tip_x"], 6), round(r["dir_x"], 6), round(r["dir_y"], 6)) for r in snapping.arrows(df).collect())
    want = sorted((j, k, round(t[0], 6), round(d[0], 6), round(d[1], 6)) for j, k, t, d in plain_arrows(segments, 2.0))
    assert got == want and len(want) > 50
    assert snapping.arrows(df.limit(0)).count() == 0


def test_arrow_direction(spark):
    v = lambda x, s: [((x, 10.0), (x - 6.0 * s, 14.0)), ((x, 10.0), (x - 6.0 * s, 6.0))]
    drawings = {1: v(98.0, 1), 2: v(3.0, -1), 3: v(60.0, 1), 4: v(40.0, 1), 5: [((0.0, 0.0), (50.0, 0.0)), ((0.0, 0.0), (90.0, 0.0))], 6: v(300.0, 1)}
    rows = [(d, k, *p, *q) for d, s in drawings.items() for k, (p, q) in enumerate(s)]
    got = snapping.arrow_direction(spark.createDataFrame(rows, "drawing long, segment long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame([(d, 0.0, 0.0, 100.0, 20.0) for d in drawings], "drawing long, x0 double, y0 double, x1 double, y1 double"))
    assert dict(map(tuple, got.collect())) == {1: "Outward", 2: "Inward", 3: "Outward", 4: "Inward", 5: "Unknown", 6: "Unknown"}
