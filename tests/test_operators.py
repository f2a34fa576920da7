"""Graph, merging and scalar operators against brute force and known values."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plotweave.functions import geometry as g, scalars as s
from plotweave.operators import classify, grouping, matching, selections, spatial, tiles
from plotweave.operators.graph import connected_components
from plotweave.sources import dxf


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {"random": [(rng.randrange(60), rng.randrange(60)) for _ in range(40)], "chain": [(i, i + 1) for i in range(40)], "star": [(50, i) for i in range(30)], "empty": []}[shape]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == roots({n for e in edges for n in e}, edges)


def boxes(rng, n, size=60):
    out = []
    for i in range(n):
        x, y = rng.uniform(-size, size), rng.uniform(-size, size)
        w = 300.0 if i == 0 else rng.uniform(0, 6)
        out.append((i % 2, i, x, y, x + w, y + rng.uniform(0, 6)))
    return out


def test_band_join_is_brute_force_with_large_boxes(spark):
    rows = boxes(random.Random(3), 120)
    df = spark.createDataFrame(rows, "doc_id int, handle long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["l_handle"], r["r_handle"]) for r in spatial.near_pairs(df, ["doc_id"], "handle", 5.0, cell=4.0).collect())
    want = sorted((a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and max(a[2] - b[4], b[2] - a[4]) <= 5 and max(a[3] - b[5], b[3] - a[5]) <= 5)
    assert got == want


def test_tiles_unite_what_pairs_unite(spark):
    rng = random.Random(11)
    rows = [*boxes(rng, 150), *((5, 1000 + k, x, y, x + 1.0, y + rng.choice([1.0, 60.0])) for k in range(500) for x, y in [(rng.randrange(60) / 4, rng.randrange(3000) / 4)])]
    df = spark.createDataFrame(rows, "doc_id int, handle long, x0 double, y0 double, x1 double, y1 double")
    for tol, cell in ((5.0, 4.0), (0.25, 32.0)):
        near = [(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and max(a[2] - b[4], b[2] - a[4]) <= tol and max(a[3] - b[5], b[3] - a[5]) <= tol]
        got = {r["node"]: r["component"] for r in tiles.near_components(df, ["doc_id"], "handle", tol, tiles.near(tol), cell).collect()}
        assert got == roots([r[1] for r in rows], near) and len(set(got.values())) > 2


def test_many_boxes_at_a_place_make_a_row_each(spark, monkeypatch):
    written = []
    monkeypatch.setattr(tiles.Scratch, "write", lambda self, df, name, write=tiles.Scratch.write: written.append((name, write(self, df, name))) or written[-1][1])
    df = spark.createDataFrame([(1, k, 0.0, 0.0, 1.0, 1.0) for k in range(3000)], "doc_id int, handle long, x0 double, y0 double, x1 double, y1 double")
    assert {r["component"] for r in grouping.box_components(df).collect()} == {0}
    assert [d.count() for name, d in written if name == "roots"] == [3000] and not any(d.count() for name, d in written[-1:] if name == "edges")


def brute_merge(rows, gap, ratio=None):
    groups = [(h, (x0, y0, x1, y1), 1, d) for d, h, x0, y0, x1, y1 in rows]
    while True:
        def close(a, b):
            if a[3] != b[3]:
                return False
            p, q = a[1], b[1]
            if ratio:
                s1, s2 = sorted([(p[2] - p[0]) * (p[3] - p[1]), (q[2] - q[0]) * (q[3] - q[1])])
                if not (s1 > 0 and s2 >= ratio * s1):
                    return False
            dx, dy = max(p[0] - q[2], q[0] - p[2]), max(p[1] - q[3], q[1] - p[3])
            return (max(dx, 0) ** 2 + max(dy, 0) ** 2) ** 0.5 < gap or (dx <= 0 and dy <= 0)

        edges = [(a[0], b[0]) for a, b in itertools.combinations(groups, 2) if close(a, b)]
        if not edges:
            return sorted((h, n) for h, _, n, _ in groups)
        root, merged = roots([x[0] for x in groups], edges), {}
        for h, box, n, d in groups:
            k = root[h]
            old = merged.get(k)
            merged[k] = (k, box, n, d) if old is None else (k, (min(old[1][0], box[0]), min(old[1][1], box[1]), max(old[1][2], box[2]), max(old[1][3], box[3])), old[2] + n, d)
        groups = list(merged.values())


@pytest.mark.parametrize("ratio", [None, 2.0])
def test_merge_until_stable(spark, ratio):
    rows = [r for r in boxes(random.Random(5), 60) if r[1]]
    df = spark.createDataFrame(rows, "doc_id int, handle long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["handle"], r["n"]) for r in grouping.merge_until_stable(df, 3.0, ratio).collect())
    assert got == brute_merge(rows, 3.0, ratio)


def test_gap_is_strict_for_merging_and_inclusive_for_nearness(spark):
    row = spark.sql("select 0d l_x0, 0d l_y0, 1d l_x1, 1d l_y1, 6d r_x0, 0d r_y0, 7d r_x1, 1d r_y1")
    assert row.select(g.near("l_", "r_", 5.0).alias("a"), g.merges("l_", "r_", 5.0).alias("b")).first() == (True, False)


@pytest.mark.parametrize("step,want", [(0.0, 17.6183), (0.001, 17.618), (0.5, 17.5), (3, 18), (20, 20)])
def test_rounding(spark, step, want):
    assert one(spark, s.rounded_to(F.lit(17.6183), step)) == pytest.approx(want)


@pytest.mark.parametrize("value,want", [(0.5, "1/2"), (1.25, "1 1/4"), (3.0, "3"), (-0.75, "-3/4")])
def test_fraction(spark, value, want):
    assert one(spark, s.fraction(F.lit(value), 4)) == want


@pytest.mark.parametrize("places,leading,trailing,want", [(3, False, False, "0.000"), (4, False, True, "0.####"), (2, True, True, "#.##"), (2, True, False, "#.00"), (0, False, False, "0")])
def test_zero_mask(places, leading, trailing, want):
    assert s.zero_mask(places, leading, trailing) == want


def test_text(spark):
    assert one(spark, s.dms(F.lit(90.0))) == "90°"
    assert one(spark, s.gradians(F.lit(1.5707963267948966))) == "100.00g"
    assert one(spark, s.plain_text(F.lit("pump {\\H1.5x;{\\C4;no. \\{7\\}}}\\Pc:\\\\Pipes \\q\\"))) == "pump no. {7}\nc:\\Pipes q\\"
    assert one(spark, s.plain_text(F.lit(""))) == "" and one(spark, s.plain_text(F.lit(None).cast("string"))) is None
    assert one(spark, s.sanitised(F.lit(" a / b、c  "))) == "a_b_c"
    assert one(spark, s.sanitised(F.lit("  "))) == "SYM"


def test_bulge(spark):
    arc = g.bulge_arc(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.41421356237309503))
    row = spark.range(1).select(*[v.alias(k) for k, v in arc.items()]).first()
    assert [round(row[k], 9) for k in ("cx", "cy", "radius", "start")] == [0.0, 0.0, 1.0, 0.0]
    assert row["stop"] == pytest.approx(1.5707963267948966)


def test_arc_box(spark):
    row = spark.range(1).select(*[v.alias(k) for k, v in g.arc_box(*map(F.lit, (0.0, 0.0, 5.0, 0.0, 90.0))).items()]).first()
    assert [round(v, 9) for v in row] == [0.0, 0.0, 5.0, 5.0]


def test_julian_round_trip(spark):
    row = spark.sql("select timestamp'2024-02-29 13:14:15' t").select(s.date_of_julian(s.julian_date(F.col("t"))).cast("string").alias("v"), s.julian_day(F.col("t")).alias("d")).first()
    assert row == ("2024-02-29 13:14:15", 2460370)


def test_rules_are_ordered(spark):
    base = dict(block_name="", has_rect=True, n_rects=1, n_circles=0, n_lines=0, fan_like=False, fan_in_rect=False, joined=False, m_shape=False, w_shape=False, text="FE", diamonds=3, ratio=1.0, arrows=0, baffles=0, top_feature="x", arrow_way="x", diagonal=True)
    rows = [base, base | {"text": "E"}, base | {"text": ""}, base | {"block_name": "A_FAN", "text": "E"}, base | {"text": "", "diagonal": False}]
    got = [r["kind"] for r in classify.classified(spark.createDataFrame(rows)).collect()]
    assert got == ["FireDamper", "SmokeFireDamper", "CheckValve", "Fan", "Unknown"]


def test_dxf_sections(spark):
    text = "0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1021\n0\nENDSEC\n0\nSECTION\n2\nTABLES\n0\nLAYER\n2\nWalls\n62\n3\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nLINE\n5\n1F\n8\nWalls\n10\n1.5\n20\n2\n11\n3\n21\n4\n0\nCIRCLE\n5\n20\n8\n0\n10\n0\n20\n0\n40\n2.5\n0\nENDSEC\n0\nEOF\n"
    found = dxf.pairs(spark.createDataFrame([("a", text), ("b", ""), ("c", "x\ny\n")], "file string, value string"))
    rows = dxf.entities(found).orderBy("record").collect()
    assert [(r["type"], r["handle"], r["layer"], r["x"], r["radius"]) for r in rows] == [("LINE", 31, "Walls", 1.5, None), ("CIRCLE", 32, "0", 0.0, 2.5)]
    assert dxf.header(found).collect()[0]["values"] == ["AC1021"]
    assert dxf.layers(found).select("name", "aci").collect() == [("Walls", 3)]


def test_refine_shrinks_and_keeps_counts(spark):
    rows = [(1, 1, 0.0, 0.0, 1.0, 1.0), (1, 2, 2.0, 0.0, 3.0, 1.0), (1, 3, 50.0, 0.0, 51.0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id int, handle long, x0 double, y0 double, x1 double, y1 double")
    got = sorted(map(tuple, grouping.refine_and_merge(df, 3.0, 0.25).select("handle", "x0", "x1", "n").collect()))
    assert got == [(1, -0.25, 3.25, 2), (3, 49.75, 51.25, 1)]


def test_libraries_are_matched_in_parts(spark, monkeypatch):
    rows = [(k, [(int(x), int(y)) for x, y in zip([0, 7 * k % 11, 5, k % 4], [0, 3, k % 5, 9])]) for k in range(24)]
    shapes = spark.createDataFrame(rows, "shape long, pts array<struct<x: long, y: long>>")
    found = {}
    for size in (matching.LIBRARY, 5):
        monkeypatch.setattr(matching, "LIBRARY", size)
        hashes = matching.phash(shapes)
        found[size] = [sorted(map(tuple, f.collect())) for f in (matching.best_match(hashes, hashes), matching.best_rotation(shapes, shapes.where("shape < 12")), matching.best_descriptor(shapes, shapes))]
    assert len(found) == 2 and found[5] == found[matching.LIBRARY if matching.LIBRARY != 5 else 10_000]


def test_histograms_of_odd_shapes(spark):
    rows = [(1, [(0, 0), (4, 0)]), (2, [(3, 3)]), (3, []), (4, [(0, 0), (0, 4), (0, 8)])]
    got = {r["shape"]: list(r["counts"]) for r in matching.histograms(spark.createDataFrame(rows, "shape long, pts array<struct<x: long, y: long>>")).collect()}
    assert {k: sum(v) for k, v in got.items()} == {1: 2 + 1, 2: 1, 3: 0, 4: 3 + 3}
    assert got[1][15] == 2 and got[1][16 + 47] == 1 and got[2][0] == 1




def test_tables_and_names(spark):
    layers = spark.createDataFrame([("Walls",), ("0",)], "name string")
    new = spark.createDataFrame([("WALLS",), ("Doors",), ("doors",)], "name string")
    assert sorted(r["name"].lower() for r in selections.with_entries(layers, new).collect()) == ["0", "doors", "walls"]
    left = selections.without_entries(layers, spark.createDataFrame([("walls",), ("0",)], "name string"), ["0"])
    assert [r["name"] for r in left.collect()] == ["0"]
    moved = selections.fallen_back(spark.createDataFrame([(1, "WALLS"), (2, "0"), (3, None)], "handle long, layer string"), left, "0")
    assert sorted(map(tuple, moved.select("handle", "layer").collect())) == [(1, "0"), (2, "0"), (3, "0")]
    assert one(spark, selections.valid_name(F.lit("a|b"))) is False and one(spark, selections.valid_name(F.lit(None).cast("string"))) is False
    assert one(spark, selections.allowed(F.lit("PUMP_1"), (), ("^PUMP",), ("PUMP_2",))) is True and one(spark, selections.allowed(F.lit("PUMP_2"), (), (), ("PUMP_2",))) is False


def test_corridor_labels_are_brute_force_without_a_list_of_obstacles(spark):
    rng = random.Random(21)
    rows = [(i % 2, i, x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9)) for i in range(90) for x, y in [(float(rng.randrange(260)), float(rng.randrange(40)))]]
    marks = [(i % 2, i, float(rng.randrange(300)), float(rng.randrange(45))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id int, handle long, x0 double, y0 double, x1 double, y1 double")
    found = grouping.corridor_labels(df.where("handle % 3 = 0"), spark.createDataFrame(marks, "doc_id int, handle long, x double, y double"), df)
    want = sorted((d, h, m) for d, h, x0, y0, x1, y1 in rows if h % 3 == 0 for e, m, x, y in marks
                  if d == e and x1 <= x <= x1 + 100 and y0 <= y <= y1 and not any(b[0] == d and b[1] != h and x1 < b[2] < x and b[3] <= y <= b[5] for b in rows))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 20
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_adaptive_pairs_file_boxes_by_their_own_tolerance(spark, monkeypatch):
    tols, join = [], selections.band_join
    monkeypatch.setattr(selections, "band_join", lambda *a: tols.append(a[4]) or join(*a))
    for large in (False, True):
        rows = [r for r in boxes(random.Random(31), 150) if r[1]] + [(0, 900, -40.0, -40.0, 160.0, 160.0), (0, 901, 175.0, 0.0, 375.0, 200.0)] * large
        df = spark.createDataFrame(rows, "doc_id int, handle long, x0 double, y0 double, x1 double, y1 double")
        tol = lambda a, b: min(max(min(a[4] - a[2], a[5] - a[3], b[4] - b[2], b[5] - b[3]) * 0.2, 1.0), 20.0)
        want = sorted((a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and max(a[2] - b[4], b[2] - a[4]) <= tol(a, b) and max(a[3] - b[5], b[3] - a[5]) <= tol(a, b))
        got = sorted((r["l_handle"], r["r_handle"]) for r in selections.adaptive_pairs(df, ["doc_id"]).collect())
        assert got == want and ((900, 901) in want) == large
    assert tols[0] < 2.0 and tols[1] == 20.0
