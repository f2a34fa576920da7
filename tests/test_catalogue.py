"""Every drawing query against its SQL on the smallest tables."""

import json

import pytest

from plotweave.operators import catalogue, catalogue_files, catalogue_rules, catalogue_shapes  # noqa: F401 (register their queries)
from plotweave.plans.projection import with_
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalogue.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_texts_are_repaired(spark, duck, tmp_path):
    got = {r["doc_id"]: r["fixed"] for r in catalogue.QUERIES["mojibake_repair_whole"](spark, DATA).collect()}
    want = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert got == want and max(len(t or "") for t in got.values()) > 40
    spark.createDataFrame([(1, "a" * 60 + "é漢"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["fixed"] for r in catalogue.QUERIES["mojibake_repair_whole"](spark, str(tmp_path)).collect()} == {1: "a" * 60 + "é漢", 2: None}


def de_boor(pts, t, degree=3):
    degree, n = min(degree, len(pts) - 1), len(pts)
    knots = [0.0] * (degree + 1) + [i / (n - degree) for i in range(1, n - degree)] + [1.0] * (degree + 1)
    at = max(i for i in range(degree, n) if knots[i] <= t)
    d = [pts[at - degree + j] for j in range(degree + 1)]
    for r in range(1, degree + 1):
        for j in range(degree, r - 1, -1):
            i = at - degree + j
            a = (t - knots[i]) / (knots[i + degree - r + 1] - knots[i])
            d[j] = tuple((1 - a) * u + a * v for u, v in zip(d[j - 1], d[j]))
    return d[degree]


def test_splines_of_all_vertices(spark, duck):
    owned = {}
    for owner, _, x, y in duck.execute(f"{with_('vertices')} SELECT owner, seq, x, y FROM vertices ORDER BY owner, seq").fetchall():
        owned.setdefault(owner, []).append((x, y))
    assert {1, 3, 4, 5} <= {len(v) for v in owned.values()}
    got = {(r["owner"], r["k"]): (r["x"], r["y"]) for r in catalogue.QUERIES["spline_eval_whole"](spark, DATA).collect()}
    assert set(got) == {(o, k) for o in owned for k in range(5)}
    assert all(got[o, k] == pytest.approx(de_boor(owned[o], k / 4), abs=1e-6) for o, k in got)


def drawn(kind, x0, y0, x1, y1):
    if kind == "LINE":
        return f'<line x1="{x0:.3f}" y1="{y0:.3f}" x2="{x1:.3f}" y2="{y1:.3f}"/>'
    if kind == "CIRCLE":
        return f'<circle cx="{(x0 + x1) / 2:.3f}" cy="{(y0 + y1) / 2:.3f}" r="{(x1 - x0) / 2:.3f}"/>'
    return f'<rect x="{x0:.3f}" y="{y0:.3f}" width="{x1 - x0:.3f}" height="{y1 - y0:.3f}"/>'


def test_exports_of_all_entities(spark, duck):
    rows = duck.execute(f"{with_('entities')} SELECT doc_id, handle, type, layer, x0, y0, x1, y1 FROM entities").fetchall()
    got = {(r["doc_id"], r["handle"]): r["svg"] for r in catalogue.QUERIES["svg_export_whole"](spark, DATA).collect()}
    assert got == {r[:2]: drawn(r[2], *r[4:]) for r in rows} and any("<circle" in v for v in got.values())
    got = {(r["doc_id"], r["handle"]): json.loads(r["json"]) for r in catalogue.QUERIES["json_export_whole"](spark, DATA).collect()}
    assert got == {r[:2]: {"type": r[2], "handle": r[1], "layer": r[3], "geometry": dict(zip(("x0", "y0", "x1", "y1"), r[4:]))} for r in rows}
