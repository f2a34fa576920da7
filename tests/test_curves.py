"""Splines, the codec, greedy labels and chains."""

import numpy as np
import pytest

from plotweave.operators import curves, drawing


@pytest.mark.parametrize("fit,want", [
    ([(0, -5), (5, 0)], [(0, -5), (1.6667, -3.3333), (3.3333, -1.6667), (5, 0)]),
    ([(0, -5), (5, 0), (10, -5)], [(0, -5), (1.6667, -2.5), (5, 2.5), (8.3333, -2.5), (10, -5)]),
])
def test_fit_points(fit, want):
    assert np.allclose(curves.control_points(np.array(fit, float)), want, atol=1e-4)


def test_spline_goes_through_its_ends():
    pts = np.array([(0, 0), (1, 3), (2, -1), (4, 4), (5, 0)], float)
    assert np.allclose(curves.evaluate(pts, 0.0), pts[0]) and np.allclose(curves.evaluate(pts, 1.0), pts[-1])


def test_codec_round_trip():
    pts = np.array([(0.5, -2.0), (1.0, 0.25)])
    assert curves.unpack(curves.pack(pts)).tolist() == [[16384, -32767], [32767, 8192]]
    assert curves.unpack(curves.pack(np.zeros((0, 2)))).tolist() == []


def test_greedy_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 500.0, 0.0), (2, 4, 0.0, 0.0)], "doc_id long, handle long, x double, y double")
    groups = spark.createDataFrame([(1, 10, 1.0, 0.0, 1.0, 0.0), (1, 11, 4.0, 0.0, 4.0, 0.0)], "doc_id long, handle long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, curves.assign_labels(labels, groups, 10.0).collect())) == [(1, 1, 10), (1, 2, 11)]


def test_chains_leave_cycles_out(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, None), (7, 8), (8, 7), (9, None)], "handle long, next long")
    assert sorted(map(tuple, drawing.chains(links).collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (9, 9, 0)]


def test_expansion_stops_at_cycles(spark):
    refs = spark.createDataFrame([(1, 2, 2.0, 1.0, 5.0, 0.0), (2, 1, 1.0, 1.0, 0.0, 0.0), (2, 3, 1.0, 3.0, 1.0, 1.0)], "owner long, child long, sx double, sy double, tx double, ty double")
    roots = spark.createDataFrame([(1, 1)], "root long, block long")
    got = sorted(tuple(r) for r in drawing.expand_blocks(roots, refs).collect())
    assert got == [(1, 1, 0, 1.0, 1.0, 0.0, 0.0), (1, 2, 1, 2.0, 1.0, 5.0, 0.0), (1, 3, 2, 2.0, 3.0, 7.0, 1.0)]
