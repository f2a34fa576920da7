"""Shape features of polylines and lines, as the recognition rules ask for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def polylines(vertices: DataFrame) -> DataFrame:
    """owner, closed, pts, n, x0, y0, x1, y1: one row a polyline; vertices has owner, seq, x, y, closed."""
    pts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    box = [f(c).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.min, "y", "y0"), (F.max, "x", "x1"), (F.max, "y", "y1"))]
    return vertices.groupBy("owner").agg(F.max("closed").alias("closed"), pts.alias("pts"), F.count(F.lit(1)).alias("n"), *box)


def sides() -> tuple[Column, Column]:
    return F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")


def steps() -> Column:
    """Array of (dx, dy) along a polyline; a closed one goes back to its first vertex."""
    following = F.concat(F.slice("pts", 2, F.size("pts")), F.when(F.col("closed"), F.slice("pts", 1, 1)).otherwise(F.slice("pts", 1, 0)))
    return F.zip_with(F.slice("pts", 1, F.size(following)), following, lambda a, b: F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")))


def is_rectangle() -> Column:
    """Closed, four vertices at least, each near one side of the box, and all sides touched; near is 5 % of the lesser side, 1 to 5."""
    w, h = sides()
    tol = F.least(F.greatest(F.least(w, h) * 0.05, F.lit(1.0)), F.lit(5.0))
    on = lambda v, side: F.abs(v[side[0]] - F.col(side)) <= tol
    every = F.forall("pts", lambda v: on(v, "x0") | on(v, "x1") | on(v, "y0") | on(v, "y1"))
    touched = [F.exists("pts", f) for f in (lambda v: on(v, "x0"), lambda v: on(v, "x1"), lambda v: on(v, "y0"), lambda v: on(v, "y1"))]
    return F.col("closed") & (F.col("n") >= 4) & (w > 0) & (h > 0) & every & touched[0] & touched[1] & touched[2] & touched[3]


def is_diamond() -> Column:
    """Closed, four vertices at least, sides in a ratio of 0.5 to 1.5, and three or more edges that run a quarter of the lesser side along both axes."""
    w, h = sides()
    least = F.least(w, h) * 0.25
    slanted = F.size(F.filter(steps(), lambda s: (F.abs(s["dx"]) >= least) & (F.abs(s["dy"]) >= least)))
    return F.col("closed") & (F.col("n") >= 4) & (w > 0) & (h > 0) & F.coalesce(F.try_divide(w, h).between(0.5, 1.5), F.lit(False)) & (slanted >= 3)


def flips() -> Column:
    """How often the sign of dy changes along a polyline; short and level steps don't count."""
    signs = F.transform(F.filter(steps(), lambda s: ((F.abs(s["dx"]) >= 1) | (F.abs(s["dy"]) >= 1)) & (s["dy"] != 0)), lambda s: F.signum(s["dy"]))
    n = F.size(signs)
    before, after = F.slice(signs, 1, F.greatest(n - 1, F.lit(0))), F.slice(signs, 2, F.greatest(n, F.lit(1)))
    return F.size(F.filter(F.zip_with(before, after, lambda a, b: a != b), lambda x: x))


def is_w_shape(rect_w: Column, rect_h: Column) -> Column:
    """Two flips at least; 0.4 of the rectangle's width or more, and 0.2 to 0.9 of its height."""
    w, h = sides()
    return (F.col("n") >= 4) & (w >= rect_w * 0.4) & (h >= rect_h * 0.2) & (h <= rect_h * 0.9) & (flips() >= 2)


def m_lines(lines: DataFrame, by: list[str], level: float = 1.0) -> DataFrame:
    """Groups of lines (dx, dy) that make an M: four at least, two of them upright and two slanted."""
    upright, flat = F.abs("dx") < level, F.abs("dy") < level
    return lines.groupBy(*by).agg(((F.count(F.lit(1)) >= 4) & (F.count_if(upright) >= 2) & (F.count_if(~upright & ~flat) >= 2)).alias("m_shape"))


def largest(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """The key of the box of most area in each group; of equals the least key."""
    w, h = sides()
    return rows.groupBy(*by).agg(F.min_by(key, F.struct((-(w * h)).alias("less"), F.col(key))).alias(key))
