"""Box, segment and affine geometry as column expressions.

A box is four columns named x0, y0, x1, y1 behind a prefix. Three notions of nearness exist and are kept apart:
``near`` (per axis, inclusive), ``overlaps`` (per axis on expanded boxes) and ``merges`` (Euclidean, strict).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BOX = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in BOX]


def axis_gap(a: str, b: str, axis: str) -> Column:
    """Gap of two boxes along an axis; negative where they overlap."""
    return F.greatest(F.col(f"{a}{axis}0") - F.col(f"{b}{axis}1"), F.col(f"{b}{axis}0") - F.col(f"{a}{axis}1"))


def near(a: str, b: str, tol: float) -> Column:
    """Both gaps are at most ``tol``; this also holds for boxes that meet or lie in one another."""
    return (axis_gap(a, b, "x") <= tol) & (axis_gap(a, b, "y") <= tol)


def overlaps(a: str, b: str, tol: float) -> Column:
    """The boxes meet once one of them is grown by ``tol``."""
    apart = lambda axis: (F.col(f"{a}{axis}1") + tol < F.col(f"{b}{axis}0")) | (F.col(f"{b}{axis}1") + tol < F.col(f"{a}{axis}0"))
    return ~(apart("x") | apart("y"))


def distance(a: str, b: str) -> Column:
    """Euclidean distance of two boxes, 0 where they meet."""
    zero = F.lit(0.0)
    return F.sqrt(F.pow(F.greatest(axis_gap(a, b, "x"), zero), 2) + F.pow(F.greatest(axis_gap(a, b, "y"), zero), 2))


def area(p: str = "") -> Column:
    x0, y0, x1, y1 = box(p)
    return (x1 - x0) * (y1 - y0)


def merges(a: str, b: str, gap: float, ratio: float | None = None) -> Column:
    """Closer than ``gap`` or meeting; with ``ratio`` only if the areas differ by that factor, which is asked first."""
    close = (distance(a, b) < gap) | near(a, b, 0.0)
    if ratio is None:
        return close
    small, large = F.least(area(a), area(b)), F.greatest(area(a), area(b))
    return (small > 0) & (large >= F.lit(ratio) * small) & close


def contains(outer: str, inner: str, tol: float = 0.0) -> Column:
    o, i = box(outer), box(inner)
    return (i[0] >= o[0] - tol) & (i[1] >= o[1] - tol) & (i[2] <= o[2] + tol) & (i[3] <= o[3] + tol)


def diagonal(p: str = "") -> Column:
    x0, y0, x1, y1 = box(p)
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def distance_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment; a segment of no length is a point."""
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    t = F.when(long2 > 0, ((px - ax) * dx + (py - ay) * dy) / long2).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def affine(a, b, c, d, e, f, x: Column, y: Column) -> tuple[Column, Column]:
    """(a x + c y + e, b x + d y + f)."""
    return a * x + c * y + e, b * x + d * y + f


def bulge_arc(x1: Column, y1: Column, x2: Column, y2: Column, bulge: Column) -> dict[str, Column]:
    """Centre, radius, start and end angle of the arc between two vertices; the angle is 4 atan |bulge|."""
    dx, dy = x2 - x1, y2 - y1
    chord = F.sqrt(dx * dx + dy * dy)
    radius = chord * (1 + bulge * bulge) / (4 * F.abs(bulge))
    offset = (1 - bulge * bulge) / (4 * bulge)
    cx, cy = (x1 + x2) / 2 - dy * offset, (y1 + y2) / 2 + dx * offset
    first, last = F.atan2(y1 - cy, x1 - cx), F.atan2(y2 - cy, x2 - cx)
    return {"cx": cx, "cy": cy, "radius": radius, "start": F.when(bulge > 0, first).otherwise(last), "stop": F.when(bulge > 0, last).otherwise(first)}


def arc_box(cx: Column, cy: Column, r: Column, start_deg: Column, stop_deg: Column) -> dict[str, Column]:
    """Exact box of an arc that runs anticlockwise: its ends, and the quadrants that it passes."""
    turn = F.pmod(stop_deg - start_deg, F.lit(360.0))
    turn = F.when(turn == 0, 360.0).otherwise(turn)
    passes = lambda q: F.pmod(F.lit(float(q)) - start_deg, F.lit(360.0)) <= turn
    xs = [cx + r * F.cos(F.radians(start_deg)), cx + r * F.cos(F.radians(stop_deg))]
    ys = [cy + r * F.sin(F.radians(start_deg)), cy + r * F.sin(F.radians(stop_deg))]
    pick = lambda f, q, v, own: F.when(passes(q), v).otherwise(f(*own))
    return {"x0": pick(F.least, 180, cx - r, xs), "y0": pick(F.least, 270, cy - r, ys), "x1": pick(F.greatest, 0, cx + r, xs), "y1": pick(F.greatest, 90, cy + r, ys)}


def placed_box(w: Column, h: Column, tx: Column, ty: Column, sx: Column, sy: Column, rot_deg: Column, exact: bool) -> list[Column]:
    """Box of a block (0,0)-(w,h) that is scaled, turned and moved; the compatible form leaves the turn out."""
    if not exact:
        return [tx, ty, tx + w * sx, ty + h * sy]
    c, s = F.cos(F.radians(rot_deg)), F.sin(F.radians(rot_deg))
    xs, ys = [], []
    for u, v in ((F.lit(0.0), F.lit(0.0)), (w * sx, F.lit(0.0)), (F.lit(0.0), h * sy), (w * sx, h * sy)):
        xs.append(tx + u * c - v * s)
        ys.append(ty + u * s + v * c)
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def ellipse_point(cx: Column, cy: Column, major: Column, minor: Column, turn: Column, t: Column) -> tuple[Column, Column]:
    """The point of a turned ellipse at parameter ``t``; angles in radians."""
    u, v = major * F.cos(t), minor * F.sin(t)
    return cx + u * F.cos(turn) - v * F.sin(turn), cy + u * F.sin(turn) + v * F.cos(turn)


def ellipse_box(cx: Column, cy: Column, major: Column, minor: Column, turn: Column, samples: int = 100) -> dict[str, Column]:
    """Box of ``samples`` points of an ellipse, as far apart in the parameter."""
    ts = F.sequence(F.lit(0), F.lit(samples - 1))
    at = lambda k: ellipse_point(cx, cy, major, minor, turn, k * (6.283185307179586 / samples))
    xs, ys = F.transform(ts, lambda k: at(k)[0]), F.transform(ts, lambda k: at(k)[1])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def arc_ends(cx: Column, cy: Column, r: Column, start_deg: Column, stop_deg: Column) -> list[Column]:
    """x and y of an arc's start and of its end."""
    return [f for a in (start_deg, stop_deg) for f in (cx + r * F.cos(F.radians(a)), cy + r * F.sin(F.radians(a)))]


def turned_pattern_line(angle_deg: Column, x: Column, y: Column, dx: Column, dy: Column, move: tuple[Column, Column], scale: Column, turn_deg: Column) -> dict[str, Column]:
    """A line of a hatch pattern after scaling, turning and moving; dashes only scale."""
    c, s = F.cos(F.radians(turn_deg)), F.sin(F.radians(turn_deg))
    turned = lambda u, v: ((u * c - v * s) * scale, (u * s + v * c) * scale)
    (bx, by), (ox, oy) = turned(x, y), turned(dx, dy)
    return {"angle": angle_deg + turn_deg, "x": bx + move[0], "y": by + move[1], "dx": ox, "dy": oy}
