"""Block references with general affine maps: matrices composed down the references, and applied to each entity type.

A map is the columns a, b, c, d, e, f: x' = a x + c y + e, y' = b x + d y + f.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotweave.plans.durable import Scratch

MAP = ("a", "b", "c", "d", "e", "f")
_SAME = 1e-9  # relative difference of axes up to which a map keeps circles


def identity() -> list[Column]:
    return [F.lit(v).alias(c) for c, v in zip(MAP, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))]


def reference_map(sx: Column, sy: Column, rot_deg: Column, tx: Column, ty: Column, base_x: Column | None = None, base_y: Column | None = None) -> dict[str, Column]:
    """The map of a block reference: the base point goes to the origin, then scale, turn and move."""
    c, s = F.cos(F.radians(rot_deg)), F.sin(F.radians(rot_deg))
    a, b, p, q = sx * c, sx * s, -sy * s, sy * c
    bx, by = base_x if base_x is not None else F.lit(0.0), base_y if base_y is not None else F.lit(0.0)
    return {"a": a, "b": b, "c": p, "d": q, "e": tx - a * bx - p * by, "f": ty - b * bx - q * by}


def composed(outer: str, inner: str) -> dict[str, Column]:
    """The map that applies the columns behind ``inner`` first, then those behind ``outer``."""
    o, i = ({c: F.col(f"{p}{c}") for c in MAP} for p in (outer, inner))
    return {
        "a": o["a"] * i["a"] + o["c"] * i["b"], "b": o["b"] * i["a"] + o["d"] * i["b"], "c": o["a"] * i["c"] + o["c"] * i["d"], "d": o["b"] * i["c"] + o["d"] * i["d"],
        "e": o["a"] * i["e"] + o["c"] * i["f"] + o["e"], "f": o["b"] * i["e"] + o["d"] * i["f"] + o["f"]}


def cells(refs: DataFrame) -> DataFrame:
    """A row for each cell of row and column arrays; steps run along the turned axes of the reference and aren't scaled.

    ``refs`` has columns, rows, column_step, row_step beside sx, sy, rot_deg, tx, ty; null or less than one means one.
    """
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1))
    out = refs.withColumn("column", F.explode(F.sequence(F.lit(0), n("columns") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), n("rows") - 1)))
    u, v = F.col("column") * F.coalesce("column_step", F.lit(0.0)), F.col("row") * F.coalesce("row_step", F.lit(0.0))
    c, s = F.cos(F.radians("rot_deg")), F.sin(F.radians("rot_deg"))
    return out.withColumns({"tx": F.col("tx") + u * c - v * s, "ty": F.col("ty") + u * s + v * c}).drop("columns", "rows", "column_step", "row_step")


def block_closure(refs: DataFrame, depth: int | None = 4) -> DataFrame:
    """block, inside, level, and a map: every block that ``block`` contains, itself at level 0, for each way there.

    ``refs`` has owner, child and a map. A block that is already on the way is not entered again, so cycles end.
    ``depth`` None follows references as far as they go. Each level is a written table, so plans stay short. Blocks are expanded
    once, not once for each reference to them.
    """
    scratch = Scratch(refs.sparkSession, "blocks")
    r = refs.select("owner", "child", *(F.col(c).alias(f"r_{c}") for c in MAP))
    names = r.select(F.col("owner").alias("block")).union(r.select("child")).where("block is not null").distinct()
    now = scratch.write(names.select("block", F.col("block").alias("inside"), F.lit(0).alias("level"), *identity(), F.array("block").alias("way")), "level-0")
    out, level = now, 0
    while depth is None or level < depth:
        level += 1
        steps = now.select("block", "inside", "way", *(F.col(c).alias(f"o_{c}") for c in MAP)).join(r, F.col("inside") == F.col("owner")).where(~F.array_contains("way", F.col("child")))
        now = scratch.write(steps.select("block", F.col("child").alias("inside"), F.lit(level).alias("level"), *(m.alias(c) for c, m in composed("o_", "r_").items()), F.concat("way", F.array("child")).alias("way")), f"level-{level}")
        if now.isEmpty():
            break
        out = out.union(now)
    return out.drop("way")


def expanded(roots: DataFrame, refs: DataFrame, depth: int | None = 4) -> DataFrame:
    """The rows of ``roots`` (block, a map, ...) once for each block that theirs contains, with inside, level and the whole map.

    A root whose block has no references and is in none is its own only row.
    """
    inner = block_closure(refs, depth).select(F.col("block").alias("own_block"), "inside", "level", *(F.col(c).alias(f"i_{c}") for c in MAP))
    keep = [c for c in roots.columns if c not in MAP]
    met = roots.select(*keep, *(F.col(c).alias(f"o_{c}") for c in MAP)).join(inner, F.col("block") == F.col("own_block"), "left")
    alone = F.col("inside").isNull()
    whole = composed("o_", "i_")
    return met.select(*keep, F.coalesce("inside", "block").alias("inside"), F.coalesce("level", F.lit(0)).alias("level"), *(F.when(alone, F.col(f"o_{c}")).otherwise(whole[c]).alias(c) for c in MAP))


# --- maps applied to entity types ---


def mapped_point(x: Column, y: Column, p: str = "") -> tuple[Column, Column]:
    m = {c: F.col(f"{p}{c}") for c in MAP}
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def determinant(p: str = "") -> Column:
    """Area of the image of the unit square; negative where the map mirrors."""
    return F.col(f"{p}a") * F.col(f"{p}d") - F.col(f"{p}b") * F.col(f"{p}c")


def _axes(p: str) -> tuple[Column, Column, Column]:
    """Squares of the images of both axes, and their product."""
    a, b, c, d = (F.col(f"{p}{k}") for k in "abcd")
    return a * a + b * b, c * c + d * d, a * c + b * d


def keeps_circles(p: str = "") -> Column:
    """Whether the map is a similarity: axes stay as long as each other and at right angles."""
    u, v, w = _axes(p)
    return (F.abs(u - v) <= _SAME * (u + v)) & (F.abs(w) <= _SAME * (u + v))


def mapped_circle(cx: Column, cy: Column, radius: Column, start: Column | None = None, stop: Column | None = None, p: str = "") -> dict[str, Column]:
    """The image of a circle, or of an arc from ``start`` to ``stop`` anticlockwise (radians), as an ellipse.

    kind (CIRCLE or ARC where the map keeps circles, else ELLIPSE), cx, cy, major_x, major_y (from the centre), ratio, start, stop: for
    circles and arcs the angles of the image, for ellipses its parameters. A mirror exchanges the ends of an arc. A map
    that flattens the plane gives a ratio of 0.
    """
    whole = start is None
    start, stop = (F.lit(0.0), F.lit(6.283185307179586)) if whole else (start, stop)
    u, v, w = _axes(p)
    a, b, c, d = (F.col(f"{p}{k}") for k in "abcd")
    same = keeps_circles(p)
    turn = F.when(same, 0.0).otherwise(F.atan2(2 * w, u - v) / 2)  # the parameter whose image is farthest from the centre
    mx, my = radius * (a * F.cos(turn) + c * F.sin(turn)), radius * (b * F.cos(turn) + d * F.sin(turn))
    nx, ny = radius * (c * F.cos(turn) - a * F.sin(turn)), radius * (d * F.cos(turn) - b * F.sin(turn))
    long = F.sqrt(mx * mx + my * my)
    x, y = mapped_point(cx, cy, p)
    mirrored = determinant(p) < 0
    shift = F.when(same, F.atan2(b, a)).otherwise(-turn)  # angles of the image turn with the first axis
    at = lambda t: F.when(mirrored, F.when(same, shift - t).otherwise(turn - t)).otherwise(t + shift)
    first, last = F.when(mirrored, at(stop)).otherwise(at(start)), F.when(mirrored, at(start)).otherwise(at(stop))
    return {
        "kind": F.when(~same, "ELLIPSE").otherwise("CIRCLE" if whole else "ARC"), "cx": x, "cy": y, "major_x": mx, "major_y": my,
        "ratio": F.when(long > 0, F.sqrt(nx * nx + ny * ny) / long).otherwise(0.0), "start": F.lit(0.0) if whole else first, "stop": F.lit(6.283185307179586) if whole else last}


def mapped_bulge(bulge: Column, p: str = "") -> Column:
    """The bulge of a segment's image: a mirror turns its side. Where the map doesn't keep circles the arc is no arc any more; see ``bulge_points``."""
    return F.when(determinant(p) < 0, -bulge).otherwise(bulge)


def bulge_points(x0: Column, y0: Column, x1: Column, y1: Column, bulge: Column, parts: int = 16, steps: Column | None = None) -> Column:
    """array<struct<x, y>>: the ends of a segment and ``parts`` - 1 points between them on its arc, to be mapped one by one; of them only ``steps`` if given."""
    turn = 4 * F.atan(bulge)
    dx, dy = x1 - x0, y1 - y0
    off = (1 - bulge * bulge) / (4 * bulge)
    cx, cy = (x0 + x1) / 2 - dy * off, (y0 + y1) / 2 + dx * off

    def at(k: Column) -> Column:
        t = k / F.lit(float(parts))
        c, s = F.cos(turn * t), F.sin(turn * t)
        straight = (bulge == 0) | ((dx == 0) & (dy == 0))
        x = F.when(straight, x0 + dx * t).otherwise(cx + (x0 - cx) * c - (y0 - cy) * s)
        y = F.when(straight, y0 + dy * t).otherwise(cy + (x0 - cx) * s + (y0 - cy) * c)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(parts)) if steps is None else steps, at)


def mapped_text(x: Column, y: Column, height: Column, rotation_deg: Column, p: str = "") -> dict[str, Column]:
    """Position, height and rotation of a text's image, after the image of its base line; the height scales with the area over the line."""
    a, b, c, d = (F.col(f"{p}{k}") for k in "abcd")
    u, v = F.cos(F.radians(rotation_deg)), F.sin(F.radians(rotation_deg))
    lx, ly = a * u + c * v, b * u + d * v
    long = F.sqrt(lx * lx + ly * ly)
    px, py = mapped_point(x, y, p)
    return {"x": px, "y": py, "height": F.when(long > 0, height * F.abs(determinant(p)) / long).otherwise(height), "rotation_deg": F.degrees(F.atan2(ly, lx)), "mirrored": determinant(p) < 0}


def mapped_box(x0: Column, y0: Column, x1: Column, y1: Column, p: str = "") -> dict[str, Column]:
    """The box of a box's image."""
    corners = [mapped_point(x, y, p) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}
