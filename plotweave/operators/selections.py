"""Choice of entities and table entries, reports about them, and changes of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plotweave.functions import geometry as g
from plotweave.operators.spatial import band_join

#: Characters that names may not hold: fixed values of the format.
ILLEGAL = '\\/:*?"<>|;,=`'


def valid_name(name: Column, longest: int = 255) -> Column:
    """Whether a name may be written: not empty, not too long (31 in old versions), without illegal characters."""
    return F.coalesce((F.length(name) > 0) & (F.length(name) <= longest) & (F.translate(name, ILLEGAL, "") == name), F.lit(False))


def allowed(name: Column, include: Sequence[str] = (), include_regex: Sequence[str] = (), exclude: Sequence[str] = (), exclude_regex: Sequence[str] = ()) -> Column:
    """Whether a name is among the included ones, by name or pattern (all are if none is given), and not among the excluded."""
    named = lambda names, patterns: F.greatest(F.lit(False), F.lit(False), name.isin(*names) if names else F.lit(False), *[name.rlike(x) for x in patterns if x.strip()])
    wanted = named(include, include_regex) if include or include_regex else F.lit(True)
    return wanted & ~named(exclude, exclude_regex)


def without_handles(entities: DataFrame, handles: DataFrame) -> DataFrame:
    """Entities whose handle isn't listed."""
    return entities.join(handles.select("handle"), "handle", "left_anti")


def extents(boxes: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    return boxes.groupBy(*by).agg(F.min("x0").alias("e_x0"), F.min("y0").alias("e_y0"), F.max("x1").alias("e_x1"), F.max("y1").alias("e_y1"))


def lower_right(entities: DataFrame, part: float = 0.3) -> DataFrame:
    """Each document's lower right zone, where title blocks stand: ``part`` of its extent along both axes."""
    e = extents(entities)
    return e.select("doc_id", (F.col("e_x1") - (F.col("e_x1") - F.col("e_x0")) * part).alias("e_x0"), "e_y0", "e_x1", (F.col("e_y0") + (F.col("e_y1") - F.col("e_y0")) * part).alias("e_y1"))


def outside(entities: DataFrame, regions: DataFrame) -> DataFrame:
    """Entities that don't lie wholly in the region (doc_id, e_x0, e_y0, e_x1, e_y1) of their document."""
    x0, y0, x1, y1 = g.box()
    a = [F.col(f"e_{c}") for c in g.BOX]
    inside = (x0 >= a[0]) & (y0 >= a[1]) & (x1 <= a[2]) & (y1 <= a[3])
    return entities.join(regions, "doc_id", "left").where(~F.coalesce(inside, F.lit(False))).drop(*[f"e_{c}" for c in g.BOX])


def without_grid_lines(entities: DataFrame, part: float = 0.5, longest: float = 2000.0) -> DataFrame:
    """Entities no wider and no taller than ``part`` of the document's extent, nor than ``longest``."""
    x0, y0, x1, y1 = g.box()
    limit = lambda axis: F.least((F.col(f"e_{axis}1") - F.col(f"e_{axis}0")) * part, F.lit(longest))
    kept = entities.join(extents(entities), "doc_id").where((x1 - x0 <= limit("x")) & (y1 - y0 <= limit("y")))
    return kept.drop(*[f"e_{c}" for c in g.BOX])


def adaptive_tolerance(a: str, b: str, part: float = 0.2, least: float = 1.0, most: float = 20.0) -> Column:
    """``part`` of the least side of two boxes, between ``least`` and ``most``."""
    sides = [F.col(f"{p}{axis}1") - F.col(f"{p}{axis}0") for p in (a, b) for axis in "xy"]
    return F.least(F.greatest(F.least(*sides) * part, F.lit(least)), F.lit(most))


def adaptive_pairs(boxes: DataFrame, on: list[str], key: str = "handle", cell: float = 16.0, most: float = 20.0) -> DataFrame:
    """Pairs of boxes whose gaps are at most their own tolerance.

    No pair's tolerance exceeds that of a box with itself, so boxes are filed with the largest of these rather than with ``most``.
    """
    reach = boxes.select(F.max(adaptive_tolerance("", "", most=most))).first()[0]
    tol = adaptive_tolerance("l_", "r_", most=most)
    near = (g.axis_gap("l_", "r_", "x") <= tol) & (g.axis_gap("l_", "r_", "y") <= tol)
    return band_join(boxes, boxes, on, cell, most if reach is None else min(most, reach), near & (F.col(f"l_{key}") < F.col(f"r_{key}")))


def first_group(groups: DataFrame, entities: DataFrame, tol: float = 0.0) -> DataFrame:
    """(handle, group) of entities that lie in a group's box; of several groups the first one, by number."""
    met = band_join(groups, entities, ["doc_id"], 32.0, tol, g.contains("l_", "r_", tol))
    return met.groupBy(F.col("r_handle").alias("handle")).agg(F.min("l_handle").alias("group"))


def representative_bounds(entities: DataFrame) -> DataFrame:
    """Bounds of each document by representative points: a circle counts with its centre alone."""
    x0, y0, x1, y1 = g.box()
    circle = F.col("type") == "CIRCLE"
    mid = lambda a, b: (a + b) / 2
    pick = lambda c, other, v: F.when(circle, mid(c, other)).otherwise(v)
    return entities.groupBy("doc_id").agg(F.min(pick(x0, x1, x0)).alias("x0"), F.min(pick(y0, y1, y0)).alias("y0"), F.max(pick(x0, x1, x1)).alias("x1"), F.max(pick(y0, y1, y1)).alias("y1"))


def zone_text(texts: DataFrame, by: list[str]) -> DataFrame:
    """The texts of each zone as one upper-cased string, TEXT before MTEXT, by handle; a zone's texts meet in one row."""
    each = F.struct((F.col("type") != "TEXT").alias("late"), "handle", F.upper("value").alias("value"))
    return texts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda s: s["value"]), "").alias("text"))


def description(texts: DataFrame, by: list[str]) -> DataFrame:
    """The texts of each group as one string, from the top down and from left to right; a group's texts meet in one row."""
    each = F.struct((-F.col("y")).alias("down"), "x", "handle", "value")
    return texts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda s: s["value"]), "").alias("description"))


def cluster_contents(members: DataFrame) -> DataFrame:
    """What each cluster (doc_id, cluster) holds: flags that reports on unknown clusters count."""
    is_ = lambda *types: F.count_if(F.col("type").isin(*types))
    return members.groupBy("doc_id", "cluster").agg(
        F.count(F.lit(1)).alias("n"), (is_("LWPOLYLINE") > 0).alias("has_polyline"), (is_("CIRCLE") > 0).alias("has_circle"),
        (is_("LINE") >= 4).alias("has_lines"), (is_("TEXT", "MTEXT") > 0).alias("has_text"))


def with_entries(table: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """A table with the entries of ``new`` whose names it lacks, whatever their case; of equal new names one is added."""
    key = F.lower(name)
    known = table.select(key.alias("__key"))
    fresh = new.withColumn("__key", key).join(known, "__key", "left_anti").dropDuplicates(["__key"]).drop("__key")
    return table.unionByName(fresh)


def without_entries(table: DataFrame, gone: DataFrame, protected: Sequence[str], name: str = "name") -> DataFrame:
    """A table without the named entries; ``protected`` names stay."""
    free = gone.select(F.lower(name).alias("__key")).where(~F.col("__key").isin(*[x.lower() for x in protected])).distinct()
    return table.withColumn("__key", F.lower(name)).join(free, "__key", "left_anti").drop("__key")


def fallen_back(entities: DataFrame, layers: DataFrame, default: str) -> DataFrame:
    """Entities whose layer is gone move to ``default``."""
    there = layers.select(F.lower("name").alias("__key"), F.lit(True).alias("__there"))
    met = entities.withColumn("__key", F.lower("layer")).join(there, "__key", "left")
    return met.withColumn("layer", F.when(F.col("__there"), F.col("layer")).otherwise(F.lit(default))).drop("__key", "__there")
