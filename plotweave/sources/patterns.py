"""Hatch pattern files, JSON and SVG export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def hatch_patterns(lines: DataFrame) -> DataFrame:
    """name, description, line, angle, x, y, shift, offset, dashes of the lines (file, pos, value) of pattern files.

    A header is ``*NAME,description``; what follows a semicolon is a comment; angles stay in degrees.
    """
    clean = lines.withColumn("value", F.trim(F.regexp_replace("value", ";.*$", ""))).where("value <> ''")
    w = W.partitionBy("file").orderBy("pos")
    title = F.when(F.col("value").startswith("*"), F.col("value"))
    named = clean.withColumn("title", F.last(title, ignorenulls=True).over(w)).where(~F.col("value").startswith("*")).where("title is not null")
    parts = F.transform(F.split("value", ","), lambda v: F.trim(v).cast("double"))
    at = lambda k: F.element_at(parts, k)
    head = F.split("title", ",", 2)
    return named.select(
        F.regexp_replace(F.trim(head[0]), r"^\*", "").alias("name"), F.trim(F.try_element_at(head, F.lit(2))).alias("description"), F.row_number().over(W.partitionBy("file", "title").orderBy("pos")).alias("line"),
        at(1).alias("angle"), at(2).alias("x"), at(3).alias("y"), at(4).alias("shift"), at(5).alias("offset"), F.slice(parts, F.lit(6), F.size(parts)).alias("dashes"))


def as_json(entities: DataFrame) -> DataFrame:
    """doc_id, handle, json of each entity."""
    shape = F.struct("x0", "y0", "x1", "y1")
    return entities.select("doc_id", "handle", F.to_json(F.struct("type", "handle", "layer", shape.alias("geometry"))).alias("json"))


def as_svg(entities: DataFrame) -> DataFrame:
    """doc_id, handle, svg: an element for lines and circles, a rectangle for all else."""
    n = lambda c: F.format_string("%.3f", c)
    x0, y0, x1, y1 = map(F.col, ("x0", "y0", "x1", "y1"))
    line = F.concat(F.lit('<line x1="'), n(x0), F.lit('" y1="'), n(y0), F.lit('" x2="'), n(x1), F.lit('" y2="'), n(y1), F.lit('"/>'))
    circle = F.concat(F.lit('<circle cx="'), n((x0 + x1) / 2), F.lit('" cy="'), n((y0 + y1) / 2), F.lit('" r="'), n((x1 - x0) / 2), F.lit('"/>'))
    rect = F.concat(F.lit('<rect x="'), n(x0), F.lit('" y="'), n(y0), F.lit('" width="'), n(x1 - x0), F.lit('" height="'), n(y1 - y0), F.lit('"/>'))
    return entities.select("doc_id", "handle", F.when(F.col("type") == "LINE", line).when(F.col("type") == "CIRCLE", circle).otherwise(rect).alias("svg"))
