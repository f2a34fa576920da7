"""Catalog operators: attribute inheritance, statistics, references, draw order, block expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plotweave.functions import geometry as g
from plotweave.operators.spatial import band_join
from plotweave.plans.durable import checkpointed

BY_LAYER, BY_BLOCK = 256, 0


def with_layer(entities: DataFrame, layers: DataFrame) -> DataFrame:
    """Entities with the attributes of their layer, which is found by its name without regard to case."""
    named = layers.select(F.lower("name").alias("layer_key"), F.col("aci").alias("layer_aci"), F.col("linetype").alias("layer_linetype"), F.col("is_on").alias("layer_on"))
    return entities.join(named, F.lower("layer") == F.col("layer_key"), "left").drop("layer_key")


def effective_colour(mode: str = "strict") -> Column:
    """Colour index after inheritance: by layer from the layer; by block stays, or is 7 in mode ``library``."""
    own = F.when(F.col("aci") == BY_LAYER, F.abs(F.col("layer_aci"))).otherwise(F.col("aci"))
    return F.when(F.col("aci") == BY_BLOCK, F.lit(7)).otherwise(own) if mode == "library" else own


def effective_linetype() -> Column:
    own = F.upper(F.trim("linetype"))
    return F.when(own == "BYLAYER", F.upper(F.trim("layer_linetype"))).otherwise(own)


def type_histogram(entities: DataFrame, top: int = 20) -> DataFrame:
    """Entities by type, the most frequent first; a report of ``top`` lines."""
    return entities.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(top)


def document_info(entities: DataFrame) -> DataFrame:
    """Counts and extents of each document."""
    return entities.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_entities"), F.countDistinct("layer").alias("n_layers"), F.count_if(F.col("type") == "INSERT").alias("n_inserts"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def union_boxes(boxes: DataFrame, by: list[str], pad: float = 0.0) -> DataFrame:
    """The box around the boxes of each group; null boxes take no part."""
    return boxes.groupBy(*by).agg((F.min("x0") - pad).alias("x0"), (F.min("y0") - pad).alias("y0"), (F.max("x1") + pad).alias("x1"), (F.max("y1") + pad).alias("y1"))


def dangling(entities: DataFrame, layers: DataFrame) -> DataFrame:
    """Entities whose layer isn't in the table."""
    return entities.join(layers.select(F.lower("name").alias("key")), F.lower("layer") == F.col("key"), "left_anti")


def draw_order(entities: DataFrame, sorters: DataFrame) -> DataFrame:
    """Position of each entity in its document, by its sorter handle or else its own."""
    named = sorters.select(F.col("handle").alias("of"), "sorter")
    order = F.coalesce("sorter", "handle")
    return entities.join(named, F.col("handle") == F.col("of"), "left").select("doc_id", "handle", F.row_number().over(W.partitionBy("doc_id").orderBy(order, "handle")).alias("position"))


def renumbered(rows: DataFrame, key: str, seed: int, blocks: int = 64) -> DataFrame:
    """Handles seed + 1, seed + 2, ... in the order of ``key``, without sorting all rows in one task.

    Rows are dealt by range; the counts of the ranges, of which there are ``blocks``, give each its first number.
    """
    dealt = rows.repartitionByRange(blocks, key).withColumn("range", F.spark_partition_id())
    dealt = checkpointed(dealt)  # the ranges must not be dealt again
    counts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    first = counts.withColumn("first", F.sum("n").over(W.orderBy("range")) - F.col("n")).select("range", "first")
    at = F.row_number().over(W.partitionBy("range").orderBy(key))
    return dealt.withColumn("at", at).join(F.broadcast(first), "range").withColumn("new_handle", (F.col("first") + F.col("at") + seed).cast("long")).drop("range", "first", "at")


def expand_blocks(roots: DataFrame, refs: DataFrame, depth: int = 4) -> DataFrame:
    """Flatten block references: (root, block, level, a, d, e, f) with x' = a x + e and y' = d y + f.

    ``roots`` has root, block; ``refs`` has owner, child, sx, sy, tx, ty. A block that is already on the path is not
    entered again. Each level is one join, so the plan is as deep as ``depth``.
    """
    now = roots.select("root", "block", F.lit(0).alias("level"), *[F.lit(v).alias(c) for c, v in (("a", 1.0), ("d", 1.0), ("e", 0.0), ("f", 0.0))], F.array("block").alias("path"))
    out = now
    for level in range(1, depth + 1):
        now = now.join(refs, now["block"] == refs["owner"]).where(~F.array_contains("path", F.col("child"))).select(
            "root", F.col("child").alias("block"), F.lit(level).alias("level"), (F.col("a") * F.col("sx")).alias("a"), (F.col("d") * F.col("sy")).alias("d"),
            (F.col("a") * F.col("tx") + F.col("e")).alias("e"), (F.col("d") * F.col("ty") + F.col("f")).alias("f"), F.concat("path", F.array("child")).alias("path"))
        out = out.unionByName(now)
    return out.drop("path")


def insert_array(inserts: DataFrame) -> DataFrame:
    """One row for each cell of row and column arrays."""
    return inserts.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).withColumn("tx", F.col("tx") + F.col("col") * F.col("dx")).withColumn("ty", F.col("ty") + F.col("row") * F.col("dy"))


def segments(vertices: DataFrame, closed: bool = False) -> DataFrame:
    """owner, seq, ax, ay, bx, by of the segments between following vertices."""
    w = W.partitionBy("owner").orderBy("seq")
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    if closed:
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        nx, ny = F.coalesce(nx, F.first("x").over(whole)), F.coalesce(ny, F.first("y").over(whole))
    return vertices.select("owner", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), nx.alias("bx"), ny.alias("by")).where("bx is not null")


def polyline_lengths(vertices: DataFrame) -> DataFrame:
    s = segments(vertices)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return s.groupBy("owner").agg(F.count(F.lit(1)).alias("n_segments"), F.round(F.sum(F.sqrt(dx * dx + dy * dy)), 6).alias("length"))


def slope_flips(vertices: DataFrame, least: float = 1.0) -> DataFrame:
    """Changes of the sign of dy along each polyline; steps under ``least`` don't count."""
    s = segments(vertices).withColumn("dy", F.col("by") - F.col("ay"))
    s = s.where(F.abs("dy") >= least).withColumn("sign", F.signum("dy"))
    s = s.withColumn("before", F.lag("sign").over(W.partitionBy("owner").orderBy("seq")))
    return s.groupBy("owner").agg(F.count_if(F.col("sign") != F.col("before")).alias("flips"))


def resolved(entities: DataFrame, by_handle: DataFrame, by_name: DataFrame) -> DataFrame:
    """Reference by handle, or else by name: ``target`` and how it was found."""
    h = by_handle.select(F.col("handle").alias("ref_handle"), F.col("name").alias("handle_name"))
    n = by_name.select(F.lower("name").alias("key"), F.col("name").alias("named"))
    out = entities.join(h, "ref_handle", "left").join(n, F.lower("ref_name") == F.col("key"), "left")
    how = F.when(F.col("handle_name").isNotNull(), "handle").when(F.col("named").isNotNull(), "name").otherwise("missing")
    return out.select(*entities.columns, F.coalesce("handle_name", "named").alias("target"), how.alias("found_by"))


def chains(links: DataFrame) -> DataFrame:
    """(head, handle, step) of linked lists (handle, next), by pointer doubling: log2 of the longest chain joins.

    A head is a handle that no other points to; handles on a cycle have none and are left out.
    """
    heads = links.join(links.select(F.col("next").alias("to")), F.col("handle") == F.col("to"), "left_anti")
    found = heads.select(F.col("handle").alias("head"), "handle", F.lit(0).cast("long").alias("step"))
    hop, width = links.where("next is not null").select(F.col("handle").alias("from"), F.col("next").alias("to")), 1
    while True:
        more = found.join(hop, found["handle"] == hop["from"]).select("head", F.col("to").alias("handle"), (F.col("step") + width).alias("step"))
        more = checkpointed(more)
        if more.isEmpty():
            return found
        found = checkpointed(found.union(more))
        on = hop.select(F.col("from").alias("mid"), F.col("to").alias("end"))
        hop = checkpointed(hop.join(on, F.col("to") == F.col("mid")).select("from", F.col("end").alias("to")))
        width *= 2


def dashes(vertices: DataFrame, pattern: tuple[float, ...]) -> DataFrame:
    """owner, k, start, stop: the drawn parts of a line type along each polyline, by the distance from its start.

    Positive lengths are dashes, negative ones gaps, and the pattern repeats to the end of the line.
    """
    whole = sum(abs(v) for v in pattern)
    total = polyline_lengths(vertices).where("length > 0")
    edges, at = [], 0.0
    for v in pattern:
        if v > 0:
            edges.append((at, at + v))
        at += abs(v)
    parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in edges])
    each = total.select("owner", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / whole))).alias("turn"))
    drawn = each.select("owner", "length", "turn", F.posexplode(parts).alias("i", "part"))
    start, stop = F.col("turn") * whole + F.col("part.a"), F.col("turn") * whole + F.col("part.b")
    return drawn.where(start < F.col("length")).select("owner", (F.col("turn") * len(edges) + F.col("i")).alias("k"), start.alias("start"), F.least(stop, F.col("length")).alias("stop"))


def key_points(entities: DataFrame) -> DataFrame:
    """handle, i, x, y: ends of lines and arcs, the four quadrants of circles, the corners of all else."""
    x0, y0, x1, y1 = (F.col(c) for c in g.BOX)
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    at = lambda *ps: F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ps])
    pts = F.when(F.col("type").isin("LINE", "ARC"), at((x0, y0), (x1, y1))).when(F.col("type") == "CIRCLE", at((x0, cy), (x1, cy), (cx, y0), (cx, y1))).otherwise(at((x0, y0), (x1, y0), (x0, y1), (x1, y1)))
    return entities.select("handle", F.posexplode(pts).alias("i", "p")).select("handle", "i", "p.x", "p.y")


def viewport_select(viewports: DataFrame, entities: DataFrame) -> DataFrame:
    """viewport, handle, full: what each viewport's model box shows, in whole or in part."""
    met = band_join(viewports, entities, ["doc_id"], 64.0, 0.0, g.near("l_", "r_", 0.0))
    return met.select(F.col("l_viewport").alias("viewport"), F.col("r_handle").alias("handle"), g.contains("l_", "r_").alias("full"))
