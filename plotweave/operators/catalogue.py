"""All queries of the drawing operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from plotweave.functions import geometry as g, scalars as s
from plotweave.operators import classify, curves, drawing, grouping, matching, spatial
from plotweave.plans import projection as p
from plotweave.plans.projection import with_
from plotweave.plans.tables import table
from plotweave.sources import dxf, patterns
from plotweave.streaming.notifications import windowed_patterns

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- catalog, inheritance, statistics ---

_COLOUR = "CASE WHEN e.aci = 256 THEN abs(l.aci) ELSE e.aci END"
_LINETYPE = "CASE WHEN upper(trim(e.linetype)) = 'BYLAYER' THEN upper(trim(l.linetype)) ELSE upper(trim(e.linetype)) END"


@query(f"""{with_('layers', 'entities')} SELECT type, count(*) AS n FROM entities e JOIN layers l ON lower(e.layer) = lower(l.name)
    WHERE {_COLOUR} = 3 AND {_LINETYPE} = 'CONTINUOUS' GROUP BY type ORDER BY n DESC, type LIMIT 20""")
def type_histogram(spark, sf):
    e = drawing.with_layer(p.entities(spark, sf), p.layers(spark, sf))
    return drawing.type_histogram(e.where((drawing.effective_colour() == 3) & (drawing.effective_linetype() == "CONTINUOUS")))


@query(f"""{with_('entities')} SELECT doc_id, count(*) AS n_entities, count(DISTINCT layer) AS n_layers, count(*) FILTER (type = 'INSERT') AS n_inserts,
    min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM entities GROUP BY doc_id""")
def doc_info(spark, sf):
    return drawing.document_info(p.entities(spark, sf))


@query(f"""{with_('layers', 'entities')} SELECT e.handle, {_COLOUR} AS colour, CASE WHEN e.aci = 0 THEN 7 ELSE {_COLOUR} END AS library_colour
    FROM entities e LEFT JOIN layers l ON lower(e.layer) = lower(l.name)""")
def effective_color(spark, sf):
    e = drawing.with_layer(p.entities(spark, sf), p.layers(spark, sf))
    return e.select("handle", drawing.effective_colour().alias("colour"), drawing.effective_colour("library").alias("library_colour"))


@query(f"""{with_('layers', 'entities')} SELECT e.handle, {_LINETYPE} AS linetype FROM entities e LEFT JOIN layers l ON lower(e.layer) = lower(l.name) WHERE {_LINETYPE} = 'CONTINUOUS'""")
def effective_linetype_filter(spark, sf):
    e = drawing.with_layer(p.entities(spark, sf), p.layers(spark, sf)).withColumn("effective", drawing.effective_linetype())
    return e.where(F.col("effective") == "CONTINUOUS").select("handle", F.col("effective").alias("linetype"))


@query(f"{with_('layers', 'entities')} SELECT handle, layer FROM entities WHERE NOT EXISTS (SELECT 1 FROM layers l WHERE l.is_on AND lower(l.name) = lower(entities.layer))")
def layer_anti_join_dangling(spark, sf):
    return drawing.dangling(p.entities(spark, sf), p.layers(spark, sf).where("is_on")).select("handle", "layer")


@query(f"{with_('layers', 'entities')} SELECT l.name, count(*) AS n FROM entities e JOIN layers l ON lower(upper(e.layer)) = lower(l.name) GROUP BY l.name")
def case_insensitive_name_join(spark, sf):
    e = p.entities(spark, sf).withColumn("layer", F.upper("layer"))
    return e.join(p.layers(spark, sf).select("name"), F.lower("layer") == F.lower("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{with_('blocks', 'inserts')} SELECT b.block, EXISTS (SELECT 1 FROM inserts i WHERE i.block = b.block AND i.seq = 1) AS has_first,
    NOT EXISTS (SELECT 1 FROM inserts i WHERE i.block = b.block AND i.seq = 7) AS lacks_last FROM blocks b""")
def attribute_semi_anti(spark, sf):
    b, i = p.blocks(spark, sf).select("block"), p.inserts(spark, sf)
    firsts = b.join(i.where("seq = 1"), "block", "left_semi").select("block", F.lit(True).alias("has_first"))
    lacking = b.join(i.where("seq = 7"), "block", "left_anti").select("block", F.lit(True).alias("lacks_last"))
    return b.join(firsts, "block", "left").join(lacking, "block", "left").select("block", F.coalesce("has_first", F.lit(False)).alias("has_first"), F.coalesce("lacks_last", F.lit(False)).alias("lacks_last"))


@query(f"""{with_('entities')}, sorters AS (SELECT o_orderkey AS handle, 1000000 - o_orderkey AS sorter FROM orders WHERE o_orderkey % 5 = 0)
    SELECT e.doc_id, e.handle, row_number() OVER (PARTITION BY e.doc_id ORDER BY coalesce(s.sorter, e.handle), e.handle)::INT AS position FROM entities e LEFT JOIN sorters s ON s.handle = e.handle""")
def draw_order(spark, sf):
    o = table(spark, sf, "orders")
    sorters = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("handle"), (F.lit(1000000) - F.col("o_orderkey")).alias("sorter"))
    return drawing.draw_order(p.entities(spark, sf), sorters)


@query(f"{with_('entities')} SELECT doc_id, layer, min(x0) - 0.5 AS x0, min(y0) - 0.5 AS y0, max(x1) + 0.5 AS x1, max(y1) + 0.5 AS y1 FROM entities GROUP BY doc_id, layer")
def block_extents(spark, sf):
    return drawing.union_boxes(p.entities(spark, sf), ["doc_id", "layer"], 0.5)


@query(f"{with_('layers', 'entities')} SELECT l.name, count(e.handle) AS n FROM layers l LEFT JOIN entities e ON e.layer = l.name AND e.type = 'ARC' GROUP BY l.name")
def class_instance_counts(spark, sf):
    e = p.entities(spark, sf).where("type = 'ARC'").select("layer", "handle")
    return p.layers(spark, sf).join(e, F.col("layer") == F.col("name"), "left").groupBy("name").agg(F.count("handle").alias("n"))


@query("SELECT o_orderkey AS handle, 4096 + row_number() OVER (ORDER BY o_orderkey) AS new_handle FROM orders")
def handle_renumber(spark, sf):
    return drawing.renumbered(table(spark, sf, "orders").select(F.col("o_orderkey").alias("handle")), "handle", 4096)


@query("""SELECT s_suppkey AS owner, list_distinct_n FROM (SELECT s_suppkey, (SELECT count(DISTINCT k) FROM (SELECT l_partkey AS k FROM lineitem WHERE l_suppkey = s_suppkey UNION SELECT l_orderkey FROM lineitem WHERE l_suppkey = s_suppkey)) AS list_distinct_n FROM supplier)""")
def handle_set_union(spark, sf):
    li = table(spark, sf, "lineitem")
    both = li.select("l_suppkey", F.col("l_partkey").alias("k")).union(li.select("l_suppkey", "l_orderkey")).distinct()
    n = both.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("list_distinct_n"))
    return table(spark, sf, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("owner"), F.coalesce("list_distinct_n", F.lit(0).cast("long")).alias("list_distinct_n"))


# --- geometry of inserts, blocks and polylines ---


@query(f"""{with_('blocks', 'inserts')} SELECT i.owner, i.seq, i.block, i.tie, round(tx, 6) AS x0, round(ty, 6) AS y0, round(tx + w * sx, 6) AS x1, round(ty + h * sy, 6) AS y1 FROM inserts i JOIN blocks b ON b.block = i.block""")
def insert_bbox_compat(spark, sf):
    j = p.inserts(spark, sf).join(p.blocks(spark, sf), "block")
    a = g.placed_box(*map(F.col, ("w", "h", "tx", "ty", "sx", "sy", "rot_deg")), exact=False)
    return j.select("owner", "seq", "block", "tie", *[F.round(v, 6).alias(c) for v, c in zip(a, g.BOX)])


_TURNED = """(VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS c(u, v)"""


@query(f"""{with_('blocks', 'inserts')} SELECT owner, seq, block, tie, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM (
    SELECT i.rowid_ AS r, i.owner, i.seq, i.block, i.tie, tx + u * w * sx * cos(radians(rot_deg)) - v * h * sy * sin(radians(rot_deg)) AS x, ty + u * w * sx * sin(radians(rot_deg)) + v * h * sy * cos(radians(rot_deg)) AS y
    FROM (SELECT *, row_number() OVER () AS rowid_ FROM inserts) i JOIN blocks b ON b.block = i.block, {_TURNED}) GROUP BY r, owner, seq, block, tie""")
def insert_bbox_exact(spark, sf):
    j = p.inserts(spark, sf).join(p.blocks(spark, sf), "block")
    a = g.placed_box(*map(F.col, ("w", "h", "tx", "ty", "sx", "sy", "rot_deg")), exact=True)
    return j.select("owner", "seq", "block", "tie", *[F.round(v, 6).alias(c) for v, c in zip(a, g.BOX)])


@query("""WITH RECURSIVE refs AS (SELECT p_partkey AS child, p_partkey // 3 AS owner, (1 + p_partkey % 2)::DOUBLE AS sx, (1 + p_partkey % 3)::DOUBLE AS sy, p_size::DOUBLE AS tx, (p_partkey % 11)::DOUBLE AS ty FROM part WHERE p_partkey >= 3),
    walk AS (SELECT p_partkey AS root, p_partkey AS block, 0 AS level, 1.0::DOUBLE AS a, 1.0::DOUBLE AS d, 0.0::DOUBLE AS e, 0.0::DOUBLE AS f, [p_partkey] AS path FROM part
        UNION ALL SELECT root, child, level + 1, a * sx, d * sy, a * tx + e, d * ty + f, list_append(path, child) FROM walk JOIN refs ON refs.owner = walk.block WHERE level < 4 AND NOT list_contains(path, child))
    SELECT root, block, level, a, d, e, f FROM walk""")
def block_expansion(spark, sf):
    k = F.col("p_partkey")
    part = table(spark, sf, "part")
    refs = part.where(k >= 3).select(k.alias("child"), F.floor(k / 3).cast("long").alias("owner"), (1.0 + k % 2).alias("sx"), (1.0 + k % 3).alias("sy"), F.col("p_size").cast("double").alias("tx"), (k % 11).cast("double").alias("ty"))
    return drawing.expand_blocks(part.select(k.alias("root"), k.alias("block")), refs, 4)


@query(f"""{with_('vertices')}, s AS (SELECT owner, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS b FROM vertices WINDOW w AS (PARTITION BY owner ORDER BY seq))
    SELECT owner, count(*) AS n_segments, round(sum(sqrt((bx - x) * (bx - x) + (b - y) * (b - y))), 6) AS length FROM s WHERE bx IS NOT NULL GROUP BY owner""")
def polyline_length_lead(spark, sf):
    return drawing.polyline_lengths(p.vertices(spark, sf))


@query(f"""{with_('vertices')}, s AS (SELECT owner, seq, lead(y) OVER (PARTITION BY owner ORDER BY seq) - y AS dy FROM vertices),
    t AS (SELECT owner, sign(dy) AS g, lag(sign(dy)) OVER (PARTITION BY owner ORDER BY seq) AS before FROM s WHERE abs(dy) >= 1)
    SELECT owner, count(*) FILTER (g <> before) AS flips FROM t GROUP BY owner""")
def slope_flip_count(spark, sf):
    return drawing.slope_flips(p.vertices(spark, sf))


@query(f"{with_('vertices')} SELECT owner, count(DISTINCT round_even(x / 2, 0)) AS baffles, count(DISTINCT round_even(x / 2, 0)) >= 2 AS is_silencer FROM vertices GROUP BY owner")
def distinct_baffles(spark, sf):
    n = F.countDistinct(F.rint(F.col("x") / 2))
    return p.vertices(spark, sf).groupBy("owner").agg(n.alias("baffles")).withColumn("is_silencer", F.col("baffles") >= 2)


@query(f"""{with_('vertices')}, s AS (SELECT owner, seq, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS b FROM vertices WINDOW w AS (PARTITION BY owner ORDER BY seq))
    SELECT owner, seq, ax, ay, bx, b AS "by" FROM s""")
def polyline_explode_closed(spark, sf):
    return drawing.segments(p.vertices(spark, sf), closed=True)


@query("""SELECT l_orderkey AS owner, l_linenumber AS seq, l_partkey AS block, l_suppkey AS tie, r.r AS "row", c.c AS col, l_quantity + c.c * 2.5 AS tx, l_quantity + r.r * 1.5 AS ty
    FROM lineitem, unnest(range(0, 1 + l_linenumber % 2)) AS r(r), unnest(range(0, 1 + l_linenumber % 3)) AS c(c)""")
def insert_array(spark, sf):
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("block"), F.col("l_suppkey").alias("tie"), F.col("l_quantity").alias("tx"), F.col("l_quantity").alias("ty"), F.lit(2.5).alias("dx"), F.lit(1.5).alias("dy"), (1 + F.col("l_linenumber") % 2).cast("long").alias("rows"), (1 + F.col("l_linenumber") % 3).cast("long").alias("cols"))
    out = drawing.insert_array(i.withColumns({"rows": F.col("rows"), "cols": F.col("cols")}))
    return out.select("owner", "seq", "block", "tie", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "tx", "ty")


@query(f"""{with_('vertices')}, s AS (SELECT owner, seq, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS b, CASE WHEN owner % 2 = 0 THEN 0.5 ELSE -1.0 END::DOUBLE AS k FROM vertices WINDOW w AS (PARTITION BY owner ORDER BY seq))
    SELECT owner, seq, round((x + bx) / 2 - (b - y) * ((1 - k * k) / (4 * k)), 6) + 0.0 AS cx, round((y + b) / 2 + (bx - x) * ((1 - k * k) / (4 * k)), 6) + 0.0 AS cy,
        round(sqrt((bx - x) * (bx - x) + (b - y) * (b - y)) * (1 + k * k) / (4 * abs(k)), 6) AS radius FROM s WHERE bx IS NOT NULL""")
def bulge_arcs(spark, sf):
    seg = drawing.segments(p.vertices(spark, sf)).withColumn("k", F.when(F.col("owner") % 2 == 0, 0.5).otherwise(-1.0))
    arc = g.bulge_arc(*map(F.col, ("ax", "ay", "bx", "by", "k")))
    return seg.select("owner", "seq", *[(F.round(arc[c], 6) + 0.0).alias(c) for c in ("cx", "cy", "radius")])


@query("""SELECT c_custkey AS handle, round(CASE WHEN pm(180) THEN cx - r ELSE least(cx + r * cos(radians(a)), cx + r * cos(radians(b))) END, 6) AS x0,
        round(CASE WHEN pm(270) THEN cy - r ELSE least(cy + r * sin(radians(a)), cy + r * sin(radians(b))) END, 6) AS y0,
        round(CASE WHEN pm(0) THEN cx + r ELSE greatest(cx + r * cos(radians(a)), cx + r * cos(radians(b))) END, 6) AS x1,
        round(CASE WHEN pm(90) THEN cy + r ELSE greatest(cy + r * sin(radians(a)), cy + r * sin(radians(b))) END, 6) AS y1
    FROM (SELECT c_custkey, (c_custkey % 100)::DOUBLE AS cx, (c_custkey % 77)::DOUBLE AS cy, (1 + c_custkey % 9)::DOUBLE AS r, (c_custkey * 37 % 360) AS a, (c_custkey * 53 % 360 + 0.5) AS b FROM customer)""".replace("pm(180)", "(180 - a + 360) % 360 <= (b - a + 360) % 360").replace("pm(270)", "(270 - a + 360) % 360 <= (b - a + 360) % 360").replace("pm(0)", "(0 - a + 360) % 360 <= (b - a + 360) % 360").replace("pm(90)", "(90 - a + 360) % 360 <= (b - a + 360) % 360"))
def arc_bbox(spark, sf):
    k = F.col("c_custkey")
    arcs = table(spark, sf, "customer").select(k.alias("handle"), (k % 100).cast("double").alias("cx"), (k % 77).cast("double").alias("cy"), (1.0 + k % 9).alias("r"), (k * 37 % 360).cast("double").alias("a"), (k * 53 % 360 + 0.5).cast("double").alias("b"))
    return arcs.select("handle", *[F.round(v, 6).alias(c) for c, v in g.arc_box(*map(F.col, ("cx", "cy", "r", "a", "b"))).items()])


# --- spatial joins and selection ---


@query(f"""{with_('entities')} SELECT handle, x0 >= 200 AND x1 <= 400 AND y0 >= 200 AND y1 <= 500 AS "full" FROM entities WHERE x0 <= 400 AND x1 >= 200 AND y0 <= 500 AND y1 >= 200""")
def window_select_full_partial(spark, sf):
    return spatial.window_select(p.entities(spark, sf), 200, 200, 400, 500).select("handle", "full")


_NEAR = "greatest(a.x0 - b.x1, b.x0 - a.x1) <= {t} AND greatest(a.y0 - b.y1, b.y0 - a.y1) <= {t}"


@query(f"{with_('entities')} SELECT a.handle AS a, b.handle AS b FROM entities a JOIN entities b ON a.doc_id = b.doc_id AND a.handle < b.handle AND {_NEAR.format(t=5)}")
def band_self_join(spark, sf):
    return spatial.near_pairs(p.entities(spark, sf), ["doc_id"], "handle", 5.0).select(F.col("l_handle").alias("a"), F.col("r_handle").alias("b"))


@query(f"""{with_('entities')}, e AS (SELECT handle, doc_id, round_even(x0 / 4, 0) AS kx, round_even(y0 / 4, 0) AS ky FROM entities UNION SELECT handle, doc_id, round_even(x1 / 4, 0), round_even(y1 / 4, 0) FROM entities)
    SELECT doc_id, kx, ky, count(*) AS n, min(handle) AS least FROM e GROUP BY doc_id, kx, ky HAVING count(*) > 1""")
def endpoint_bucket_join(spark, sf):
    e = p.entities(spark, sf)
    key = lambda c: F.rint(F.col(c) / 4)
    ends = e.select("handle", "doc_id", key("x0").alias("kx"), key("y0").alias("ky")).union(e.select("handle", "doc_id", key("x1"), key("y1"))).distinct()
    return ends.groupBy("doc_id", "kx", "ky").agg(F.count(F.lit(1)).alias("n"), F.min("handle").alias("least")).where("n > 1")


@query(f"""{with_('entities')}, c AS (SELECT handle, doc_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (x1 - x0) / 2 AS r FROM entities WHERE type = 'CIRCLE')
    SELECT c.handle AS circle, e.handle AS "end" FROM c JOIN entities e ON e.doc_id = c.doc_id AND e.type = 'LINE' AND abs(sqrt((e.x0 - c.cx) * (e.x0 - c.cx) + (e.y0 - c.cy) * (e.y0 - c.cy)) - c.r) <= 2""")
def circle_tangent_join(spark, sf):
    e = p.entities(spark, sf)
    circles = e.where("type = 'CIRCLE'").withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "r": (F.col("x1") - F.col("x0")) / 2})
    around = circles.withColumns({"x0": F.col("cx") - F.col("r"), "y0": F.col("cy") - F.col("r"), "x1": F.col("cx") + F.col("r"), "y1": F.col("cy") + F.col("r")})
    ends = e.where("type = 'LINE'").withColumns({"x1": F.col("x0"), "y1": F.col("y0")})
    dx, dy = F.col("r_x0") - F.col("l_cx"), F.col("r_y0") - F.col("l_cy")
    touch = F.abs(F.sqrt(dx * dx + dy * dy) - F.col("l_r")) <= 2
    return spatial.band_join(around, ends, ["doc_id"], 32.0, 2.0, touch).select(F.col("l_handle").alias("circle"), F.col("r_handle").alias("end"))


@query(f"""{with_('entities', 'labels')}, m AS (SELECT doc_id, handle, x0, y0, x1, y1, least(40.0, greatest(10.0, least(x1 - x0, y1 - y0) * 0.6)) AS m FROM entities WHERE type = 'INSERT')
    SELECT m.handle, count(*) AS n, string_agg(l.value, '|' ORDER BY l.handle) AS text FROM m JOIN labels_ l ON l.doc_id = m.doc_id AND l.x >= x0 - m AND l.x <= x1 + m AND l.y >= y0 - m AND l.y <= y1 + m GROUP BY m.handle""")
def context_text_attach(spark, sf):
    met = grouping.attached_text(p.entities(spark, sf).where("type = 'INSERT'"), p.labels(spark, sf))
    texts = F.sort_array(F.collect_list(F.struct("r_handle", "r_value")))
    return met.groupBy(F.col("l_handle").alias("handle")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(texts, lambda t: t["r_value"]), "|").alias("text"))


@query(f"""{with_('entities', 'labels')}, c AS (SELECT doc_id, handle, x1 AS fx, x1 + 100 AS tx, y0, y1 FROM entities WHERE type = 'INSERT'),
    seen AS (SELECT c.doc_id, c.handle, l.handle AS label, c.fx, l.x, l.y FROM c JOIN labels_ l ON l.doc_id = c.doc_id AND l.x >= c.fx AND l.x <= c.tx AND l.y >= c.y0 AND l.y <= c.y1)
    SELECT doc_id, handle, label FROM seen s WHERE NOT EXISTS (SELECT 1 FROM entities b WHERE b.doc_id = s.doc_id AND b.handle <> s.handle AND b.x0 > s.fx AND b.x0 < s.x AND s.y BETWEEN b.y0 AND b.y1)""")
def corridor_label_veto(spark, sf):
    e = p.entities(spark, sf)
    return grouping.corridor_labels(e.where("type = 'INSERT'"), p.labels(spark, sf), e)


@query(f"""{with_('entities', 'labels')} SELECT e.doc_id, e.handle, arg_min(l.handle, row(l.x - e.x1, l.handle)) AS label FROM entities e JOIN labels_ l ON l.doc_id = e.doc_id AND l.x >= e.x1 AND l.x <= e.x1 + 100 AND l.y >= e.y0 AND l.y <= e.y1
    WHERE e.type = 'INSERT' GROUP BY e.doc_id, e.handle""")
def right_label_nearest(spark, sf):
    return grouping.right_label(p.entities(spark, sf).where("type = 'INSERT'"), p.labels(spark, sf))


@query(f"""{with_('entities')} SELECT handle, cx, cy FROM entities, unnest(range(floor(x0 / 8)::BIGINT, floor(x1 / 8)::BIGINT + 1)) AS a(cx), unnest(range(floor(y0 / 8)::BIGINT, floor(y1 / 8)::BIGINT + 1)) AS b(cy)""")
def grid_cells(spark, sf):
    return spatial.cells(p.entities(spark, sf), 8.0).select("handle", "cx", "cy")


# --- grouping ---

_PAIRS = f"pairs AS (SELECT a.handle AS a, b.handle AS b FROM entities a JOIN entities b ON a.doc_id = b.doc_id AND a.handle <> b.handle AND {_NEAR.format(t=5)})"
_REACH = "reach AS (SELECT handle AS a, handle AS b FROM entities UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a), comp AS (SELECT a AS handle, min(b) AS component FROM reach GROUP BY a)"


@query(f"{with_('entities')}, {_PAIRS}, {_REACH} SELECT handle, component FROM comp")
def bbox_components(spark, sf):
    return grouping.box_components(p.entities(spark, sf)).select("handle", "component")


def _clusters(spark, sf):
    named = grouping.box_components(p.entities(spark, sf))
    return named, drawing.union_boxes(named, ["doc_id", "component"])


_CLUSTERS = "clusters AS (SELECT e.doc_id, c.component, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM entities e JOIN comp c ON c.handle = e.handle GROUP BY e.doc_id, c.component)"


@query(f"""{with_('entities')}, {_PAIRS}, {_REACH}, {_CLUSTERS}, s AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS diagonal FROM clusters),
    m AS (SELECT doc_id, greatest(median(diagonal), 5.0) AS middle FROM s GROUP BY doc_id) SELECT s.doc_id, s.component, round(diagonal, 6) AS diagonal FROM s JOIN m ON m.doc_id = s.doc_id WHERE diagonal <= middle * 2.5""")
def outlier_median_filter(spark, sf):
    kept = grouping.without_outliers(_clusters(spark, sf)[1], factor=2.5)
    return kept.select("doc_id", "component", F.round("diagonal", 6).alias("diagonal"))


@query(f"""{with_('entities')}, l AS (SELECT doc_id, x1 - x0 AS length FROM entities WHERE type = 'LINE')
    SELECT doc_id, round(greatest(5.0, median(length) * 1.5, quantile_cont(length, 0.995)), 6) AS threshold FROM l GROUP BY doc_id""")
def quantile_length_filter(spark, sf):
    lines = p.entities(spark, sf).where("type = 'LINE'").select("doc_id", (F.col("x1") - F.col("x0")).alias("length"))
    return grouping.length_threshold(lines, 5.0, 1.5).select("doc_id", F.round("threshold", 6).alias("threshold"))


@query(f"""{with_('entities')}, {_PAIRS}, {_REACH}, n AS (SELECT c.component, e.layer, count(*) AS n, min(e.handle) AS first FROM entities e JOIN comp c ON c.handle = e.handle GROUP BY c.component, e.layer)
    SELECT component, arg_max(layer, row(n, -first)) AS layer, max(n) AS n FROM n GROUP BY component""")
def cluster_modal_layer(spark, sf):
    return grouping.modal(_clusters(spark, sf)[0], ["component"], "layer")


@query()
def iterative_merge(spark, sf):
    return grouping.merge_until_stable(p.entities(spark, sf), 5.0)


@query()
def iterative_merge_ratio(spark, sf):
    return grouping.merge_until_stable(p.entities(spark, sf), 5.0, ratio=2.0)


@query()
def refine_and_merge(spark, sf):
    return grouping.refine_and_merge(p.entities(spark, sf), 3.0, 0.25)


@query(f"""{with_('entities')}, seed AS (SELECT handle FROM entities WHERE x0 < 20 OR y0 < 20), {_PAIRS}, fl AS (SELECT handle FROM seed UNION SELECT p.b FROM fl JOIN pairs p ON fl.handle = p.a) SELECT handle AS node FROM fl""")
def frame_flood_fill(spark, sf):
    return grouping.flood_boxes(p.entities(spark, sf), F.expr("x0 < 20 OR y0 < 20"), 5.0).select(F.col("handle").alias("node"))


_ENDS = "ends AS (SELECT handle, doc_id, round_even(x0 / 6, 0) AS kx, round_even(y0 / 6, 0) AS ky FROM entities UNION SELECT handle, doc_id, round_even(x1 / 6, 0), round_even(y1 / 6, 0) FROM entities)"


@query(f"""{with_('entities')}, {_ENDS}, pairs AS (SELECT DISTINCT a.handle AS a, b.handle AS b FROM ends a JOIN ends b ON a.doc_id = b.doc_id AND a.kx = b.kx AND a.ky = b.ky), {_REACH} SELECT handle AS node, component FROM comp""")
def endpoint_components(spark, sf):
    e = p.entities(spark, sf)
    ends = e.select("handle", "doc_id", F.col("x0").alias("x"), F.col("y0").alias("y")).union(e.select("handle", "doc_id", "x1", "y1"))
    return grouping.endpoint_components(ends, 6.0)


_FEATURES = """SELECT doc_id, layer, upper(layer) AS block_name, {count}(type = 'LWPOLYLINE') > 2 AS has_rect, {count}(type = 'LWPOLYLINE') AS n_rects, {count}(type = 'CIRCLE') AS n_circles, {count}(type = 'LINE') AS n_lines,
    {count}(type = 'CIRCLE') = 1 AND {count}(type = 'LINE') >= 3 AS fan_like, {count}(type = 'ARC') >= 3 AS fan_in_rect, {count}(type = 'HATCH') > 4 AS joined, {count}(type = 'TEXT') > 5 AS m_shape, {count}(type = 'TEXT') = 4 AS w_shape,
    min(CASE WHEN type = 'TEXT' THEN upper(trim(linetype)) END) AS text, {count}(type = 'INSERT') AS diamonds, (max(x1) - min(x0)) / (max(y1) - min(y0)) AS ratio, {count}(type = 'ARC') AS arrows, {count}(type = 'HATCH') AS baffles,
    CASE count(*) % 5 WHEN 0 THEN 'CircleM' WHEN 1 THEN 'TShape' WHEN 2 THEN 'LShape' WHEN 3 THEN 'Zigzag' END AS top_feature, CASE count(*) % 3 WHEN 0 THEN 'Inward' WHEN 1 THEN 'Outward' END AS arrow_way, count(*) % 2 = 0 AS diagonal FROM entities GROUP BY doc_id, layer"""


@query(f"{with_('entities')}, features AS ({_FEATURES.format(count='count_if')}) SELECT doc_id, layer, {classify.as_sql()} AS kind FROM features")
def rule_classifier(spark, sf):
    features = spark.sql(_FEATURES.format(count="count_if").replace("FROM entities", "FROM {entities}"), entities=p.entities(spark, sf))
    return classify.classified(features).select("doc_id", "layer", "kind")


# --- fingerprints and matching ---

_CENTRED = """centre AS (SELECT shape, sum(x)::DOUBLE / count(*) AS mx, sum(y)::DOUBLE / count(*) AS my FROM points GROUP BY shape),
    rel AS (SELECT p.shape, p.i, p.x - c.mx AS x, p.y - c.my AS y FROM points p JOIN centre c ON c.shape = p.shape),
    size AS (SELECT shape, CASE WHEN max(x * x + y * y) > 0 THEN sqrt(max(x * x + y * y)) ELSE 1.0 END AS radius FROM rel GROUP BY shape),
    rad AS (SELECT r.shape, least(floor(sqrt(r.x * r.x + r.y * r.y) / s.radius * 16), 15)::INT AS bin, count(*) AS n FROM rel r JOIN size s ON s.shape = r.shape GROUP BY 1, 2),
    pw AS (SELECT a.shape, least(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / s.radius * 24), 47)::INT AS bin, count(*) AS n FROM rel a JOIN rel b ON a.shape = b.shape AND a.i < b.i JOIN size s ON s.shape = a.shape GROUP BY 1, 2)"""
_HASHES = """vec AS (SELECT s.shape, k, coalesce(CASE WHEN k < 16 THEN r.n ELSE w.n END, 0) AS n FROM size s CROSS JOIN unnest(range(0, 64)) AS u(k) LEFT JOIN rad r ON r.shape = s.shape AND r.bin = k AND k < 16 LEFT JOIN pw w ON w.shape = s.shape AND w.bin = k - 16 AND k >= 16),
    mid AS (SELECT shape, list_sort(list(n))[33] AS m FROM vec GROUP BY shape),
    hashes AS (SELECT v.shape, sum(CASE WHEN k < 32 AND n > m THEN (1::BIGINT << (31 - k)::INT) ELSE 0 END)::BIGINT AS high, sum(CASE WHEN k >= 32 AND n > m THEN (1::BIGINT << (63 - k)::INT) ELSE 0 END)::BIGINT AS low FROM vec v JOIN mid ON mid.shape = v.shape GROUP BY v.shape)"""
_HAMMING = "(bit_count(xor(c.high, r.high)) + bit_count(xor(c.low, r.low)))::INT"


@query(f"{with_('points')}, {_CENTRED} SELECT shape, bin, n FROM rad")
def radial_histogram(spark, sf):
    return matching.radial_counts(p.points(spark, sf))


@query(f"{with_('points')}, {_CENTRED} SELECT shape, bin, n FROM pw")
def pairwise_histogram(spark, sf):
    return matching.pairwise_counts(p.points(spark, sf))


def _hashes(spark, sf):
    return matching.phash(p.points(spark, sf))


@query(f"{with_('points')}, {_CENTRED}, {_HASHES} SELECT shape, high, low FROM hashes")
def phash(spark, sf):
    return _hashes(spark, sf)


@query(f"{with_('points')}, {_CENTRED}, {_HASHES} SELECT c.shape, arg_min(r.shape, row({_HAMMING}, r.shape)) AS ref, min({_HAMMING}) AS distance FROM hashes c, hashes r WHERE r.shape < 10 GROUP BY c.shape")
def hamming_best_match(spark, sf):
    h = _hashes(spark, sf)
    return matching.best_match(h, h.where("shape < 10"))


@query(f"""{with_('points')}, {_CENTRED}, {_HASHES}, met AS (SELECT c.shape, r.shape AS ref, {_HAMMING} AS distance FROM hashes c, hashes r WHERE r.shape < 10),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY distance, ref)::INT AS rank, count(*) FILTER (distance <= 12) OVER (PARTITION BY shape) AS hits FROM met)
    SELECT shape, ref, distance, rank FROM ranked WHERE CASE WHEN hits > 0 THEN distance <= 12 ELSE rank <= 3 END""")
def conditional_topk(spark, sf):
    h = _hashes(spark, sf)
    return matching.conditional_top(h, h.where("shape < 10"))


_LENGTHS = """seg AS (SELECT shape, round_even(sqrt((((lead(x) OVER w) - x) * ((lead(x) OVER w) - x) + ((lead(y) OVER w) - y) * ((lead(y) OVER w) - y))::DOUBLE) / 50, 0)::BIGINT AS d FROM points WINDOW w AS (PARTITION BY shape ORDER BY i)),
    ord AS (SELECT shape, d, row_number() OVER (PARTITION BY shape ORDER BY d) AS k FROM seg WHERE d IS NOT NULL)"""


@query(f"""{with_('points')}, {_LENGTHS}, dist AS (SELECT c.shape, r.shape AS ref, sum(abs(c.d - r.d))::DOUBLE / count(*) AS d FROM ord c JOIN ord r ON r.k = c.k AND r.shape < 10 GROUP BY c.shape, r.shape)
    SELECT shape, arg_min(ref, row(d, ref)) AS ref, round(min(d), 6) AS distance FROM dist GROUP BY shape""")
def descriptor_distance(spark, sf):
    shapes = p.points(spark, sf).select("shape", "pts")
    return matching.best_descriptor(shapes, shapes.where("shape < 10"))


@query(f"""{with_('points')}, box AS (SELECT shape, (min(x) + max(x)) / 2.0::DOUBLE AS mx, (min(y) + max(y)) / 2.0::DOUBLE AS my, greatest(max(x) - min(x), max(y) - min(y))::DOUBLE AS side FROM points GROUP BY shape),
    nrm AS (SELECT p.shape, p.i, (p.x - b.mx) / b.side AS x, (p.y - b.my) / b.side AS y FROM points p JOIN box b ON b.shape = p.shape),
    rot AS (SELECT shape, i, angle, CASE angle WHEN 0 THEN x WHEN 90 THEN -y WHEN 180 THEN -x ELSE y END AS x, CASE angle WHEN 0 THEN y WHEN 90 THEN x WHEN 180 THEN -y ELSE -x END AS y FROM nrm, (VALUES (0), (90), (180), (270)) AS t(angle)),
    d AS (SELECT c.shape, r.shape AS ref, c.angle, c.i AS ci, r.i AS ri, sqrt((c.x - r.x) * (c.x - r.x) + (c.y - r.y) * (c.y - r.y)) AS d FROM rot c JOIN nrm r ON r.shape < 5),
    a AS (SELECT shape, ref, angle, avg(m) AS s FROM (SELECT shape, ref, angle, ci, min(d) AS m FROM d GROUP BY ALL) GROUP BY ALL), b AS (SELECT shape, ref, angle, avg(m) AS s FROM (SELECT shape, ref, angle, ri, min(d) AS m FROM d GROUP BY ALL) GROUP BY ALL),
    s AS (SELECT a.shape, a.ref, a.angle, round(0.5 * (a.s + b.s), 6) AS score FROM a JOIN b USING (shape, ref, angle))
    SELECT shape, arg_min(ref, row(score, ref, angle)) AS ref, arg_min(angle, row(score, ref, angle))::INT AS angle, min(score) AS score FROM s GROUP BY shape""")
def chamfer_best_rotation(spark, sf):
    shapes = p.points(spark, sf).select("shape", "pts")
    return matching.best_rotation(shapes, shapes.where("shape < 5"))


@query("""WITH r AS (SELECT DISTINCT * FROM (SELECT label AS geom_id, 'd' || vec_id % 7 AS "desc", 'v' || vec_id AS example, vec_id AS stamp FROM embeddings UNION ALL SELECT label, 'd' || vec_id % 5, 'v' || vec_id, vec_id + 1 FROM embeddings WHERE vec_id % 2 = 0)),
    k AS (SELECT *, row_number() OVER (PARTITION BY geom_id ORDER BY stamp DESC, example DESC) AS rank FROM r)
    SELECT geom_id, array_to_string(list_sort(list(DISTINCT "desc")), ',') AS descs, count(*) FILTER (rank <= 20) AS n_examples, max(stamp) AS newest FROM k GROUP BY geom_id""")
def geom_library_upsert(spark, sf):
    e = table(spark, sf, "embeddings")
    of = lambda d, k, shift: d.select(F.col("label").alias("geom_id"), F.concat(F.lit("d"), (F.col("vec_id") % k).cast("string")).alias("desc"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("example"), (F.col("vec_id") + shift).alias("at"))
    return matching.merge_library(of(e, 7, 0), of(e.where("vec_id % 2 = 0"), 5, 1)).withColumn("descs", F.array_join("descs", ","))


# --- scalars ---


@query("SELECT o_orderkey AS k, datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 2440588 AS jd, (datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 2440588)::DOUBLE + (o_orderkey % 86400 * 1000)::DOUBLE / 86400000 AS jdate FROM orders")
def julian_from_date(spark, sf):
    o = table(spark, sf, "orders").withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("date").cast("timestamp")) + F.col("o_orderkey") % 86400))
    return o.select(F.col("o_orderkey").alias("k"), s.julian_day(F.col("ts")).alias("jd"), s.julian_date(F.col("ts")).alias("jdate"))


@query("SELECT c_custkey AS k, strftime(to_timestamp((c_custkey * 37 % 3000000 - 500000) * 86400 + c_custkey % 86400)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS ts FROM customer")
def date_from_julian(spark, sf):
    k = F.col("c_custkey")
    value = (k * 37 % 3000000 - 500000 + 2440588) + (k % 86400) / 86400.0
    return table(spark, sf, "customer").select(k.alias("k"), F.date_format(s.date_of_julian(value), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("""WITH t AS (SELECT c_custkey AS k, c_custkey * 40503 % 1296000 AS t FROM customer) SELECT k, (t // 3600) || '°' || CASE WHEN t % 3600 > 0 THEN (t // 60 % 60) || '''' ELSE '' END || CASE WHEN t % 60 > 0 THEN (t % 60) || '"' ELSE '' END AS dms FROM t""")
def dms_format(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("k"), s.dms((k * 40503 % 1296000) / 3600.0).alias("dms"))


@query("""WITH t AS (SELECT c_custkey AS k, c_custkey % 97 AS n FROM customer) SELECT k, CASE WHEN n % 16 = 0 THEN (n // 16)::VARCHAR WHEN n < 16 THEN (n // gcd(n, 16)) || '/' || (16 // gcd(n, 16)) ELSE (n // 16) || ' ' || (n % 16 // gcd(n, 16)) || '/' || (16 // gcd(n, 16)) END AS fraction FROM t""")
def fraction_format(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("k"), s.fraction((k % 97) / 16.0, 4).alias("fraction"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, round_even(l_quantity / 4, 0) * 4 AS to_four, round_even(l_extendedprice / 0.25, 0) * 0.25 AS to_quarter FROM lineitem")
def rounding_half_even(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), s.rounded_to(F.col("l_quantity"), 4).alias("to_four"), s.rounded_to(F.col("l_extendedprice"), 0.25).alias("to_quarter"))


@query("SELECT c_custkey AS k, (c_custkey * 71 % 256 * 65536 + c_custkey * 31 % 256 * 256 + c_custkey % 256)::INT AS packed, (c_custkey * 31 % 256)::INT AS green FROM customer")
def true_color_pack(spark, sf):
    k = F.col("c_custkey")
    packed = s.true_colour(k * 71 % 256, k * 31 % 256, k % 256)
    return table(spark, sf, "customer").select(k.alias("k"), packed.alias("packed"), s.channels(packed)[1].alias("green"))


@query("""WITH t AS (SELECT c_custkey AS k, (CASE c_custkey % 93 WHEN 91 THEN -1 WHEN 92 THEN 100 ELSE c_custkey % 93 END)::INT AS v FROM customer)
    SELECT k, (CASE v WHEN -1 THEN 0 WHEN 100 THEN 16777216 ELSE 33554432 + floor((100 - v) / 100.0::DOUBLE * 255) END)::INT AS alpha, (CASE v WHEN -1 THEN -1 WHEN 100 THEN 100 ELSE 100 - round_even(floor((100 - v) / 100.0::DOUBLE * 255) * 100 / 255.0::DOUBLE, 0) END)::INT AS back FROM t""")
def transparency_alpha(spark, sf):
    k = F.col("c_custkey")
    v = F.when(k % 93 == 91, -1).when(k % 93 == 92, 100).otherwise(k % 93).cast("int")
    alpha = s.alpha_of_transparency(v)
    return table(spark, sf, "customer").select(k.alias("k"), alpha.cast("int").alias("alpha"), s.transparency_of_alpha(alpha.cast("int")).alias("back"))


@query(r"""SELECT page_id AS k, substr(CASE WHEN n = '' THEN 'SYM' ELSE n END, 1, 80) AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[\s<>/\\":;?*|=`,、]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS n FROM pages)""")
def sanitize_name(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("k"), s.sanitised(F.col("url")).alias("name"))


@query(r"""SELECT doc_id, len(string_split_regex(text, '\r\n|\r|\n|\\P'))::INT AS n_lines, list_max(list_transform(string_split_regex(text, '\r\n|\r|\n|\\P'), lambda x: length(x)))::INT AS longest FROM documents""")
def mtext_plain_lines(spark, sf):
    lines = s.plain_lines(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(lines).alias("n_lines"), F.array_max(F.transform(lines, F.length)).alias("longest"))


@query(r"""SELECT c_custkey AS k, 'Tag ' || c_name || ' on' || chr(10) || c_mktsegment AS text FROM customer""")
def mtext_parse(spark, sf):
    marked = F.concat(F.lit("{\\C3;Tag }\\fArial|b0;"), F.col("c_name"), F.lit(" \\H2x;on\\P{\\c255;"), F.col("c_mktsegment"), F.lit("}"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), s.plain_text(marked).alias("text"))


@query("""SELECT page_id AS k, CASE WHEN len(l) = 1 THEN l[1] END AS letter FROM (SELECT page_id, list_distinct(list_filter(string_split(upper('12-' || chr((97 + page_id % 5)::INT) || CASE WHEN page_id % 3 = 0 THEN 'Q' ELSE '' END), ''), lambda c: regexp_full_match(c, '[A-Z]'))) AS l FROM pages)""")
def unique_letter_signature(spark, sf):
    text = F.concat(F.lit("12-"), F.char(97 + F.col("page_id") % 5), F.when(F.col("page_id") % 3 == 0, "Q").otherwise(""))
    return table(spark, sf, "pages").select(F.col("page_id").alias("k"), s.letter_signature(text).alias("letter"))


@query(f"""{with_('notifications')}, m AS (SELECT type, regexp_replace(message, '\\d+', '#', 'g') AS pattern, message, seq FROM notifications)
    SELECT type, pattern, count(*) AS n, arg_min(message, seq) AS sample FROM m GROUP BY type, pattern ORDER BY n DESC, type, pattern LIMIT 10""")
def notification_patterns(spark, sf):
    n = p.notifications(spark, sf).withColumn("pattern", s.masked(F.col("message")))
    return n.groupBy("type", "pattern").agg(F.count(F.lit(1)).alias("n"), F.min_by("message", "seq").alias("sample")).orderBy(F.desc("n"), "type", "pattern").limit(10)


@query(f"""{with_('entities')} SELECT handle, i, round(x0 + (x1 - x0) * i / 8.0::DOUBLE, 6) AS x, round(y0 + 0.5 * sin(i * 1.5::DOUBLE), 6) AS y FROM entities, unnest(range(0, 9)) AS r(i) WHERE type = 'INSERT'""")
def wave_border_points(spark, sf):
    e = p.entities(spark, sf).where("type = 'INSERT'").select("handle", *g.BOX, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("i"))
    return e.select("handle", "i", F.round(F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("i") / 8.0, 6).alias("x"), F.round(F.col("y0") + 0.5 * F.sin(F.col("i") * 1.5), 6).alias("y"))


@query("""SELECT p_partkey AS k, CASE row_number() OVER w WHEN 1 THEN p_brand ELSE p_brand || '_' || row_number() OVER w END AS name FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey)""")
def duplicate_name_suffix(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("name"), "p_size")
    return grouping.numbered_names(rows, "name", [F.desc("p_size"), F.col("k")]).select("k", "name")


@query(f"""{with_('entities')} SELECT doc_id, type, count(*) AS n FROM entities WHERE type NOT IN ('TEXT', 'HATCH') AND NOT (type IN ('CIRCLE', 'ARC') AND x1 - x0 < 3) AND NOT (x1 - x0 < 1 AND y1 - y0 < 1) GROUP BY doc_id, type""")
def noise_filters(spark, sf):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    e = p.entities(spark, sf).where(~F.col("type").isin("TEXT", "HATCH")).where(~(F.col("type").isin("CIRCLE", "ARC") & (w < 3))).where(~((w < 1) & (h < 1)))
    return e.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{with_('entities')}, x AS (SELECT doc_id, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h FROM entities GROUP BY doc_id)
    SELECT handle FROM entities e JOIN x ON x.doc_id = e.doc_id WHERE e.x1 - e.x0 <= least(0.01 * x.w, 2000) AND e.y1 - e.y0 <= least(0.01 * x.h, 2000)""")
def grid_line_filter(spark, sf):
    e = p.entities(spark, sf)
    extent = e.groupBy("doc_id").agg((F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h"))
    return e.join(extent, "doc_id").where((F.col("x1") - F.col("x0") <= F.least(0.01 * F.col("w"), F.lit(2000))) & (F.col("y1") - F.col("y0") <= F.least(0.01 * F.col("h"), F.lit(2000)))).select("handle")


@query("SELECT c_custkey AS k, printf('%.2f', round_even(c_acctbal::DECIMAL(28,10), 2)::DOUBLE) AS fixed FROM customer")
def decimal_format(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), s.decimal_text(F.col("c_acctbal"), 2).alias("fixed"))


# --- sources, sinks and streams ---


@query(f"""{with_('entities')} SELECT handle, layer, round(x0, 6) AS x, round(y0, 6) AS y, round(x1, 6) AS x2, round(y1, 6) AS y2 FROM entities WHERE type = 'LINE'""")
def dxf_round_trip(spark, sf):
    lines = p.entities(spark, sf).where("type = 'LINE'").select(F.col("doc_id").cast("string").alias("file"), "handle", "layer", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    read = dxf.entities(dxf.pairs(dxf.as_dxf(lines)))
    return read.select("handle", "layer", *[F.round(c, 6).alias(c) for c in ("x", "y", "x2", "y2")])


@query(f"""{with_('entities')} SELECT doc_id, handle, '{{"type":"' || type || '","handle":' || handle || ',"layer":"' || layer || '"' AS head FROM entities""")
def json_export(spark, sf):
    return patterns.as_json(p.entities(spark, sf)).select("doc_id", "handle", F.substring_index("json", ',"geometry"', 1).alias("head"))


@query(f"""{with_('entities')} SELECT doc_id, handle, CASE type WHEN 'LINE' THEN printf('<line x1="%.3f" y1="%.3f" x2="%.3f" y2="%.3f"/>', x0, y0, x1, y1)
    WHEN 'CIRCLE' THEN printf('<circle cx="%.3f" cy="%.3f" r="%.3f"/>', (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2)
    ELSE printf('<rect x="%.3f" y="%.3f" width="%.3f" height="%.3f"/>', x0, y0, x1 - x0, y1 - y0) END AS svg FROM entities WHERE type <> 'CIRCLE'""")
def svg_export(spark, sf):
    return patterns.as_svg(p.entities(spark, sf).where("type <> 'CIRCLE'"))


@query()
def json_export_whole(spark, sf):
    return patterns.as_json(p.entities(spark, sf))


@query()
def svg_export_whole(spark, sf):
    return patterns.as_svg(p.entities(spark, sf))


@query("""SELECT 'P' || p_partkey AS name, 'pattern ' || p_brand AS description, 1 AS line, (p_partkey % 180)::DOUBLE AS angle, (p_size)::DOUBLE AS "offset", 2 AS n_dashes FROM part""")
def hatch_pattern_scan(spark, sf):
    part = table(spark, sf, "part")
    rows = part.select(F.col("p_partkey").cast("string").alias("file"), F.posexplode(F.array(F.concat(F.lit("*P"), F.col("p_partkey").cast("string"), F.lit(", pattern "), F.col("p_brand")), F.lit("; comment"), F.concat((F.col("p_partkey") % 180).cast("string"), F.lit(", 0,0 , 0,"), F.col("p_size").cast("string"), F.lit(", 1.5,-.5")))).alias("pos", "value"))
    return patterns.hatch_patterns(rows).select("name", "description", "line", "angle", "offset", F.size("dashes").alias("n_dashes"))


@query(f"""{with_('notifications')} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, type, regexp_replace(message, '\\d+', '#', 'g') AS pattern, count(*) AS n FROM notifications GROUP BY 1, 2, 3""")
def notification_windows(spark, sf):
    return windowed_patterns(p.notifications(spark, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


# --- curves, codecs, references ---


@query(f"""{with_('vertices')}, c AS (SELECT owner, max(CASE seq WHEN 1 THEN x END) AS ax, max(CASE seq WHEN 2 THEN x END) AS bx, max(CASE seq WHEN 3 THEN x END) AS cx, max(CASE seq WHEN 4 THEN x END) AS dx,
    max(CASE seq WHEN 1 THEN y END) AS ay, max(CASE seq WHEN 2 THEN y END) AS b, max(CASE seq WHEN 3 THEN y END) AS cy, max(CASE seq WHEN 4 THEN y END) AS dy FROM vertices WHERE seq <= 4 GROUP BY owner HAVING count(*) = 4)
    SELECT owner, k, round((1 - t) * (1 - t) * (1 - t) * ax + 3 * t * (1 - t) * (1 - t) * bx + 3 * t * t * (1 - t) * cx + t * t * t * dx + 1e-8, 6) AS x,
        round((1 - t) * (1 - t) * (1 - t) * ay + 3 * t * (1 - t) * (1 - t) * b + 3 * t * t * (1 - t) * cy + t * t * t * dy + 1e-8, 6) AS y FROM (SELECT *, k / 4.0::DOUBLE AS t FROM c, unnest(range(0, 5)) AS r(k))""")
def spline_eval(spark, sf):
    v = p.vertices(spark, sf).where("seq <= 4")
    four = v.groupBy("owner").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("pts")).where("size(pts) = 4")
    out = four.select("owner", F.posexplode(curves.spline_points("pts", 4)).alias("k", "q"))
    return out.select("owner", F.col("k").cast("long").alias("k"), F.round(F.col("q.x") + 1e-8, 6).alias("x"), F.round(F.col("q.y") + 1e-8, 6).alias("y"))  # no ties


@query()
def spline_eval_whole(spark, sf):
    at = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    whole = p.vertices(spark, sf).groupBy("owner").agg(at.alias("pts"))
    return whole.select("owner", F.posexplode(curves.spline_points("pts", 4)).alias("k", "q")).select("owner", F.col("k").cast("long").alias("k"), "q.x", "q.y")


@query("""SELECT vec_id AS shape, 32 AS n, sum(round_even(greatest(-1, least(1, embedding[2 * i + 1]::DOUBLE)) * 32767, 0))::BIGINT AS sx, sum(round_even(greatest(-1, least(1, embedding[2 * i + 2]::DOUBLE)) * 32767, 0))::BIGINT AS sy
    FROM embeddings, unnest(range(0, 32)) AS r(i) GROUP BY vec_id""")
def point_cloud_codec(spark, sf):
    e = F.transform("embedding", lambda v: v.cast("double"))
    pts = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.struct(F.element_at(e, 2 * i - 1).alias("x"), F.element_at(e, 2 * i).alias("y")))
    text = table(spark, sf, "embeddings").select(F.col("vec_id").alias("shape"), curves.packed(pts).alias("text"))
    return text.select("shape", curves.unpacked_sums("text").alias("s")).select("shape", F.col("s.n").cast("int").alias("n"), "s.sx", "s.sy")


@query("""WITH t AS (SELECT c_custkey AS k, c_custkey * 71 % 256 + c_custkey * 31 % 256 + c_custkey % 256 AS s FROM customer), c(i, v) AS (VALUES (0, 0), (1, 255), (2, 510), (3, 255), (4, 510), (5, 255), (6, 510), (7, 765))
    SELECT k, coalesce(min(i) FILTER (s = v OR s - v < -1), 0)::INT AS colour FROM t, c GROUP BY k""")
def approx_color_index(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("k"), s.approximate_index(k * 71 % 256, k * 31 % 256, k % 256).alias("colour"))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS q, round(CASE WHEN l_linenumber % 2 = 0 THEN abs(l_quantity * cos(radians(l_partkey % 90)) + l_linenumber * sin(radians(l_partkey % 90)))
    ELSE sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber) END, 6) AS length FROM lineitem""")
def dimension_measurement(spark, sf):
    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "linear").otherwise("aligned")
    length = s.measured(kind, F.col("l_quantity"), F.col("l_linenumber").cast("double"), (F.col("l_partkey") % 90).cast("double"))
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("q"), F.round(length, 6).alias("length"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_custkey % 40 < 25 THEN (SELECT n_name FROM nation WHERE n_nationkey = o_custkey % 40) ELSE (SELECT n_name FROM nation WHERE lower(n_name) = lower(c_mktsegment) OR n_nationkey = (CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 25 END)) END AS target,
    CASE WHEN o_custkey % 40 < 25 THEN 'handle' WHEN o_orderkey % 3 = 0 THEN 'name' ELSE 'missing' END AS found_by FROM orders JOIN customer ON c_custkey = o_custkey""")
def reference_fallback(spark, sf):
    n = table(spark, sf, "nation")
    names = n.select(F.col("n_nationkey").alias("nk"), F.upper("n_name").alias("ref_name"))
    o = table(spark, sf, "orders").withColumn("nk", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 25)).join(F.broadcast(names), "nk", "left")  # nation: 25 rows at any scale
    refs = o.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 40).cast("int").alias("ref_handle"), "ref_name")
    named = n.select(F.col("n_nationkey").alias("handle"), F.col("n_name").alias("name"))
    return drawing.resolved(refs, named, named).select("k", "target", "found_by")


@query("""WITH RECURSIVE l AS (SELECT o_orderkey AS handle, CASE WHEN o_orderkey % 10 <> 9 THEN o_orderkey + 1 END AS next FROM orders),
    w AS (SELECT handle AS head, handle, 0::BIGINT AS step FROM l WHERE handle NOT IN (SELECT next FROM l WHERE next IS NOT NULL) UNION ALL SELECT w.head, l.next, w.step + 1 FROM w JOIN l ON l.handle = w.handle WHERE l.next IS NOT NULL) SELECT head, handle, step FROM w""")
def linked_chains(spark, sf):
    k = F.col("o_orderkey")
    return drawing.chains(table(spark, sf, "orders").select(k.alias("handle"), F.when(k % 10 != 9, k + 1).alias("next")))


@query()
def label_assignment(spark, sf):
    return curves.assign_labels(p.labels(spark, sf), p.entities(spark, sf).where("type = 'INSERT'"), 60.0)


@query(f"SELECT p_partkey AS k, (CASE (p_partkey % 24)::INT " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(s.LINE_WEIGHTS)) + " END)::INT AS weight, (p_partkey % 24)::INT AS idx FROM part")
def line_weight_lookup(spark, sf):
    w = F.element_at(F.array(*map(F.lit, s.LINE_WEIGHTS)), (F.col("p_partkey") % 24 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), w.alias("weight")).withColumn("idx", s.line_weight_index(F.col("weight")))


@query("SELECT s_suppkey AS k, s_acctbal * 96 AS inches, CASE s_suppkey % 3 WHEN 0 THEN s_acctbal * 96 WHEN 1 THEN s_acctbal * 96 / 25.4::DOUBLE END AS pixels, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal / (s_suppkey % 4) END AS scale FROM supplier")
def pixel_and_scale(spark, sf):
    k, v = F.col("s_suppkey"), F.col("s_acctbal")
    unit = F.when(k % 3 == 0, "in").when(k % 3 == 1, "mm").otherwise("pt")
    return table(spark, sf, "supplier").select(k.alias("k"), s.pixel_size(v, F.lit("in")).alias("inches"), s.pixel_size(v, unit).alias("pixels"), s.unit_scale(v, k % 4).alias("scale"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS q, round_even(l_quantity / 7 * 86400000, 0)::BIGINT AS ms FROM lineitem")
def elapsed_time(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("q"), s.elapsed(F.col("l_quantity") / 7).alias("ms"))


@query("SELECT doc_id, round(2.5::DOUBLE * 0.8::DOUBLE * list_max(list_transform(string_split_regex(text, '\\r\\n|\\r|\\n|\\\\P'), lambda x: length(x))), 6) AS width FROM documents")
def text_box_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(s.text_width(F.col("text"), F.lit(2.5)), 6).alias("width"))


@query("SELECT doc_id, substr(text, 1, 40) AS fixed FROM documents")
def mojibake_repair(spark, sf):
    return mojibake_repair_whole(spark, sf).select("doc_id", F.substring("fixed", 1, 40).alias("fixed"))  # what the SQL gives


@query()
def mojibake_repair_whole(spark, sf):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, sf, "documents").select("doc_id", s.repaired(broken).alias("fixed"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN p_size::VARCHAR END AS dimscale FROM part")
def style_overrides(spark, sf):
    k = F.col("p_partkey")
    whole = F.array(F.lit("{"), F.lit("40"), F.col("p_size").cast("string"), F.lit("41"), k.cast("string"), F.lit("}"))
    odd = F.array(F.lit("{"), F.lit("40"), F.col("p_size").cast("string"), F.lit("41"), F.lit("}"))
    return table(spark, sf, "part").select(k.alias("k"), F.try_element_at(s.overrides(F.when(k % 3 != 0, whole).otherwise(odd)), F.lit("40")).alias("dimscale"))


@query(f"""{with_('vertices')}, s AS (SELECT owner, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS b FROM vertices WINDOW w AS (PARTITION BY owner ORDER BY seq)),
    t AS (SELECT owner, round(sum(sqrt((bx - x) * (bx - x) + (b - y) * (b - y))), 6) AS length FROM s WHERE bx IS NOT NULL GROUP BY owner),
    d AS (SELECT owner, length, 2 * n + i AS k, n * 100.0::DOUBLE + i * 70.0::DOUBLE AS a, n * 100.0::DOUBLE + CASE i WHEN 0 THEN 50.0 ELSE 80.0 END::DOUBLE AS z FROM t, unnest(range(0, floor(length / 100)::BIGINT + 1)) AS r(n), unnest(range(0, 2)) AS q(i) WHERE length > 0)
    SELECT owner, k, a AS start, least(z, length) AS stop FROM d WHERE a < length""")
def linetype_dashes(spark, sf):
    return drawing.dashes(p.vertices(spark, sf), (50.0, -20.0, 10.0, -20.0))


@query(f"""{with_('entities')} SELECT handle, count(*) AS n, round(sum(x), 6) AS sx, round(sum(y), 6) AS sy FROM (
    SELECT handle, unnest(CASE WHEN type IN ('LINE', 'ARC') THEN [x0, x1] WHEN type = 'CIRCLE' THEN [x0, x1, (x0 + x1) / 2, (x0 + x1) / 2] ELSE [x0, x1, x0, x1] END) AS x,
        unnest(CASE WHEN type IN ('LINE', 'ARC') THEN [y0, y1] WHEN type = 'CIRCLE' THEN [(y0 + y1) / 2, (y0 + y1) / 2, y0, y1] ELSE [y0, y0, y1, y1] END) AS y FROM entities) GROUP BY handle""")
def connection_points(spark, sf):
    pts = drawing.key_points(p.entities(spark, sf))
    return pts.groupBy("handle").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 6).alias("sx"), F.round(F.sum("y"), 6).alias("sy"))


@query(f"""{with_('entities')}, v AS (SELECT s_suppkey AS viewport, s_suppkey % 16 AS doc_id, (s_suppkey * 97 % 900)::DOUBLE AS x0, (s_suppkey * 53 % 900)::DOUBLE AS y0, (s_suppkey * 97 % 900 + 90)::DOUBLE AS x1, (s_suppkey * 53 % 900 + 60)::DOUBLE AS y1 FROM supplier)
    SELECT v.viewport, e.handle, e.x0 >= v.x0 AND e.y0 >= v.y0 AND e.x1 <= v.x1 AND e.y1 <= v.y1 AS "full" FROM v JOIN entities e ON e.doc_id = v.doc_id AND e.x0 <= v.x1 AND e.x1 >= v.x0 AND e.y0 <= v.y1 AND e.y1 >= v.y0""")
def viewport_selection(spark, sf):
    k = F.col("s_suppkey")
    x, y = (k * 97 % 900).cast("double"), (k * 53 % 900).cast("double")
    v = table(spark, sf, "supplier").select(k.alias("viewport"), (k % 16).alias("doc_id"), x.alias("x0"), y.alias("y0"), (x + 90).alias("x1"), (y + 60).alias("y1"))
    return drawing.viewport_select(v, p.entities(spark, sf))
