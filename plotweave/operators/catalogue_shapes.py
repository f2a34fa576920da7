"""Queries of block maps, loops of lines, snapping and arrows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.operators import blocks, loops, snapping
from plotweave.operators.catalogue import query
from plotweave.plans import projection as p
from plotweave.plans.projection import with_
from plotweave.plans.tables import table

# --- blocks: each part refers to one of a third of its number, some to their neighbour and back, with turns and mirrors ---


def _references(spark, sf):
    k = F.col("p_partkey")
    part = table(spark, sf, "part")
    most = part.agg(F.max("p_partkey")).first()[0]
    ends = part.select(k, F.filter(F.array(F.when(k >= 3, F.floor(k / 3)), F.when((k % 10 == 0) & (k < F.lit(most)), k + 1), F.when(k % 10 == 1, F.greatest(k - 1, F.lit(1)))), lambda c: c.isNotNull()).alias("ends"))
    refs = ends.select(k.alias("owner"), F.posexplode("ends").alias("n", "child")).select("owner", F.col("child").cast("long").alias("child"), F.when(F.col("owner") % 4 == 0, -1.0).otherwise(0.5).alias("sx"), (0.5 + F.col("owner") % 3 * 0.25).alias("sy"),
                                                                                     (F.col("owner") * 37 % 360 + F.col("n")).cast("double").alias("rot"), (F.col("owner") % 17).cast("double").alias("tx"), (F.col("owner") % 5).cast("double").alias("ty"))
    return refs.withColumns(blocks.reference_map(*(F.col(c) for c in ("sx", "sy", "rot", "tx", "ty"))))


def _roots(spark, sf):
    i = p.inserts(spark, sf).withColumns({"mirror": F.when(F.col("tie") % 2 == 0, -F.col("sy")).otherwise(F.col("sy")), "turn": F.col("rot_deg") * 15})
    return i.withColumns(blocks.reference_map(F.col("sx"), F.col("mirror"), F.col("turn"), F.col("tx"), F.col("ty"))).select("owner", "seq", "tie", "block", *blocks.MAP)


def _matrix(sx, sy, rot, tx, ty):
    return f"{sx} * cos(radians({rot})) AS a, {sx} * sin(radians({rot})) AS b, -({sy}) * sin(radians({rot})) AS c, ({sy}) * cos(radians({rot})) AS d, {tx} AS e, {ty} AS f"


_ALL_BLOCKS = f"""{with_('inserts')}, ends AS (SELECT p_partkey AS owner, list_filter([CASE WHEN p_partkey >= 3 THEN p_partkey // 3 END, CASE WHEN p_partkey % 10 = 0 AND p_partkey < (SELECT max(p_partkey) FROM part) THEN p_partkey + 1 END,
        CASE WHEN p_partkey % 10 = 1 THEN greatest(p_partkey - 1, 1) END], lambda c: c IS NOT NULL) AS ends FROM part),
    refs AS (SELECT owner, child, {_matrix("sx", "sy", "rot", "tx", "ty")} FROM (SELECT owner, ends[n] AS child, CASE WHEN owner % 4 = 0 THEN -1.0 ELSE 0.5 END::DOUBLE AS sx, 0.5::DOUBLE + owner % 3 * 0.25::DOUBLE AS sy, (owner * 37 % 360 + n - 1)::DOUBLE AS rot,
        (owner % 17)::DOUBLE AS tx, (owner % 5)::DOUBLE AS ty FROM ends, unnest(range(1, len(ends) + 1)) AS r(n))),
    walk AS (SELECT owner, seq, tie, block AS inside, 0 AS level, [block] AS way, {_matrix("sx", "CASE WHEN tie % 2 = 0 THEN -sy ELSE sy END", "rot_deg * 15", "tx", "ty")} FROM inserts
        UNION ALL SELECT w.owner, w.seq, w.tie, r.child, w.level + 1, list_append(w.way, r.child), w.a * r.a + w.c * r.b, w.b * r.a + w.d * r.b, w.a * r.c + w.c * r.d, w.b * r.c + w.d * r.d, w.a * r.e + w.c * r.f + w.e, w.b * r.e + w.d * r.f + w.f
        FROM walk w JOIN refs r ON w.inside = r.owner WHERE w.level < 3 AND NOT list_contains(w.way, r.child))"""


@query(f"""{_ALL_BLOCKS} SELECT owner, seq, tie, inside, level, {", ".join(f"floor({c} * 1000 + 0.37)::BIGINT AS {c}" for c in "abcdef")} FROM walk""")
def block_expansion_affine(spark, sf):
    """The maps in thousandths, cut where no sum of binary fractions lies, as both engines' last bits differ."""
    found = blocks.expanded(_roots(spark, sf), _references(spark, sf), 3)
    return found.select("owner", "seq", "tie", "inside", "level", *(F.floor(F.col(c) * 1000 + 0.37).cast("long").alias(c) for c in blocks.MAP))


@query(f"""{_ALL_BLOCKS}, image AS (SELECT w.*, a * a + b * b AS u, c * c + d * d AS v, a * c + b * d AS s, a * 2 + c * 1 + e AS cx, b * 2 + d * 1 + f AS cy FROM walk w WHERE level <= 1)
    SELECT owner, seq, tie, inside, CASE WHEN abs(u - v) <= 1e-9 * (u + v) AND abs(s) <= 1e-9 * (u + v) THEN 'CIRCLE' ELSE 'ELLIPSE' END AS kind, round(cx, 4) + 0.0 AS cx, round(cy, 4) + 0.0 AS cy,
    round(3 * sqrt((u + v) / 2 + sqrt((u - v) * (u - v) / 4 + s * s)), 4) AS major, round(sqrt(greatest(0, (u + v) / 2 - sqrt((u - v) * (u - v) / 4 + s * s)) / ((u + v) / 2 + sqrt((u - v) * (u - v) / 4 + s * s))), 4) AS ratio FROM image""")
def exploded_circles(spark, sf):
    """A circle of radius 3 in every block, as its image in the drawing."""
    found = blocks.expanded(_roots(spark, sf), _references(spark, sf), 1)
    e = blocks.mapped_circle(F.lit(2.0), F.lit(1.0), F.lit(3.0))
    return found.select("owner", "seq", "tie", "inside", e["kind"].alias("kind"), (F.round(e["cx"], 4) + 0.0).alias("cx"), (F.round(e["cy"], 4) + 0.0).alias("cy"), F.round(F.hypot(e["major_x"], e["major_y"]), 4).alias("major"), F.round(e["ratio"], 4).alias("ratio"))


# --- loops: clusters of three boxes, whose sides are lines in mixed directions, some ends moved, some sides missing ---


_SIDES = """sides AS (SELECT handle // 3 AS cluster, handle * 4 + k AS line, CASE k WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x1 ELSE x0 END + CASE WHEN handle % 4 = k THEN 3.5 ELSE 0 END AS px, CASE k WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN y1 ELSE y1 END AS py,
    CASE k WHEN 0 THEN x1 WHEN 1 THEN x1 WHEN 2 THEN x0 ELSE x0 END AS qx, CASE k WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN y1 ELSE y0 END + CASE WHEN handle % 7 = k THEN 6 ELSE 0 END AS qy
    FROM (SELECT handle, x0, y0, x1 * 1.0 + 12 AS x1, y1 * 1.0 + 9 AS y1 FROM entities), unnest(range(0, 4)) AS r(k) WHERE NOT (handle % 5 = 0 AND k = 2)),
    lines AS (SELECT cluster, line, CASE WHEN line % 3 = 0 THEN qx ELSE px END AS x0, CASE WHEN line % 3 = 0 THEN qy ELSE py END AS y0, CASE WHEN line % 3 = 0 THEN px ELSE qx END AS x1, CASE WHEN line % 3 = 0 THEN py ELSE qy END AS y1 FROM sides)"""


def _cluster_lines(spark, sf):
    h, k = F.col("handle"), F.col("k")
    e = p.entities(spark, sf).select("handle", "x0", "y0", (F.col("x1") + 12).alias("x1"), (F.col("y1") + 9).alias("y1"))
    s = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).where(~((h % 5 == 0) & (k == 2)))
    pick = lambda *c: F.element_at(F.array(*(F.col(n) for n in c)), k + 1)
    s = s.select(F.floor(h / 3).alias("cluster"), (h * 4 + k).alias("line"), (pick("x0", "x1", "x1", "x0") + F.when(h % 4 == k, 3.5).otherwise(0.0)).alias("px"), pick("y0", "y0", "y1", "y1").alias("py"),
                 pick("x1", "x1", "x0", "x0").alias("qx"), (pick("y0", "y1", "y1", "y0") + F.when(h % 7 == k, 6.0).otherwise(0.0)).alias("qy"))
    turned = lambda a, b: F.when(F.col("line") % 3 == 0, F.col(b)).otherwise(F.col(a))
    return s.select("cluster", "line", turned("px", "qx").alias("x0"), turned("py", "qy").alias("y0"), turned("qx", "px").alias("x1"), turned("qy", "py").alias("y1"))


def _apart(p, q):
    return f"sqrt(({p}x - {q}x) * ({p}x - {q}x) + ({p}y - {q}y) * ({p}y - {q}y))"


_BY_CHAIN = f"""{with_('entities')}, {_SIDES}, e AS (SELECT cluster, line, 0 AS side, x0 AS x, y0 AS y, x1 AS ox, y1 AS oy FROM lines UNION ALL SELECT cluster, line, 1, x1, y1, x0, y0 FROM lines),
    chain AS (SELECT i.cluster, i.line AS i, a.line AS l1, b.line AS l2, c.line AS l3, i.x AS x0, i.y AS y0, i.ox AS x1, i.oy AS y1, a.ox AS x2, a.oy AS y2, b.ox AS x3, b.oy AS y3
        FROM e i JOIN e a ON a.cluster = i.cluster AND a.line > i.line AND {_apart("a.", "i.o")} < 5 JOIN e b ON b.cluster = i.cluster AND b.line > i.line AND b.line <> a.line AND {_apart("b.", "a.o")} < 5
        JOIN e c ON c.cluster = i.cluster AND c.line > i.line AND c.line NOT IN (a.line, b.line) AND {_apart("c.", "b.o")} < 5
        WHERE i.side = 0 AND {_apart("c.o", "i.")} < 5 AND (a.side = 0 OR {_apart("a.o", "i.o")} >= 5) AND (b.side = 0 OR {_apart("b.o", "a.o")} >= 5) AND (c.side = 0 OR {_apart("c.o", "b.o")} >= 5)
        AND (b.line > a.line OR ({_apart("b.", "i.o")} >= 5 AND {_apart("b.o", "i.o")} >= 5)) AND (c.line > a.line OR ({_apart("c.", "i.o")} >= 5 AND {_apart("c.o", "i.o")} >= 5)) AND (c.line > b.line OR ({_apart("c.", "a.o")} >= 5 AND {_apart("c.o", "a.o")} >= 5))),
    ranked AS (SELECT *, list_sort([l1, l2, l3]) AS rest, row_number() OVER (PARTITION BY cluster ORDER BY i, list_sort([l1, l2, l3])) AS n FROM chain)"""


@query(f"""{_BY_CHAIN} SELECT cluster, i, rest[1] AS j, rest[2] AS k, rest[3] AS m, {", ".join(f"round({c}{n}, 4) AS {c}{n}" for n in range(4) for c in "xy")} FROM ranked WHERE n = 1""")
def four_line_loops(spark, sf):
    found = loops.four_line_loops(_cluster_lines(spark, sf), most=None)
    return found.select("cluster", "i", "j", "k", "m", *(F.round(f"{c}{n}", 4).alias(f"{c}{n}") for n in range(4) for c in "xy"))


# --- snapping: the segments of the polylines of 16 orders are a drawing ---


def _drawing_segments(spark, sf):
    from plotweave.operators import drawing

    s = drawing.segments(p.vertices(spark, sf))
    return s.select(F.floor(F.col("owner") / 16).alias("drawing"), (F.col("owner") * 1000 + F.col("seq")).alias("segment"), F.col("ax").alias("x0"), F.col("ay").alias("y0"), F.col("bx").alias("x1"), F.col("by").alias("y1"))


_SNAPPED = f"""{with_('vertices')}, seg AS (SELECT owner // 16 AS drawing, owner * 1000 + seq AS segment, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM vertices WINDOW w AS (PARTITION BY owner ORDER BY seq)),
    pts AS (SELECT drawing, segment, side, CASE side WHEN 0 THEN x0 ELSE x1 END AS x, CASE side WHEN 0 THEN y0 ELSE y1 END AS y, row_number() OVER (PARTITION BY drawing ORDER BY segment, side) AS n FROM seg, unnest([0, 1]) AS r(side) WHERE x1 IS NOT NULL),
    snap AS (SELECT drawing, 0::BIGINT AS n, []::STRUCT(num BIGINT, x DOUBLE, y DOUBLE)[] AS nodes, NULL::STRUCT(num BIGINT, x DOUBLE, y DOUBLE) AS node FROM (SELECT DISTINCT drawing FROM pts)
        UNION ALL SELECT q.drawing, q.n, CASE WHEN q.first IS NULL THEN list_append(q.nodes, q.own) ELSE q.nodes END, coalesce(q.first, q.own)
        FROM (SELECT p.drawing, p.n, s.nodes, {{'num': p.segment * 2 + p.side, 'x': p.x, 'y': p.y}}::STRUCT(num BIGINT, x DOUBLE, y DOUBLE) AS own, list_filter(s.nodes, lambda m: sqrt((m.x - p.x) * (m.x - p.x) + (m.y - p.y) * (m.y - p.y)) <= 2.0)[1] AS first
            FROM snap s JOIN pts p ON p.drawing = s.drawing AND p.n = s.n + 1) q),
    ended AS (SELECT p.drawing, p.segment, p.side, s.node FROM snap s JOIN pts p ON p.drawing = s.drawing AND p.n = s.n),
    ss AS (SELECT drawing, segment, max(node.num) FILTER (side = 0) AS a, max(node.x) FILTER (side = 0) AS ax, max(node.y) FILTER (side = 0) AS ay, max(node.num) FILTER (side = 1) AS b, max(node.x) FILTER (side = 1) AS bx, max(node.y) FILTER (side = 1) AS by_ FROM ended GROUP BY drawing, segment)"""


@query(f"{_SNAPPED} SELECT drawing, segment, a, ax, ay, b, bx, by_ AS \"by\" FROM ss")
def snapped_segments(spark, sf):
    return snapping.snapped_segments(_drawing_segments(spark, sf))


@query(f"""{_SNAPPED}, spokes AS (SELECT drawing, a AS tip, segment, ax AS x, ay AS y, bx - ax AS dx, by_ - ay AS dy FROM ss WHERE a <> b UNION ALL SELECT drawing, b, segment, bx, by_, ax - bx, ay - by_ FROM ss WHERE a <> b),
    met AS (SELECT s.drawing, s.tip, s.segment AS first, t.segment AS second, s.x, s.y, (s.dx + t.dx) * 0.5 AS mx, (s.dy + t.dy) * 0.5 AS my,
        degrees(acos(greatest(-1.0, least(1.0, (s.dx * t.dx + s.dy * t.dy) / (sqrt(s.dx * s.dx + s.dy * s.dy) * sqrt(t.dx * t.dx + t.dy * t.dy)))))) AS angle
        FROM spokes s JOIN spokes t ON s.drawing = t.drawing AND s.tip = t.tip AND s.segment < t.segment)
    SELECT drawing, tip, first, second, x AS tip_x, y AS tip_y, round(mx / sqrt(mx * mx + my * my), 6) + 0.0 AS dir_x, round(my / sqrt(mx * mx + my * my), 6) + 0.0 AS dir_y FROM met WHERE angle > 20 AND angle < 140 AND sqrt(mx * mx + my * my) >= 1e-3""")
def detected_arrows(spark, sf):
    found = snapping.arrows(_drawing_segments(spark, sf))
    return found.select("drawing", "tip", "first", "second", "tip_x", "tip_y", (F.round("dir_x", 6) + 0.0).alias("dir_x"), (F.round("dir_y", 6) + 0.0).alias("dir_y"))


# --- matching: every shape against all others by hash, clusters of three entities against a symbol for each part ---


def _hashed_stats(spark, sf, key):
    from plotweave.operators import matching

    pts = p.points(spark, sf)
    count = lambda test: F.size(F.filter("pts", test)).cast("int")
    stats = pts.select("shape", count(lambda q: q["x"] > 0).alias("n_line"), count(lambda q: q["y"] > 0).alias("n_arc"), count(lambda q: q["x"] > q["y"]).alias("n_circle"), F.when(F.col("label") % 5 == 0, F.concat(F.lit("L"), F.col("label").cast("string"))).alias("sig"))
    return matching.phash(pts).join(stats, "shape").select(F.col("shape").alias(key), "high", "low", (F.col("n_line") + F.col("n_arc")).alias("n_primitives"), "n_line", "n_arc", "n_circle", "sig")


def _hash_sql():
    from plotweave.operators.catalogue import _CENTRED, _HAMMING, _HASHES

    return f"""{with_('points')}, {_CENTRED}, {_HASHES}, stats AS (SELECT shape, count(*) FILTER (x > 0) AS n_line, count(*) FILTER (y > 0) AS n_arc, count(*) FILTER (x > y) AS n_circle, max(CASE WHEN label % 5 = 0 THEN 'L' || label END) AS sig FROM points GROUP BY shape),
    h AS (SELECT hashes.shape, high, low, n_line + n_arc AS n_primitives, n_line, n_arc, n_circle, sig FROM hashes JOIN stats ON stats.shape = hashes.shape),
    met AS (SELECT c.shape AS cand, r.shape AS ref, {_HAMMING} AS distance, (abs(c.n_primitives - r.n_primitives) + abs(c.n_line - r.n_line) + abs(c.n_arc - r.n_arc) + abs(c.n_circle - r.n_circle))::INT AS stats_distance
        FROM h c JOIN h r ON c.shape <> r.shape AND (r.sig IS NULL OR r.sig = c.sig) AND (c.n_primitives = 0 OR r.n_primitives = 0 OR c.n_primitives::DOUBLE / r.n_primitives BETWEEN 0.5 AND 2.0))"""


@query(f"{_hash_sql()}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY distance, stats_distance, ref) AS n FROM met WHERE distance <= 12) SELECT cand, ref, distance, stats_distance FROM ranked WHERE n = 1")
def gated_best_match(spark, sf):
    """Of all other shapes within 12 bits the best that the gates admit."""
    from plotweave.operators import match_pipeline

    pairs = match_pipeline.gated_pairs(_hashed_stats(spark, sf, "cand"), _hashed_stats(spark, sf, "ref"), 12).where("cand <> ref")
    return pairs.groupBy("cand").agg(F.min(F.struct("distance", "stats_distance", "ref")).alias("best")).select("cand", "best.ref", "best.distance", "best.stats_distance")


def _members(rows, key, k, w, h):
    """Members of three kinds that follow each other, ``rows`` being numbered by k; each is about 20 from the one before."""
    x = (F.col("at") * 20).cast("double")
    spot = lambda u, v: F.struct((F.lit(1.0) * u).alias("x"), (F.lit(1.0) * v).alias("y"))
    kind = F.element_at(F.array(*map(F.lit, p.TYPES)), (k % 7 + 1).cast("int"))
    middle = F.array(spot(x + w / 2, h / 2))
    shapes = F.when(kind == "LINE", F.array(spot(x, F.lit(0.0)), spot(x + w, h))).when(kind == "LWPOLYLINE", F.array(spot(x, F.lit(0.0)), spot(x + w, F.lit(0.0)), spot(x + w, h), spot(x, h))).when(kind.isin("CIRCLE", "ARC"), middle)
    return rows.select(key.alias("key"), F.col("at").cast("long").alias("seq"), kind.alias("type"), F.coalesce(shapes, F.slice(middle, 1, 0)).alias("pts"), (kind == "LWPOLYLINE").alias("closed"), F.when(kind.isin("CIRCLE", "ARC"), w / 2).alias("radius"),
                       F.when(kind == "ARC", 0.0).alias("start_deg"), F.when(kind == "ARC", 200.0).alias("stop_deg"))


def _cluster_members(spark, sf):
    e = p.entities(spark, sf).withColumn("at", F.col("handle") % 3)
    h = F.col("handle")
    return _members(e, F.floor(h / 3), h, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))


def _symbol_members(spark, sf):
    s = table(spark, sf, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("at")).withColumn("k", F.col("p_partkey") * 3 + F.col("at"))
    k = F.col("k")
    return _members(s, F.col("p_partkey"), k, (1 + k % 13).cast("double"), (1 + (k * 7) % 11).cast("double"))


@query()
def symbol_matches(spark, sf):
    """The whole pipeline: descriptors, the nearest five symbols, Chamfer distance. Tested by a loop over all pairs."""
    from plotweave.operators import match_pipeline

    return match_pipeline.symbol_matches(_cluster_members(spark, sf), _symbol_members(spark, sf))


_MEMBERS_SQL = f"""{with_('entities')}, e AS (SELECT handle // 3 AS key, handle % 3 AS at_, handle AS k, x1 - x0 AS w, y1 - y0 AS h FROM entities),
    s AS (SELECT p_partkey AS key, r.i AS at_, p_partkey * 3 + r.i AS k, (1 + (p_partkey * 3 + r.i) % 13)::DOUBLE AS w, (1 + ((p_partkey * 3 + r.i) * 7) % 11)::DOUBLE AS h FROM part, unnest(range(0, 3)) AS r(i)),
    m AS (SELECT 'c' AS side, * FROM e UNION ALL SELECT 's', * FROM s),
    typed AS (SELECT side, key, k % 7 AS kind, at_ * 20.0::DOUBLE AS x, w, h FROM m),
    box AS (SELECT side, key, max(CASE WHEN kind IN (0, 3) THEN x + w WHEN kind IN (1, 2) THEN x + w / 2 + w / 2 END) - min(CASE WHEN kind IN (0, 3) THEN x WHEN kind IN (1, 2) THEN x + w / 2 - w / 2 END) AS bw,
        max(CASE WHEN kind IN (0, 3) THEN h WHEN kind IN (1, 2) THEN h / 2 + w / 2 END) - min(CASE WHEN kind IN (0, 3) THEN 0 WHEN kind = 1 THEN h / 2 - w / 2 WHEN kind = 2 THEN h / 2 + w / 2 * sin(radians(200)) END) AS bh FROM typed GROUP BY side, key),
    counts AS (SELECT side, key, [count(*) FILTER (kind = 0), count(*) FILTER (kind = 1), count(*) FILTER (kind = 2), count(*) FILTER (kind = 3), 0, count(*) FILTER (kind = 5)]::INT[] AS counts FROM typed GROUP BY side, key)"""


@query(f"""{_MEMBERS_SQL} SELECT c.key, array_to_string(c.counts, ',') AS counts, round_even(bw / greatest(bw, bh) / 0.01, 0)::INT AS width, round_even(bh / greatest(bw, bh) / 0.01, 0)::INT AS height, array_to_string(list_sort(coalesce(r.radii, [])), ',') AS radii
    FROM counts c JOIN box b ON b.side = c.side AND b.key = c.key LEFT JOIN (SELECT t.side, t.key, list(round_even(t.w / 2 / greatest(bw, bh) / 0.01, 0)::INT) AS radii FROM typed t JOIN box b ON b.side = t.side AND b.key = t.key WHERE kind IN (1, 2) GROUP BY t.side, t.key) r
    ON r.side = c.side AND r.key = c.key WHERE c.side = 's' AND greatest(bw, bh) > 0""")
def symbol_descriptors(spark, sf):
    """Counts, sizes and radii of the symbols' descriptors."""
    from plotweave.operators import match_pipeline

    d = match_pipeline.descriptors(match_pipeline.grouped(_symbol_members(spark, sf)))
    return d.select("key", F.array_join("counts", ",").alias("counts"), F.col("size")[0].alias("width"), F.col("size")[1].alias("height"), F.array_join("radii", ",").alias("radii"))


# --- frames: entities of a drawing with the corners of their boxes as connection points; two long lines at its edges are added ---


def _items(spark, sf):
    e = p.entities(spark, sf)
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    boxes = e.select(F.col("doc_id").alias("drawing"), F.col("handle") * 4, "x0", "y0", "x1", "y1")
    ends = e.groupBy("doc_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("handle").alias("least"))
    sides = ends.select("doc_id", F.inline(F.array(F.struct((F.col("least") * 4 + 1).alias("handle"), "x0", "y0", "x1", F.col("y0").alias("y1")), F.struct((F.col("least") * 4 + 2).alias("handle"), "x0", "y0", F.col("x0").alias("x1"), F.col("y1").alias("y1")))))
    items = boxes.toDF("drawing", "handle", "x0", "y0", "x1", "y1").union(sides.toDF("drawing", "handle", "x0", "y0", "x1", "y1"))
    return items.withColumn("points", F.array(corner("x0", "y0"), corner("x1", "y1"))), ends.select(F.col("doc_id").alias("drawing"), "x0", "y0", "x1", "y1")


_FRAME_TOL = 25.0
_EPS = 2 * _FRAME_TOL  # how far from an edge counts as at it
_FRAMES = f"""{with_('entities')}, ends AS (SELECT doc_id AS drawing, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(handle) AS least FROM entities GROUP BY doc_id),
    items AS (SELECT doc_id AS drawing, handle * 4 AS handle, x0, y0, x1, y1 FROM entities UNION ALL SELECT drawing, least * 4 + 1, x0, y0, x1, y0 FROM ends UNION ALL SELECT drawing, least * 4 + 2, x0, y0, x0, y1 FROM ends),
    spots AS (SELECT drawing, handle, round_even(x0 / {_FRAME_TOL}, 0)::BIGINT AS u, round_even(y0 / {_FRAME_TOL}, 0)::BIGINT AS v FROM items UNION SELECT drawing, handle, round_even(x1 / {_FRAME_TOL}, 0)::BIGINT, round_even(y1 / {_FRAME_TOL}, 0)::BIGINT FROM items),
    m AS (SELECT i.*, e.x0 AS ex0, e.y0 AS ey0, e.x1 AS ex1, e.y1 AS ey1, i.x1 - i.x0 > (e.x1 - e.x0) * 0.8 AS wide, i.y1 - i.y0 > (e.y1 - e.y0) * 0.8 AS high, abs(i.x0 - e.x0) < {_EPS} AS at_x0, abs(i.y0 - e.y0) < {_EPS} AS at_y0, abs(i.x1 - e.x1) < {_EPS} AS at_x1, abs(i.y1 - e.y1) < {_EPS} AS at_y1,
        abs(i.x1 - e.x0) < {_EPS} AS flat_x0, abs(i.y1 - e.y0) < {_EPS} AS flat_y0, abs(i.x0 - e.x1) < {_EPS} AS flat_x1, abs(i.y0 - e.y1) < {_EPS} AS flat_y1 FROM items i JOIN ends e ON e.drawing = i.drawing),
    flood AS (SELECT drawing, handle FROM m WHERE (at_y0 OR at_y1) AND wide OR (at_x0 OR at_x1) AND high OR at_x0 AND at_y0 AND at_x1 AND at_y1
        UNION SELECT b.drawing, b.handle FROM flood f JOIN spots a ON a.drawing = f.drawing AND a.handle = f.handle JOIN spots b ON b.drawing = a.drawing AND b.u = a.u AND b.v = a.v),
    marked AS (SELECT m.*, f.handle IS NOT NULL AS in_frame, f.handle IS NOT NULL AND (wide AND (at_y0 AND flat_y0 OR at_y1 AND flat_y1) OR high AND (at_x0 AND flat_x0 OR at_x1 AND flat_x1) OR at_x0 AND at_y0 AND at_x1 AND at_y1) AS on_border FROM m LEFT JOIN flood f ON f.drawing = m.drawing AND f.handle = m.handle),
    zoned AS (SELECT *, (NOT bool_or(in_frame) OVER (PARTITION BY drawing) OR in_frame AND NOT on_border) AND (x0 + x1) * 0.5 >= ex1 - (ex1 - ex0) * 0.3 - {_EPS} AND (y0 + y1) * 0.5 <= ey0 + (ey1 - ey0) * 0.3 + {_EPS} AS in_title FROM marked WHERE ex1 > ex0 AND ey1 > ey0)"""


@query(f"{_FRAMES} SELECT drawing, handle, in_frame, on_border, in_title FROM zoned")
def drawing_frames(spark, sf):
    from plotweave.operators import frames

    return frames.frames(*_items(spark, sf), _FRAME_TOL)


@query(f"""{_FRAMES}, t AS (SELECT drawing, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(ex1 - ex0) AS w, max(ey1 - ey0) AS h FROM zoned WHERE in_title GROUP BY drawing)
    SELECT drawing, x0, y0, x1, y1 FROM t WHERE x1 - x0 <= w * 0.8 AND y1 - y0 <= h * 0.8""")
def title_blocks(spark, sf):
    from plotweave.operators import frames

    return frames.title_blocks(*_items(spark, sf), _FRAME_TOL)


# --- documents: orders are objects that refer to a half, a triple and a neighbour of their number, some of which don't exist ---


def _document(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    doc = F.floor(F.col("k") / 1024)
    inside = lambda c: doc * 1024 + F.pmod(c, F.lit(1024))
    ends = F.array(inside(F.floor(F.col("k") % 1024 / 2)), F.when(F.col("k") % 5 == 0, inside(F.col("k") * 3 + 1)), F.when(F.col("k") % 7 == 0, inside(F.col("k") + 1)), F.when(F.col("k") % 11 == 0, F.lit(0).cast("long")))
    objects = o.where("k % 13 <> 0").select(doc.alias("doc"), F.col("k").alias("handle"))
    refs = o.where("k % 13 <> 0").select(doc.alias("doc"), F.col("k").alias("src"), F.explode(ends).alias("dst"))
    roots = o.groupBy(doc.alias("doc")).agg(F.max("k").alias("handle"))
    return roots, objects, refs


_CLOSURE = """WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_orderkey // 1024 AS doc FROM orders), objects AS (SELECT doc, k AS handle FROM o WHERE k % 13 <> 0),
    refs AS (SELECT doc, k AS src, unnest([doc * 1024 + (k % 1024 // 2) % 1024, CASE WHEN k % 5 = 0 THEN doc * 1024 + (k * 3 + 1) % 1024 END, CASE WHEN k % 7 = 0 THEN doc * 1024 + (k + 1) % 1024 END, CASE WHEN k % 11 = 0 THEN 0 END]) AS dst FROM o WHERE k % 13 <> 0),
    roots AS (SELECT doc, max(k) AS handle FROM o GROUP BY doc),
    walk AS (SELECT doc, handle, 0 AS depth FROM roots SEMI JOIN objects USING (doc, handle) UNION SELECT r.doc, r.dst, w.depth + 1 FROM walk w JOIN refs r ON r.doc = w.doc AND r.src = w.handle JOIN objects x ON x.doc = r.doc AND x.handle = r.dst WHERE r.dst <> 0 AND w.depth < 40),
    seen AS (SELECT doc, handle, min(depth) AS depth FROM walk GROUP BY doc, handle)"""


@query(f"{_CLOSURE} SELECT doc, handle, depth FROM seen")
def document_closure(spark, sf):
    from plotweave.operators import closure

    return closure.reachable(*_document(spark, sf))[0]


@query(f"""{_CLOSURE} SELECT doc, handle, count(*) AS n FROM (SELECT r.doc, r.dst AS handle FROM seen s JOIN refs r ON r.doc = s.doc AND r.src = s.handle WHERE r.dst <> 0 UNION ALL SELECT doc, handle FROM roots) a ANTI JOIN objects USING (doc, handle) GROUP BY doc, handle""")
def unresolved_handles(spark, sf):
    from plotweave.operators import closure

    return closure.reachable(*_document(spark, sf))[1]


def _dictionaries(spark, sf):
    o = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    doc = F.floor(F.col("k") / 64)
    entries = o.where("k % 64 <> 0").select(doc.alias("doc"), (doc * 64 + F.floor(F.col("k") % 64 / 3)).alias("handle"), F.concat_ws("_", "p_brand", F.col("k").cast("string")).alias("name"), F.col("k").alias("target"))
    back = o.where("k % 64 = 21").select(doc.alias("doc"), F.col("k").alias("handle"), F.lit("ROOT").alias("name"), (doc * 64).alias("target"))
    return o.select(doc.alias("doc"), (doc * 64).alias("handle")).distinct(), entries.union(back)


@query("""WITH RECURSIVE e AS (SELECT p_partkey // 64 AS doc, (p_partkey // 64) * 64 + (p_partkey % 64) // 3 AS handle, p_brand || '_' || p_partkey AS name, p_partkey AS target FROM part WHERE p_partkey % 64 <> 0
        UNION ALL SELECT p_partkey // 64, p_partkey, 'ROOT', (p_partkey // 64) * 64 FROM part WHERE p_partkey % 64 = 21),
    w AS (SELECT DISTINCT p_partkey // 64 AS doc, '' AS path, (p_partkey // 64) * 64 AS handle, [(p_partkey // 64) * 64] AS way, false AS again FROM part
        UNION ALL SELECT w.doc, CASE WHEN w.path = '' THEN e.name ELSE w.path || '/' || e.name END, e.target, list_append(w.way, e.target), list_contains(w.way, e.target) FROM w JOIN e ON e.doc = w.doc AND e.handle = w.handle WHERE NOT w.again)
    SELECT doc, path, handle FROM w WHERE path <> ''""")
def dictionary_paths(spark, sf):
    from plotweave.operators import closure

    return closure.dictionary_paths(*_dictionaries(spark, sf))


@query()
def geometry_ids(spark, sf):
    """The canonical form and SHA-1 id of each symbol. Tested against json.dumps and hashlib."""
    from plotweave.operators import geometry_ids as ids

    m = _symbol_members(spark, sf)
    bulged = F.transform("pts", lambda q: F.struct(q["x"], q["y"], (F.col("seq") % 2 * 0.5).alias("bulge")))
    return ids.geometry_ids(m.withColumn("pts", bulged))


# --- curves as points: polylines with bulges that alternate, arcs of entities ---


def _bulged(spark, sf):
    from plotweave.operators import curve_paths

    return curve_paths.gathered_vertices(p.vertices(spark, sf).withColumn("bulge", ((F.col("seq") % 3 - 1) * 0.5).cast("double")))


_BULGED_SEGMENTS = f"""{with_('vertices')}, seg AS (SELECT owner, seq, x, y, (seq % 3 - 1) * 0.5::DOUBLE AS bulge, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM vertices WINDOW w AS (PARTITION BY owner ORDER BY seq))"""


@query(f"""{_BULGED_SEGMENTS}, any_ AS (SELECT owner, bool_or(bulge <> 0) AS bulged FROM seg GROUP BY owner),
    pts AS (SELECT owner, x, y FROM seg UNION ALL
        SELECT owner, cx + (x - cx) * cos(a) - (y - cy) * sin(a), cy + (x - cx) * sin(a) + (y - cy) * cos(a) FROM (
            SELECT s.owner, s.x, s.y, (x + nx) / 2 - (ny - y) * (1 - bulge * bulge) / (4 * bulge) AS cx, (y + ny) / 2 + (nx - x) * (1 - bulge * bulge) / (4 * bulge) AS cy, 4 * atan(bulge) * k / 254.0::DOUBLE AS a
            FROM seg s, unnest(range(1, 254)) AS r(k) WHERE nx IS NOT NULL AND bulge <> 0 AND (nx <> x OR ny <> y)))
    SELECT owner, round(min(x), 4) AS x0, round(min(y), 4) AS y0, round(max(x), 4) AS x1, round(max(y), 4) AS y1 FROM pts GROUP BY owner""")
def bulged_polyline_boxes(spark, sf):
    from plotweave.operators import curve_paths

    points = _bulged(spark, sf).select("owner", curve_paths.polyline_bounds(F.col("vertices"), F.lit(False)).alias("points"))
    return points.select("owner", *(F.round(c, 4).alias(n) for n, c in curve_paths.box_of(F.col("points")).items()))


@query(f"""{with_('vertices')}, seg AS (SELECT owner, seq, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM vertices WINDOW w AS (PARTITION BY owner ORDER BY seq)),
    l AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS d FROM seg WHERE nx IS NOT NULL),
    cut AS (SELECT owner, seq, x, y, (nx - x) / d AS ux, (ny - y) / d AS uy, c.k * 40.0::DOUBLE + t.at_ AS a, least(d, c.k * 40.0::DOUBLE + t.at_ + t.long) AS b FROM l, unnest(range(0, greatest(1, ceil(d / 40.0))::BIGINT)) AS c(k), (VALUES (0.0::DOUBLE, 20.0::DOUBLE), (30.0, 0.5)) AS t(at_, long) WHERE d > 0 AND c.k * 40.0::DOUBLE + t.at_ < d)
    SELECT owner, count(*) AS n, round(sum(b - a), 3) AS drawn, round(sum(x + ux * a), 2) AS sum_x0, round(sum(y + uy * b), 2) AS sum_y1 FROM cut GROUP BY owner""")
def dashes_along(spark, sf):
    """Dashes of 20, gaps of 10 and dots of 0.5 along each polyline."""
    from plotweave.operators import curve_paths

    v = _bulged(spark, sf).withColumn("pts", F.transform("vertices", lambda q: F.struct(q["x"], q["y"])))
    pattern = F.array(*map(F.lit, (20.0, -10.0, 0.0, -10.0)))
    d = v.select("owner", F.inline(curve_paths.dashes(F.col("pts"), F.lit(False), pattern, 0.5)))
    return d.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 3).alias("drawn"), F.round(F.sum("x0"), 2).alias("sum_x0"), F.round(F.sum("y1"), 2).alias("sum_y1"))


@query(f"""{with_('entities')}, a AS (SELECT handle, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (x1 - x0) / 2 AS r, handle * 7 % 360 AS s, (1 + handle * 11 % 359)::DOUBLE AS turn FROM entities WHERE type = 'ARC')
    SELECT handle, round(min(cx + r * cos(radians(s + turn * k / 255.0::DOUBLE))), 4) AS x0, round(min(cy + r * sin(radians(s + turn * k / 255.0::DOUBLE))), 4) AS y0, round(max(cx + r * cos(radians(s + turn * k / 255.0::DOUBLE))), 4) AS x1, round(max(cy + r * sin(radians(s + turn * k / 255.0::DOUBLE))), 4) AS y1
    FROM a, unnest(range(0, 256)) AS q(k) GROUP BY handle""")
def arc_polygon_boxes(spark, sf):
    from plotweave.operators import curve_paths

    e = p.entities(spark, sf).where("type = 'ARC'")
    h = F.col("handle")
    start, turn = (h * 7 % 360).cast("double"), (1 + h * 11 % 359).cast("double")
    points = curve_paths.arc_polygon((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, (F.col("x1") - F.col("x0")) / 2, start, start + turn, curve_paths.ARC_PRECISION)
    return e.select("handle", points.alias("pts")).select("handle", *(F.round(c, 4).alias(n) for n, c in curve_paths.box_of(F.col("pts")).items()))


# --- features of clusters: three boxes, their circles and the lines of a cluster, by the rules for fans and diagonals ---


def _feature_members(spark, sf):
    """The sides of three boxes as lines, a closed outline for every second entity, and circles about corners."""
    e = p.entities(spark, sf)
    h = F.col("handle")
    spot = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w, t = h % 3 * 12, h % 5 * 3, 8 + h % 13, 8 + h % 11
    rows = F.array(
        F.struct((h * 4).alias("seq"), F.lit("LINE").alias("type"), F.array(spot(x, y), spot(x + w, y + t)).alias("pts"), F.lit(False).alias("closed"), F.lit(None).cast("double").alias("radius")),
        F.struct((h * 4 + 1).alias("seq"), F.lit("LINE").alias("type"), F.array(spot(x + w, y), spot(x, y + t)).alias("pts"), F.lit(False).alias("closed"), F.lit(None).cast("double").alias("radius")),
        F.when(h % 2 == 0, F.struct((h * 4 + 2).alias("seq"), F.lit("LWPOLYLINE").alias("type"), F.array(spot(x - 2, y - 2), spot(x + w + 4, y - 2), spot(x + w + 4, y + t + 4), spot(x - 2, y + t + 4)).alias("pts"), F.lit(True).alias("closed"), F.lit(None).cast("double").alias("radius"))),
        F.when(h % 4 == 1, F.struct((h * 4 + 2).alias("seq"), F.lit("LINE").alias("type"), F.array(spot(x, y + t / 2), spot(x + w, y + t / 2)).alias("pts"), F.lit(False).alias("closed"), F.lit(None).cast("double").alias("radius"))),
        F.when(h % 4 == 1, F.struct((h * 4 + 3).alias("seq"), F.lit("CIRCLE").alias("type"), F.array(spot(x + w / 2, y + t / 2)).alias("pts"), F.lit(False).alias("closed"), (4 + h % 6).cast("double").alias("radius"))))
    return e.select(F.floor(h / 3).alias("key"), F.inline(F.filter(rows, lambda r: r.isNotNull())))


_FEATURES_SQL = f"""{with_('entities')}, b AS (SELECT handle AS h, handle // 3 AS key, (handle % 3 * 12)::DOUBLE AS x, (handle % 5 * 3)::DOUBLE AS y, (8 + handle % 13)::DOUBLE AS w, (8 + handle % 11)::DOUBLE AS t FROM entities),
    l AS (SELECT key, x AS ax, y AS ay, x + w AS bx, y + t AS by_ FROM b UNION ALL SELECT key, x + w, y, x, y + t FROM b UNION ALL SELECT key, x, y + t / 2, x + w, y + t / 2 FROM b WHERE h % 4 = 1),
    c AS (SELECT key, h * 4 + 3 AS circle, x + w / 2 AS cx, y + t / 2 AS cy, (4 + h % 6)::DOUBLE AS r FROM b WHERE h % 4 = 1),
    fit AS (SELECT *, greatest(0, least(1, ((cx - ax) * (bx - ax) + (cy - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS u FROM c JOIN l USING (key)),
    fans AS (SELECT key, circle, cx, cy, r FROM fit WHERE sqrt((ax - cx) ** 2 + (ay - cy) ** 2) <= 1.8 * r AND sqrt((bx - cx) ** 2 + (by_ - cy) ** 2) <= 1.8 * r
        AND sqrt((ax + u * (bx - ax) - cx) ** 2 + (ay + u * (by_ - ay) - cy) ** 2) < greatest(0.4 * r, 3) GROUP BY ALL HAVING count(*) >= 3),
    rects AS (SELECT key, x - 2 AS x0, y - 2 AS y0, x + w + 4 AS x1, y + t + 4 AS y1, row_number() OVER (PARTITION BY key ORDER BY -((w + 6) * (t + 6)), h) AS n FROM b WHERE h % 2 = 0)"""


@query(f"{_FEATURES_SQL} SELECT key, circle, cx, cy, r FROM fans")
def fan_circles(spark, sf):
    from plotweave.operators import cluster_features

    return cluster_features.fan_circles(_feature_members(spark, sf))


@query(f"""{_FEATURES_SQL}, m AS (SELECT * FROM rects WHERE n = 1)
    SELECT k.key, count(m.key) > 0 AS has_rect, max(round(greatest(m.x1 - m.x0, m.y1 - m.y0) / least(m.x1 - m.x0, m.y1 - m.y0), 6)) AS ratio, (SELECT count(*) FROM rects r WHERE r.key = k.key) AS n_rects,
    max(CASE WHEN f.cx - f.r >= m.x0 - tol AND f.cy - f.r >= m.y0 - tol AND f.cx + f.r <= m.x1 + tol AND f.cy + f.r <= m.y1 + tol THEN 1 ELSE 0 END) = 1 AS fan_in_rect, coalesce(max(d.diagonal), 0) = 1 AS diagonal
    FROM (SELECT DISTINCT key FROM b) k LEFT JOIN (SELECT *, least(greatest(least(x1 - x0, y1 - y0) * 0.05, 1), 10) AS tol FROM m) m ON m.key = k.key LEFT JOIN fans f ON f.key = k.key
    LEFT JOIN (SELECT l.key, max(CASE WHEN ax BETWEEN x0 AND x1 AND bx BETWEEN x0 AND x1 AND ay BETWEEN y0 AND y1 AND by_ BETWEEN y0 AND y1 AND abs(bx - ax) >= 1 AND abs(by_ - ay) >= 1
        AND sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) >= greatest(least(x1 - x0, y1 - y0) * 0.3, 5) THEN 1 ELSE 0 END) AS diagonal FROM l JOIN m ON m.key = l.key GROUP BY l.key) d ON d.key = k.key
    GROUP BY k.key""")
def cluster_features(spark, sf):
    from plotweave.operators import cluster_features as features

    found = features.cluster_features(_feature_members(spark, sf))
    return found.select("key", F.col("has_rect"), F.round("ratio", 6).alias("ratio"), "n_rects", "fan_in_rect", "diagonal")
