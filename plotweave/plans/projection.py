"""Drawing tables as a deterministic projection of the relational test tables.

entities come from orders, layers from nation, blocks from part, inserts and vertices from lineitem, points from
embeddings, notifications from events and texts from documents. ``CTES`` holds the same projections as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from plotweave.plans.tables import table

TYPES = ("LINE", "CIRCLE", "ARC", "LWPOLYLINE", "TEXT", "INSERT", "HATCH")


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """name, aci, is_on, linetype."""
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("name"), (1 + k % 7).cast("int").alias("aci"), (F.col("n_regionkey") != 4).alias("is_on"),
        F.when(k % 3 == 0, "Continuous").when(k % 3 == 1, "DASHED").otherwise("HIDDEN").alias("linetype"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """handle, doc_id, type, layer, aci, linetype, x0, y0, x1, y1."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    k, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (k % 7 + 1).cast("int"))
    own = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), F.col("c_nationkey") == n["n_nationkey"])  # nation: 25 rows at any scale
    return own.select(
        k.alias("handle"), (F.col("o_custkey") % 16).alias("doc_id"), kind.alias("type"), F.col("n_name").alias("layer"),
        F.when(F.col("o_orderstatus") == "F", 256).when(F.col("o_orderstatus") == "O", 3).otherwise(0).alias("aci"),
        F.when(k % 4 == 0, "BYLAYER").when(k % 4 == 1, "Continuous").when(k % 4 == 2, "DASHED").otherwise(" continuous ").alias("linetype"),
        (cents % 10000 / 10.0).alias("x0"), ((k * 7919) % 10000 / 10.0).alias("y0"),
        (cents % 10000 / 10.0 + 1 + k % 13).alias("x1"), ((k * 7919) % 10000 / 10.0 + 1 + F.col("o_custkey") % 11).alias("y1"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """block, name, w, h of every block definition; its extents are (0, 0)-(w, h)."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("block"), F.concat_ws("_", "p_brand", F.col("p_partkey").cast("string")).alias("name"),
        (1.0 + F.col("p_size")).alias("w"), (1.0 + F.col("p_partkey") % 7).alias("h"))


def inserts(spark: SparkSession, sf: str) -> DataFrame:
    """owner, seq, block, tx, ty, sx, sy, rot of every block reference."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("block"), F.col("l_quantity").alias("tx"),
        F.floor("l_extendedprice").cast("double").alias("ty"), (1 + F.round(F.col("l_tax") * 100)).alias("sx"), (1 + F.round(F.col("l_discount") * 100)).alias("sy"),
        F.round(F.col("l_discount") * 100).alias("rot_deg"), F.col("l_suppkey").alias("tie"))


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    """owner, seq, x, y of polyline vertices; seq numbers each owner's rows from 1 in a total order."""
    li = table(spark, sf, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = li.select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), cents.alias("cents"), F.col("l_quantity").cast("long").alias("q"))
    w = W.partitionBy("owner").orderBy("n", "p", "s", "cents", "q")
    return rows.select("owner", F.row_number().over(w).alias("seq"), (F.col("cents") % 1000 / 10.0).alias("x"), (F.col("q") * 10.0).alias("y"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """shape, pts: 32 points a shape, from consecutive pairs of an embedding, in thousandths."""
    e = F.col("embedding")
    pair = lambda i: F.struct(F.rint(F.element_at(e, (2 * i + 1).cast("int")).cast("double") * 1000).cast("long").alias("x"), F.rint(F.element_at(e, (2 * i + 2).cast("int")).cast("double") * 1000).cast("long").alias("y"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("shape"), "label", F.transform(F.sequence(F.lit(0), F.lit(31)), pair).alias("pts"))


def notifications(spark: SparkSession, sf: str) -> DataFrame:
    """seq, ts, type, message."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("type"), F.concat(F.col("event_type"), F.lit(" at line "), (F.col("event_id") % 997).cast("string"), F.lit(" of user "), F.col("user_id").cast("string")).alias("message"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """handle, doc_id, x, y, value of text labels."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("handle"), (k % 16).alias("doc_id"), ((k * 6007) % 10000 / 10.0).alias("x"), ((k * 3571) % 10000 / 10.0).alias("y"), F.col("c_mktsegment").alias("value"))


CTES = {
    "layers": """layers AS (SELECT n_name AS name, (1 + n_nationkey % 7)::INT AS aci, n_regionkey <> 4 AS is_on,
        CASE n_nationkey % 3 WHEN 0 THEN 'Continuous' WHEN 1 THEN 'DASHED' ELSE 'HIDDEN' END AS linetype FROM nation)""",
    "entities": """entities AS (SELECT o_orderkey AS handle, o_custkey % 16 AS doc_id,
        CASE o_orderkey % 7 WHEN 0 THEN 'LINE' WHEN 1 THEN 'CIRCLE' WHEN 2 THEN 'ARC' WHEN 3 THEN 'LWPOLYLINE' WHEN 4 THEN 'TEXT' WHEN 5 THEN 'INSERT' ELSE 'HATCH' END AS type,
        n_name AS layer, CASE o_orderstatus WHEN 'F' THEN 256 WHEN 'O' THEN 3 ELSE 0 END AS aci,
        CASE o_orderkey % 4 WHEN 0 THEN 'BYLAYER' WHEN 1 THEN 'Continuous' WHEN 2 THEN 'DASHED' ELSE ' continuous ' END AS linetype,
        (round(o_totalprice * 100)::BIGINT % 10000) / 10.0::DOUBLE AS x0, ((o_orderkey * 7919) % 10000) / 10.0::DOUBLE AS y0,
        (round(o_totalprice * 100)::BIGINT % 10000) / 10.0::DOUBLE + 1 + o_orderkey % 13 AS x1, ((o_orderkey * 7919) % 10000) / 10.0::DOUBLE + 1 + o_custkey % 11 AS y1
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "blocks": "blocks AS (SELECT p_partkey AS block, p_brand || '_' || p_partkey AS name, 1.0::DOUBLE + p_size AS w, 1.0::DOUBLE + p_partkey % 7 AS h FROM part)",
    "inserts": """inserts AS (SELECT l_orderkey AS owner, l_linenumber AS seq, l_partkey AS block, l_quantity AS tx, floor(l_extendedprice)::DOUBLE AS ty,
        1 + round(l_tax * 100) AS sx, 1 + round(l_discount * 100) AS sy, round(l_discount * 100) AS rot_deg, l_suppkey AS tie FROM lineitem)""",
    "vertices": """vertices AS (SELECT l_orderkey AS owner, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT, l_quantity::BIGINT)::INT AS seq,
        (round(l_extendedprice * 100)::BIGINT % 1000) / 10.0::DOUBLE AS x, l_quantity::BIGINT * 10.0::DOUBLE AS y FROM lineitem)""",
    "points": """points AS (SELECT vec_id AS shape, label, i, round_even(embedding[2 * i + 1]::DOUBLE * 1000, 0)::BIGINT AS x, round_even(embedding[2 * i + 2]::DOUBLE * 1000, 0)::BIGINT AS y
        FROM embeddings, unnest(range(0, 32)) AS r(i))""",
    "notifications": "notifications AS (SELECT event_id AS seq, ts, event_type AS type, event_type || ' at line ' || event_id % 997 || ' of user ' || user_id AS message FROM events)",
    "labels": "labels_ AS (SELECT c_custkey AS handle, c_custkey % 16 AS doc_id, ((c_custkey * 6007) % 10000) / 10.0::DOUBLE AS x, ((c_custkey * 3571) % 10000) / 10.0::DOUBLE AS y, c_mktsegment AS value FROM customer)",
}


def with_(*names: str) -> str:
    """The head of a query over the projections ``names``."""
    return "WITH RECURSIVE " + ", ".join(CTES[n] for n in names)
