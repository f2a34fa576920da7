"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plotweave.plans.durable import Scratch


def _to_least(edges: DataFrame, keep) -> DataFrame:
    """Hang neighbours on the least node around each node; ``edges`` has (u, v), v ranging over u's neighbours.

    The minimum is a partial aggregate and comes back by an equi-join, so a hub of any degree is no hot group.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node that is reachable.

    Large-star and small-star steps alternate until the edges stay as they are, which takes O(log n) rounds on the
    graphs met here. Each round is written to the shared folder, so lineage stays short and a lost executor
    costs one round at most; the table of the round before goes once it stands. Loops only name a node; edges with a null end are left out.
    """
    all_edges = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    own = all_edges.select(F.col("u").alias("node")).union(all_edges.select("v")).distinct()
    scratch = Scratch(edges.sparkSession, "components")
    own = scratch.write(own, "nodes")
    now = scratch.write(all_edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, F.col("v") > F.col("u")).where("u != v").distinct()  # (v, m), m <= u < v
        small = _to_least(large, F.col("v") != F.col("m"))
        heads = large.groupBy("u").agg(F.min("v").alias("v"))
        now = scratch.write(small.union(heads).where("u != v").distinct(), "edges")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    else:
        raise RuntimeError("components have not settled")
    return own.join(now, own["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
