"""What a document's header reaches: closure over handle references, and paths through its dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plotweave.plans.durable import Scratch


def reachable(roots: DataFrame, objects: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, handle, depth) of the objects that the roots reach, and (doc, handle, n) of the handles that lead nowhere.

    ``roots`` has doc, handle; ``objects`` doc, handle of all that exist; ``references`` doc, src, dst. A round follows
    the references of the objects that the round before found first; each is a written table, and objects are visited
    once, so cycles end. Null and zero handles refer to nothing. ``n`` counts the references, and roots, to a missing handle.
    """
    scratch = Scratch(objects.sparkSession, "closure")
    there = objects.select("doc", "handle").distinct()
    refs = references.where("dst is not null and dst <> 0").select("doc", F.col("src").alias("handle"), "dst")
    asked = scratch.write(roots.where("handle is not null and handle <> 0").select("doc", "handle"), "asked-0")
    missing = asked.join(there, ["doc", "handle"], "left_anti")
    now = scratch.write(asked.distinct().join(there, ["doc", "handle"], "left_semi").withColumn("depth", F.lit(0)), "depth-0")
    seen, depth = now, 0
    while not now.isEmpty():
        depth += 1
        ends = now.select("doc", "handle").join(refs, ["doc", "handle"]).select("doc", F.col("dst").alias("handle"))
        missing = missing.union(ends.join(there, ["doc", "handle"], "left_anti"))
        fresh = ends.distinct().join(there, ["doc", "handle"], "left_semi").join(seen.select("doc", "handle"), ["doc", "handle"], "left_anti")
        now = scratch.write(fresh.withColumn("depth", F.lit(depth)), f"depth-{depth}")
        seen = seen.union(now)
    return seen, missing.groupBy("doc", "handle").agg(F.count(F.lit(1)).alias("n"))


def dictionary_paths(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """doc, path, handle: every entry that the root dictionaries lead to, its path being the names on the way, joined by `/`.

    ``roots`` has doc, handle; ``entries`` doc, handle (of the dictionary), name, target. A dictionary that is on the way
    already is not entered again.
    """
    scratch = Scratch(entries.sparkSession, "paths")
    e = entries.select("doc", "handle", "name", "target")
    now = scratch.write(roots.select("doc", F.lit("").alias("path"), F.col("handle"), F.array("handle").alias("way")), "level-0")
    out, level = None, 0
    while not now.isEmpty():
        level += 1
        joined = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("/"), F.col("name")))
        met = now.join(e, ["doc", "handle"]).where("target is not null")
        step = met.select("doc", joined.alias("path"), F.col("target").alias("handle"), F.array_contains("way", F.col("target")).alias("again"), F.concat("way", F.array("target")).alias("way"))
        found = scratch.write(step, f"level-{level}")
        out = found if out is None else out.union(found)
        now = found.where("not again").drop("again")
    out = out if out is not None else now.withColumn("again", F.lit(False))
    return out.select("doc", "path", "handle")


def lookup(roots: DataFrame, entries: DataFrame, path: str) -> DataFrame:
    """doc, handle of the object at a path; names are compared without regard to case."""
    now = roots.select("doc", "handle")
    for name in path.split("/"):
        step = entries.where(F.lower("name") == name.lower()).select("doc", "handle", "target")
        now = now.join(step, ["doc", "handle"]).select("doc", F.col("target").alias("handle"))
    return now
