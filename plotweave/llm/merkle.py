"""Merkle manifest of a table: postorder traversal of aligned blocks, in rounds.

The leaves of a group are numbered by id. A block is the subtree over FAN^HEIGHT aligned nodes; one task call walks it
in postorder: the recursion returns a subtree's digest, and while it unwinds the digests of a node's siblings are
appended to the leaves that the node contains. The roots of blocks are the nodes of the next round, until each group
has one root; these are one more group. On the way down each block gets the siblings of its root's path and walks its
nodes again, which completes the proofs of its leaves.

Numbers come from counts of (range partition, group), so no group is numbered in one task, and a task call holds a
block's digests, never texts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plotweave.llm.exact_dedup import ascii_lower
from plotweave.plans.durable import Scratch

FAN = 16  # nodes that share a parent
HEIGHT = 3  # levels of a block, which has FAN^HEIGHT nodes
BATCH = 256  # rows with proofs that are handed to Spark together
_STEP = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` if null, else the number of its UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row: lowercase hex SHA-256 of its fields."""
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def walk(nodes: list[str], height: int, fan: int = FAN) -> tuple[str, list[list[dict[str, str]]]]:
    """The digest of the subtree of ``height`` levels over ``nodes``, and for each node the siblings on its path, lowest first."""
    if height == 0:
        return nodes[0], [[]]
    width = fan ** (height - 1)
    below = [walk(nodes[k : k + width], height - 1, fan) for k in range(0, len(nodes), width)]
    digests, paths = [d for d, _ in below], []
    for k, (_, inner) in enumerate(below):
        beside = {"left": "".join(digests[:k]), "right": "".join(digests[k + 1 :])}
        for path in inner:
            path.append(beside)
        paths += inner
    return digest(digests), paths


def _group(table: pa.Table) -> tuple[list[str], int]:
    """The digests of one block in order, and its height: no more levels than its group needs."""
    size, height, reach = table.column("of")[0].as_py(), 0, 1
    while reach < size and height < HEIGHT:
        height, reach = height + 1, reach * FAN
    return table.column("digest").to_pylist(), height


def _rise(table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    nodes, height = _group(table)
    return pa.table({"part": table.column("part")[:1], "at": table.column("block")[:1], "digest": [walk(nodes, height)[0]]})


def _descend(table: pa.Table, above: pa.Table) -> pa.Table:
    """The nodes of a block with their whole proofs: siblings inside the block, then those of the block's root."""
    table = table.sort_by("at")
    nodes, height = _group(table)
    rest = above.column("proof")[0].as_py()
    out = {c: table.column(c) for c in table.column_names if c not in ("block", "of")}
    out |= {c: pa.repeat(above.column(c)[0], len(nodes)) for c in above.column_names if c not in ("own_part", "place", "proof")}
    paths, kind = walk(nodes, height)[1], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    proofs = [pa.array([path + rest for path in paths[k : k + BATCH]], kind) for k in range(0, len(paths), BATCH)]  # a batch each, as proofs are long
    return pa.table(out | {"proof": pa.chunked_array(proofs, kind)})


def _numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``at``, the place in ``part`` by ``order``, ``of``, the rows of ``part``, and ``block``."""
    dealt = scratch.write(rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order).withColumn("row", F.monotonically_increasing_id()), "dealt")
    dealt = dealt.withColumn("task", F.shiftright("row", 33))  # the numbering of Spark: partitions by 2^33
    counts = dealt.groupBy("part", "task").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low"))
    whole = W.partitionBy("part")
    first = counts.select(F.col("part").alias("own_part"), F.col("task").alias("own_task"), (F.sum("n").over(whole.orderBy("task")) - F.col("n") - F.col("low")).alias("shift"), F.sum("n").over(whole).alias("of"))
    met = F.col("part").eqNullSafe(F.col("own_part")) & (F.col("task") == F.col("own_task"))
    return _in_blocks(dealt.join(first, met).withColumn("at", F.col("row") + F.col("shift")).drop("row", "task", "own_part", "own_task", "shift"))


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / FAN**HEIGHT).cast("long"))


def _tree(leaves: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Tables of nodes (part, at, digest, of, block), from the leaves to one node a part."""
    levels = [leaves]
    while not levels[-1].where("of > 1").isEmpty():
        roots = scratch.write(levels[-1].groupBy("part", "block").applyInArrow(_rise, "part string, at long, digest string"), f"{name}-{len(levels)}")
        sizes = roots.groupBy(F.col("part").alias("own_part")).agg(F.count(F.lit(1)).alias("of"))
        levels.append(_in_blocks(roots.join(sizes, F.col("part").eqNullSafe(F.col("own_part"))).drop("own_part")))
    return levels


def _proved(levels: list[DataFrame], above: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The lowest of ``levels`` with proofs; ``above`` (part, proof, ...) has the siblings from a part's root on, and what its rows get as well."""
    more = [f for f in above.schema if f.name not in ("part", "proof")]
    above = above.withColumn("place", F.lit(0).cast("long"))
    for k in range(len(levels) - 1, -1, -1):
        kept = [f for f in levels[k].schema if f.name not in ("block", "of")]
        schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in [*kept, *more]), f"proof {_STEP}"])
        found = levels[k].groupBy("part", "block").cogroup(above.withColumnRenamed("part", "own_part").groupBy("own_part", "place")).applyInArrow(_descend, schema)
        if k:
            above = scratch.write(found.select("part", F.col("at").alias("place"), "proof", *(f.name for f in more)), f"{name}-above-{k}")
    return found


def manifest(rows: DataFrame) -> DataFrame:
    """part, id, digest, subroot, root, proof of each of the ``rows`` (part string, id long, digest string), with ``extra`` if they have it.

    Rows of a part are ordered by id, null first, then by digest; parts by name, null first, bytewise. Every FAN nodes
    of a part are hashed to one while several remain, which gives its subroot; the subroots likewise give the root.
    proof lists, from the row up to the root, the digests left and right of its node in its run. A single node is its
    own parent, without a step. Repeated rows are leaves of their own. An empty table gives an empty result. ``extra``
    (string) is carried along; other columns are not read.
    """
    scratch = Scratch(rows.sparkSession, "merkle")
    rows = scratch.write(rows.select("part", "id", "digest", *(c for c in rows.columns if c == "extra")), "rows")  # texts are read once
    leaves = scratch.write(_numbered(rows, [c for c in rows.columns if c != "part"], scratch), "leaves")
    scratch.drop("rows")
    inner = _tree(leaves, scratch, "inner")
    tops = scratch.write(_numbered(inner[-1].select(F.lit("").alias("part"), F.col("part").alias("name"), "digest"), ["name"], scratch), "tops")
    scratch.drop("dealt")
    outer = _tree(tops, scratch, "outer")
    top = outer[-1].select("part", F.expr(f"cast(array() as {_STEP})").alias("proof"), F.col("digest").alias("root"))
    ends = scratch.write(_proved(outer, top, scratch, "outer").select(F.col("name").alias("part"), "proof", F.col("digest").alias("subroot"), "root"), "ends")
    return _proved(inner, ends, scratch, "inner").drop("at")


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf digest and its proof lead to."""
    return F.aggregate(proof, start, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]).cast("binary"), 256))


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof, tampered of every row of ``docs``.

    A leaf is the digest of doc_id, source, lang, n_chars and text; null enters as `-`, so it differs from an empty
    text. ``tampered`` is the leaf after a change: where 5 divides the CRC of the id, A-Z of the text are lower-cased;
    elsewhere, without an id, and without a text, it is the leaf itself. Other columns are not read.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    changed = ascii_lower(text)
    own = lambda value: leaf(doc_id, F.col("source"), F.col("lang"), F.col("n_chars"), value)
    rows = docs.select(F.col("source").cast("string").alias("part"), doc_id.alias("id"), own(text).alias("digest"), F.when(hit, own(changed)).alias("extra"))
    return manifest(rows).select(F.col("id").alias("doc_id"), F.col("part").alias("source"), F.col("digest").alias("leaf"), "subroot", "root", "proof", F.coalesce("extra", "digest").alias("tampered"))


def verified(found: DataFrame) -> DataFrame:
    """The rows of document_manifest with a digest of the proof, and what the tampered leaf leads to."""
    siblings = F.concat_ws("", F.transform("proof", lambda s: F.concat(s["left"], s["right"])))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
