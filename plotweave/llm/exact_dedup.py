"""Exact dedup by skew-safe combining, with DataFrame functions alone.

0. Digests are counted, which moves no text; only rows of digests that occur more than once, where there is something
   to compare, go on. They are told by a broadcast of those digests if these are at most BROADCAST, so that rows stay
   where they are; beyond that all rows go on.
1. Rows are deduplicated inside each map task: the partial aggregation on (salt, digest, text), the salt being the
   input partition's number modulo ``salts``.
2. Groups of one salt are merged after a shuffle on (salt, digest, text); a group of copies, however large,
   sends at most one row per map task.
3. The winners of the salts are combined after a shuffle on the digest.

The whole normalised text is a grouping key at every stage, so rows are equal only if their contents are.
The decision comes back to the rows by an equi-join on the hex digest, which carries no text: broadcast within the
same bound, else a join in which neither side is dealt by that key before, so AQE may split the rows of a large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotweave.plans.durable import Scratch

BROADCAST = 500_000  # digests of 32 bytes that are broadcast at most
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text):
    """Lower-case A-Z only. Pure ASCII text takes the fast path, on which both functions agree."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, norm, digest) of every row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("raw")).select("doc_id", ascii_lower(F.col("raw")).alias("norm")).select(
        "doc_id", "norm", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"))


def repeated_digests(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """The digests that occur more than once in ``rows``, and whether they are few enough to be broadcast."""
    found = scratch.write(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "repeated")
    return found, found.count() <= BROADCAST


def salted(rows: DataFrame, salts: int) -> DataFrame:
    """salt, digest, norm, top, n: the copies of each text in the input partitions of a salt, combined in each map task first."""
    own = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return own.groupBy("salt", "digest", "norm").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))


def winners(rows: DataFrame, repeated: DataFrame, few: bool, salts: int = 16) -> DataFrame:
    """(digest, keep_id, group_size, n_texts) of each digest that occurs more than once in ``rows`` (doc_id, norm, digest)."""
    if few:
        rows = rows.join(F.broadcast(repeated), "digest", "left_semi")  # at most BROADCAST digests
    merged = salted(rows, salts).repartition("digest").groupBy("digest", "norm").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    found = merged.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("n_texts"))
    return found.where("group_size > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows whose texts are equal after lower-casing A-Z, the one with the largest id stays; null is the smallest
    id, and keep_id is null where a group has no other. Null and empty texts are equal. A repeated id counts as two
    rows of the group, and both have the same ``kept``, as nothing tells them apart here; keep_exact keeps one.
    Other columns of ``docs`` are not read, so their names can't clash. An empty table gives an empty result.
    Two different texts of one SHA-256 digest stop the query rather than being merged.
    """
    rows = normalised(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "exact")
    repeated, few = repeated_digests(rows, scratch)
    groups = winners(rows, repeated, few, salts).select(
        F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size", F.assert_true(F.col("n_texts") == 1, F.lit("two texts share a SHA-256 digest")).alias("checked"))
    if few:
        groups = F.broadcast(groups)  # a row for each of the repeated digests
    found = rows.select("doc_id", F.lower(F.hex("digest")).alias("text_sha256")).join(groups, "text_sha256", "left").where(F.col("checked").isNull())
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep_id.alias("keep_id"), F.when(alone, 1).otherwise(F.col("group_size")).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def one_each(docs: DataFrame, id_col: str, key: Column, decided: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` that are decided to stay, with their columns.

    ``decided`` has doc_id, key, kept, n: rows of one id (null is an id) and ``key`` stay or go; n is how many there
    are, of which one stays. Pairs that it doesn't list stay. Only rows of repeated pairs are read a second time. Pairs
    that go are told by a broadcast if they are at most BROADCAST; else ``docs`` is shuffled with its texts.
    """
    odd = Scratch(docs.sparkSession, name).write(decided.where("not kept or n > 1").select(F.col("doc_id").alias("__odd_id"), F.col("key").alias("__odd_key"), "kept"), "decided")
    keyed = docs.withColumns({"__own_id": F.col(id_col).cast("long"), "__own_key": key})
    met = F.col("__own_id").eqNullSafe(F.col("__odd_id")) & (F.col("__own_key") == F.col("__odd_key"))
    near = F.broadcast if odd.count() <= BROADCAST else lambda side: side  # so that texts stay where they are
    out = keyed.join(near(odd.drop("kept")), met, "left_anti")
    again = odd.where("kept").drop("kept")
    if not again.isEmpty():
        out = out.union(keyed.join(near(again), met, "left_semi").dropDuplicates(["__own_id", "__own_key"]))
    return out.drop("__own_id", "__own_key")


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each text that differs after lower-casing A-Z, with its columns: that of the largest id.

    Null is the smallest id, so a row without an id stays only if no row with one has its text. Of rows of one id and
    equal text any one stays. Rows of one id and different texts are decided apart.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))
    decided = exact_dedup(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    return one_each(docs, id_col, digest, decided.withColumn("key", F.unhex("text_sha256")), "exact")
