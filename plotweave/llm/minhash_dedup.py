"""Near-duplicate documents by ProbMinHash, banding and verification.

Links are defined by the Jaccard similarity of sets of shingles, so each distinct shingle of five lower-cased words
weighs 1, however often a document repeats it. Each is a Poisson process of that rate whose arrivals fall on random
slots; the first arrival at a slot wins it, so two documents agree in a slot with the probability Jaccard similarity
of their shingles (Ertl, 2019), which at equal weights is that of the sets. A process ends once it is later than all
slots of its document. Documents that agree in a band of slots are compared by the same similarity.

Bands are drawn from the slots by several permutations, so a slot serves in more than one and bands can be long: few
documents of low similarity meet. Buckets may be of any size. Documents of one word sequence are one node.

1. Each node meets one other, the node of most company among those of its buckets, which is the source in a group of
   near copies, so a group costs a comparison a node, whatever its size. What links is contracted.
2. In buckets that hold several components, nodes outside the component of the bucket's head meet the head.
3. Nodes that are still apart meet all nodes of other components in their buckets. A bucket is compared in blocks:
   first the sketches, then the shingles of the nodes whose sketches admit a link. A block returns only links that
   join components, so pairs never become rows.

So no link between components is lost to the size of a bucket. A pair is compared in full only if a byte of each slot,
and the numbers of shingles, admit the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plotweave.llm.arrow_text import chunks, give_back
from plotweave.llm.exact_dedup import one_each
from plotweave.operators.graph import connected_components
from plotweave.plans.durable import Scratch

WORDS = 5
THRESHOLD = 0.8
SLOTS, BANDS, ROWS = 96, 48, 6  # at similarity 0.8 a pair shares no band with probability 6e-5 (simulated), at 0.4 with 0.83
SLACK = 0.16  # by which agreement of slots may fall short of the threshold: four standard deviations
BLOCK = 1024  # nodes of a bucket that are compared with as many at once
CELL = 8_000  # rows of blocks that are handed to a Python worker together
ELEMENTS = 400_000  # shingles, about, that a side of a block holds, and that a Python worker gets together
BROADCAST = 200_000  # nodes whose rows are looked up by a broadcast, of about 100 bytes each; more are looked up by a shuffle of all texts
KNOWN = 200_000  # words whose hashes a Python worker remembers
CHUNK = 1_000_000

_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_known: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def _word(word: str) -> int:
    if len(_known) > KNOWN:
        _known.clear()
    out = _known[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return out


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, rising, and their counts; one of all words if there are fewer than five."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    get = _known.get
    codes = np.array([get(w) or _word(w) for w in words], np.uint64)
    if len(codes) < WORDS:
        codes = np.concatenate([codes, np.full(WORDS - len(codes), len(codes), np.uint64)])
    n = len(codes) - WORDS + 1
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            total = _mix(total * _GOLD + codes[k : k + n])
    return np.unique(total, return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """(n, slots): the element that reaches each slot of each owner first; zeros for owners without elements."""
    first = np.full(n * slots, np.inf)
    winner = np.zeros(n * slots, np.uint64)
    time, live, step = np.zeros(len(elements)), np.arange(len(elements)), 0
    latest = np.full(n, np.inf)
    while len(live):
        step += 1
        with np.errstate(over="ignore"):
            draw = _mix(elements[live] + np.uint64(step) * _GOLD)
            slot = (_mix(draw ^ _B) >> np.uint64(11)) % np.uint64(slots)
        time[live] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[live]
        early = time[live] < latest[owner[live]]
        live, slot = live[early], slot[early]
        at = owner[live] * slots + slot.astype(np.int64)
        np.minimum.at(first, at, time[live])
        won = first[at] == time[live]
        winner[at[won]] = elements[live[won]]
        latest = first.reshape(n, slots).max(1)
        live = live[time[live] < latest[owner[live]]]
    return winner.reshape(n, slots)


def _band_slots() -> np.ndarray:
    """(BANDS, ROWS): the slots of each band, cut from permutations of all slots."""
    draw, each = np.random.Generator(np.random.PCG64(11)), SLOTS // ROWS
    return np.concatenate([draw.permutation(SLOTS)[: each * ROWS].reshape(each, ROWS) for _ in range(-(-BANDS // each))])[:BANDS]


_OF_BAND = _band_slots()


def bands(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            out = _mix(out * _GOLD + signature[:, _OF_BAND[:, r]])
        out = _mix(out + np.arange(BANDS, dtype=np.uint64) * _GOLD)
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", CHUNK):
        texts = batch.column("text").to_pylist()
        found = [shingles(t) for t in texts]
        sizes = np.array([len(f[0]) for f in found])
        elements = np.concatenate([f[0] for f in found])
        signature = signatures(elements, np.ones(len(elements)), np.repeat(np.arange(len(found)), sizes), len(found))
        keys, sketch = bands(signature), (signature >> np.uint64(40)).astype(np.uint8).view(np.int8)
        digest = [blake2b(" ".join((t or "").lower().split()).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel()))
        bytes_ = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * SLOTS, pa.array(sketch.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(digest, pa.binary()), pa.array(sizes), lists, bytes_], ["doc_id", "key", "digest", "size", "keys", "sketch"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", CHUNK):
        found = [shingles(t)[0].view(np.int64) for t in batch.column("text").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))], ["node", "shingles"])


def jaccard(x, y):
    """Jaccard similarity of two columns of arrays with distinct elements."""
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def _admitted(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches admit ``threshold``; nodes has (node, size, sketch)."""
    side = lambda end, p: nodes.select(F.col("node").alias(end), F.col("size").alias(f"{p}_size"), F.col("sketch").alias(f"{p}_sketch"))
    near = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    agree = F.aggregate(F.zip_with("x_sketch", "y_sketch", lambda p, q: (p == q).cast("int")), F.lit(0), lambda t, v: t + v) / float(SLOTS)
    admits = (F.least("x_size", "y_size") >= F.greatest("x_size", "y_size") * threshold) & (agree >= threshold - SLACK)
    return near.where(admits).select("a", "b").distinct()


def _sets(asked: DataFrame, docs: DataFrame, heads: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, shingles) of the nodes ``asked``; heads name the row (head_id, head_key) of ``docs`` whose text stands for a node."""
    asked = scratch.write(heads.join(asked, "node").select("node", "head_id", "head_key"), f"{name}-asked")
    if asked.count() <= BROADCAST:
        asked = F.broadcast(asked)  # so that texts stay where they are
    theirs = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("key") == F.col("head_key"))).select("node", "text")
    sets = scratch.write(theirs.mapInArrow(_shingled, "node long, shingles array<long>"), f"{name}-sets")
    scratch.drop(f"{name}-asked")
    if not sets.groupBy("node").count().where("count > 1").isEmpty():  # whole repeated rows
        sets = sets.dropDuplicates(["node"])
    return sets


def _verified(near: DataFrame, docs: DataFrame, heads: DataFrame, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach ``threshold``."""
    sets = _sets(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), docs, heads, scratch, name)
    both = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    out = scratch.write(both.where(jaccard(F.col("x"), F.col("y")) >= threshold).select("a", "b").distinct(), name)
    scratch.drop(f"{name}-sets")
    return out


def _blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each block of a table: those that ask, and those that are asked."""
    keys = [table.column(c).to_numpy() for c in ("bucket", "i", "j")]
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    for block in np.split(order, np.flatnonzero(new)):
        yield block[asks[block]], block[~asks[block]]


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    node, home, size = (table.column(c).to_numpy() for c in ("node", "home", "size"))
    return node, home, size, table.column("sketch").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), SLOTS)


def _admits(r: np.ndarray, other: np.ndarray, home: np.ndarray, size: np.ndarray, sketch: np.ndarray, threshold: float) -> np.ndarray:
    """(r, other): rows of different components whose sizes and sketches admit the threshold."""
    good = (sketch[r][:, None] == sketch[other][None]).sum(2, dtype=np.int16) >= (threshold - SLACK) * SLOTS
    good &= home[r][:, None] != home[other][None]
    return good & (np.minimum(size[r][:, None], size[other][None]) >= threshold * np.maximum(size[r][:, None], size[other][None]))


def _met(threshold: float):
    def meet(table: pa.Table) -> pa.Table:
        """The rows that have a partner on the other side of their block which the sketches admit."""
        columns, hit = _columns(table)[1:], np.zeros(table.num_rows, bool)
        for rest, other in _blocks(table):
            for at in range(0, len(rest), 32):
                r = rest[at : at + 32]
                good = _admits(r, other, *columns, threshold)
                hit[r] = good.any(1)
                hit[other] |= good.any(0)
        return table.filter(pa.array(hit))

    return meet


def _joining(threshold: float):
    def join(table: pa.Table) -> pa.Table:
        """Links by shingle sets; in a block, those between components that others have joined are left out."""
        node, *columns = _columns(table)
        home = columns[0]
        lists = table.column("shingles").combine_chunks()
        values, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        root: dict[int, int] = {}
        links: list[tuple[int, int]] = []

        def top(h: int) -> int:
            while root.get(h, h) != h:
                h = root[h]
            return h

        for rest, other in _blocks(table):
            root.clear()
            here = np.concatenate([rest, other])
            n = lengths[here]
            end = np.cumsum(n)
            begin = end - n
            _, flat = np.unique(np.concatenate([values[starts[k] : starts[k] + lengths[k]] for k in here]), return_inverse=True)
            mark = np.zeros(flat.max(initial=-1) + 1, bool)
            for at in range(0, len(rest), 32):
                good = _admits(rest[at : at + 32], other, *columns, threshold)
                for k in np.flatnonzero(good.any(1)):
                    x, met = at + k, np.flatnonzero(good[k])
                    y = len(rest) + met
                    mark[flat[begin[x] : end[x]]] = True
                    stop = np.cumsum(n[y])
                    shared = np.cumsum(mark[flat[np.repeat(begin[y] - stop + n[y], n[y]) + np.arange(stop[-1])]])
                    both = np.diff(shared[stop - 1], prepend=0)
                    mark[flat[begin[x] : end[x]]] = False
                    a = rest[x]
                    for b in other[met[both / (n[x] + n[y] - both) >= threshold]].tolist():
                        p, q = top(int(home[a])), top(int(home[b]))
                        if p != q:
                            root[p] = q
                            links.append((min(node[a], node[b]), max(node[a], node[b])))
        pairs = np.array(links, np.int64).reshape(-1, 2)
        give_back()
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return join


def _rest_links(live: DataFrame, nodes: DataFrame, rows: DataFrame, heads: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Links of nodes outside the component of their bucket's head with the bucket's nodes of other components.

    A bucket is cut into blocks on both sides, of BLOCK nodes or, where texts are long, of about ELEMENTS shingles. A
    pair of blocks is compared in one task, so no bucket is ever together in one. Workers get pairs of blocks by rows
    while sketches are compared, and by shingles afterwards.
    """
    apart = F.col("home") != F.col("head_home")
    sized = live.join(nodes.select("node", "size", "sketch"), "node")
    step = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(ELEMENTS / F.avg("size"))))
    counts = sized.groupBy("bucket").agg(F.count_if(apart).alias("n_rest"), F.count(F.lit(1)).alias("n"), step.alias("step"))
    cut = lambda n: F.ceil(F.col(n) / F.col("step")).cast("int")
    counts = scratch.write(counts.withColumns({"rests": cut("n_rest"), "all": cut("n")}), "counts")
    cells = 1 + (counts.agg(F.sum(F.expr("n_rest * all + n * rests"))).first()[0] or 0) // CELL
    every = sized.join(counts.select("bucket", "rests", "all"), "bucket")
    of = lambda n: F.pmod(F.xxhash64("node", "bucket"), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = every.where(apart).select("bucket", of("rests").alias("i"), copies("all").alias("j"), F.lit(True).alias("asks"), "node", "home", "size", "sketch")
    asked = every.select("bucket", copies("rests").alias("i"), of("all").alias("j"), F.lit(False).alias("asks"), "node", "home", "size", "sketch")
    cell = lambda n: F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(n))
    dealt = asking.union(asked).withColumn("cell", cell(cells))
    met = scratch.write(dealt.groupBy("cell").applyInArrow(_met(threshold), dealt.schema), "met")
    sets = _sets(met.select("node").distinct(), rows, heads, scratch, "rest")
    loads = 1 + (met.agg(F.sum("size")).first()[0] or 0) // ELEMENTS
    return met.withColumn("cell", cell(loads)).join(sets, "node").groupBy("cell").applyInArrow(_joining(threshold), "a long, b long").distinct()


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _live(member: DataFrame, joined: DataFrame | None, scratch: Scratch) -> DataFrame:
    """bucket, node, home, head, head_home of the rows of buckets that hold several components."""
    own = F.col("node") if joined is None else F.coalesce("component", "node")
    rows = (member if joined is None else member.join(joined, "node", "left")).select("bucket", "node", "weight", own.alias("home"))
    top = F.max(F.struct("weight", F.xxhash64("node"), "node", "home")).alias("top")
    mixed = rows.groupBy("bucket").agg(top, F.min("home").alias("low"), F.max("home").alias("high")).where("low < high")
    found = rows.join(mixed, "bucket").select("bucket", "node", "weight", "home", F.col("top.weight").alias("head_weight"), F.col("top.node").alias("head"), F.col("top.home").alias("head_home"))
    return scratch.write(found, "live")


def _linked(member: DataFrame, nodes: DataFrame, rows: DataFrame, heads: DataFrame, threshold: float, scratch: Scratch) -> DataFrame | None:
    """(node, component) of the nodes that have a link."""
    links = joined = tried = None
    for step in ("source", "head", "rest"):
        live = _live(member, joined, scratch)
        if step == "source":
            chosen = live.where("node != head").groupBy("node").agg(F.max(F.struct("head_weight", F.xxhash64("head"), "head")).alias("top"))
            tried = scratch.write(_admitted(chosen.select(*_ordered("node", "top.head")).distinct(), nodes, threshold), "tried")
            found = _verified(tried, rows, heads, threshold, scratch, step)
        elif step == "head":
            pairs = live.where("home != head_home").select(*_ordered("node", "head")).distinct().join(tried, ["a", "b"], "left_anti")
            found = _verified(scratch.write(_admitted(pairs, nodes, threshold), "pairs"), rows, heads, threshold, scratch, step)
        else:
            found = scratch.write(_rest_links(live, nodes, rows, heads, threshold, scratch), step)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            joined = connected_components(links, "a", "b")
    return joined


def _decided(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """doc_id, key, has, class_id, kept, stays of every row: the digest of its text, whether it has words, its class,
    whether it has the id and words that are kept, and whether it has their very text."""
    scratch = Scratch(docs.sparkSession, "minhash")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    signed = scratch.write(rows.mapInArrow(_signed, "doc_id long, key binary, digest binary, size long, keys array<long>, sketch array<tinyint>"), "signed").withColumn("has", F.col("size") > 0)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("head")
    heads = signed.where("has").groupBy("digest").agg(least).select("digest", F.col("head.doc_id").alias("head_id"), F.col("head.key").alias("head_key"))
    heads = scratch.write(heads.withColumn("node", F.monotonically_increasing_id()), "heads")  # written, so a node keeps its number
    chosen = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("key") == F.col("head_key"))
    nodes = scratch.write(signed.where("has").join(heads, "digest").where(chosen).select("node", "size", "keys", "sketch").distinct(), "nodes")
    member = nodes.select("node", F.explode("keys").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = scratch.write(member.join(sizes, "bucket"), "member")
    weights = member.groupBy("node").agg(F.sum("size").alias("weight"))
    member = scratch.write(member.drop("size").join(weights, "node"), "member")
    joined = _linked(member, nodes, rows, heads, threshold, scratch)
    if joined is None:
        joined = nodes.select("node", F.col("node").alias("component")).limit(0)
    grouped = scratch.write(heads.join(joined, "node", "left").select("digest", "head_id", "head_key", F.coalesce("component", "node").alias("component")), "grouped")
    least = F.min(F.struct(F.col("head_id").isNull().alias("none"), "head_id", "digest", "head_key")).alias("best")
    classes = grouped.select("digest", "component").join(grouped.groupBy("component").agg(least), "component").select("digest", "best")
    own = F.col("doc_id").eqNullSafe(F.col("best.head_id")) & (F.col("digest") == F.col("best.digest"))
    found = signed.where("has").join(classes, "digest").select("doc_id", "key", "has", F.col("best.head_id").alias("class_id"), own.alias("kept"), (own & (F.col("key") == F.col("best.head_key"))).alias("stays"))
    return found.union(signed.where("not has").select("doc_id", "key", "has", F.col("doc_id").alias("class_id"), F.lit(True), F.lit(True)))


def text_key(text: Column) -> Column:
    """The digest that tells the texts of one id apart."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, kept of every row of ``docs``.

    class_id is the smallest doc_id of the documents that are joined by links, of similarity ``threshold`` or more;
    null is the largest id, so class_id is null only where no document of the class has one. kept marks the rows of
    that id; if their words differ, those of the least digest. Texts of the same words (case and white space aside)
    are one class. Null texts and texts without a word link with nothing. Different texts of one id, or of none, are
    documents of their own.
    Other columns are not read. An empty table gives an empty result.
    """
    return _decided(docs, id_col, text_col, threshold).select("doc_id", "class_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each near-duplicate class, with its columns: that of the smallest id, null being the largest.

    Of rows of one id in a class one stays. Rows without a word all stay.
    """
    n = F.count_if("has").alias("n")
    decided = _decided(docs, id_col, text_col, THRESHOLD).groupBy("doc_id", "key").agg(F.first("stays").alias("kept"), n)
    return one_each(docs, id_col, text_key(F.col(text_col).cast("string")), decided, "near")
