"""Runs of repeated words: Karp-Miller-Rosenberg naming and extended grid candidates, in numpy.

Words of a document are named; the name of a window of 2^(l+1) words is the rank of the pair of names of its halves
(Karp, Miller and Rosenberg, 1972). A window that its document holds once needs no rank: it gets a negative name of
its own, and windows that contain it are never ranked. How far two places agree, forwards or backwards, follows from
comparing names from the longest windows down.

A run of period q is at least 4q words long, so it contains a multiple x of 2q, counted from the document's start,
with q + 1 more words of x and of x + q in the run. Places x and x + q whose windows of the largest power of two up to
q + 1 have one name are candidates, and are extended in both directions. The candidates of all q of one window length
are built together, about a third of a place a word, so no period is looped over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotweave.llm.arrow_text import chunks

REPEATS = 4  # periods that a run has at least
SHORTEST = 6  # words that a run has at least
CHUNK = 1_000_000  # bytes of text that are named together
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def name_levels(first: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4, ... words at each place, until no window occurs twice in its document.

    ``first`` names words so that equal names mean the same word of the same document; ``ends`` is where the document
    of each place ends. A window that is unique or crosses an end is named by its place, negatively. Each level has
    one more entry, which stands for places outside.
    """
    n = len(first)
    alone = -1 - np.arange(n + 1, dtype=np.int64)
    levels, at, keys, width = [], np.arange(n), first, 1
    while len(at):
        if width == 1:
            counts, rank = np.bincount(keys), keys
        else:
            _, rank, counts = np.unique(keys, return_inverse=True, return_counts=True)
        often = counts[rank] > 1
        at = at[often]
        if not len(at):
            break
        names = alone.copy()
        names[at] = rank[often]
        levels.append(names)
        at = at[at + 2 * width <= ends[at]]
        at = at[names[at + width] >= 0]
        keys = names[at] * (n + 1) + names[at + width]
        width *= 2
    return levels


def agreement(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, backwards: bool = False) -> np.ndarray:
    """How many words from ``x`` and ``y`` on, or before them, are the same; by window names, longest windows first.

    No window of twice the top level's words occurs twice, so one pass down the levels is enough.
    """
    n = len(levels[0]) - 1
    off = np.zeros(len(x), np.int64)
    for l in range(len(levels) - 1, -1, -1):
        names, width = levels[l], 1 << l
        i, j = (x - off - width, y - off - width) if backwards else (x + off, y + off)
        same = names[np.where(i < 0, n, np.minimum(i, n))] == names[np.where(j < 0, n, np.minimum(j, n))]
        off[same & (i >= 0)] += width
    return off


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, counts[i] times: i, and 0 to counts[i] - 1."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def candidates(level: np.ndarray, l: int, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, x, q) for the grid places x of all q with 2^l <= q + 1 < 2^(l+1) whose windows at x and x + q agree."""
    least, most = (1 << l) - 1, (1 << (l + 1)) - 2
    docs = np.flatnonzero(sizes >= np.maximum(SHORTEST, REPEATS * max(least, 1)))
    own, k = _spread(np.maximum(np.minimum(most, sizes[docs] // REPEATS) - least + 1, 0))
    doc, q = docs[own], least + k
    fit = q > 0
    doc, q = doc[fit], q[fit]
    own, k = _spread((sizes[doc] - 2 * q - 1) // (2 * q) + 1)
    doc, q = doc[own], q[own]
    x = starts[doc] + 2 * q * k
    hit = level[x] == level[x + q]
    return doc[hit], x[hit], q[hit]


def runs_of(first: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start, period; starts count from the document's."""
    starts, sizes = offsets[:-1], np.diff(offsets)
    levels = name_levels(first, np.repeat(offsets[1:], sizes))
    found = [np.zeros((0, 4), np.int64)]
    for l in range(1, len(levels)):
        doc, x, q = candidates(levels[l], l, starts, sizes)
        if not len(doc):
            continue
        before, after = agreement(levels, x, x + q, backwards=True), agreement(levels, x, x + q)
        length = before + q + after
        good = length >= np.maximum(SHORTEST, REPEATS * q)
        found.append(np.unique(np.stack([doc, x - before, length, q], axis=1)[good], axis=0))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    first_of = np.ones(len(runs), bool)  # a stretch has the multiples of its smallest period as well
    first_of[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    runs = runs[first_of]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    return runs[:, 0], runs[:, 1] - starts[runs[:, 0]], runs[:, 2], runs[:, 3]


def _named(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, the names of all of them, and the offsets of texts among them."""
    words, names, base = [t.split() for t in texts], [], 0
    for own in words:
        seen: dict[bytes, int] = {}
        names.append(np.array([seen.setdefault(w, len(seen)) for w in own], np.int64) + base)
        base += len(seen)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return words, np.concatenate(names) if names else np.zeros(0, np.int64), offsets


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", CHUNK):
        words, names, offsets = _named([t or b"" for t in batch.column("text").to_pylist()])
        doc, start, length, period = runs_of(names, offsets)
        kept = np.ones(offsets[-1], bool)
        for d, s, n, q in zip(doc, start, length, period):
            kept[offsets[d] + s + q : offsets[d] + s + n] = False
        whole = np.bincount(doc, minlength=len(words)) == 0
        texts = [b" ".join(w if whole[d] else [x for x, k in zip(w, kept[offsets[d] : offsets[d + 1]].tolist()) if k]) for d, w in enumerate(words)]
        at = np.searchsorted(doc, np.arange(len(words) + 1)).astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(at, struct), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed of every row of ``docs``.

    Words are what stands between blanks, tabs, line breaks, vertical tabs and form feeds. A run is a stretch of words
    with smallest period q and length max(6, 4q) or more that no neighbouring word extends. ``collapsed`` joins, by one
    blank, the words that no run contains after its first q words.
    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows are judged one by one, so null and
    repeated ids, repeated rows and ties need no rule, and an empty table gives an empty result. Other columns are not read. A
    text is worked on whole, so a very long one takes memory of about 100 bytes a word.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_found, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text, where every tenth document, by the CRC of its id, is periodic from one of its words on; a null id has none.

    Done by DataFrame functions, so that the search for runs is the only step for which texts go to Python.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    rows = rows.withColumn("n", F.expr("nullif(size(words), 0)")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("int(g % n)")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    periodic = "slice(flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p)))), 1, n - a)"
    return rows.select("doc_id", F.expr(f"CASE WHEN size(words) > 0 THEN concat_ws(' ', slice(words, 1, a), {periodic}) ELSE text END").alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The result of find_runs with the longest run (ties: smallest start, then period) and digests for runs and words."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    listed = F.concat_ws("", F.transform("runs", line))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "runs", "collapsed", best.alias("best")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("best.length * 1000 div -best.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
