"""Packing against the tokenizer's own ids, and differencing against a plain form."""

import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plotweave.llm import packing


def plain_differencing(sizes, k):
    """Karmarkar-Karp on whole tuples with their sets of items."""
    heap = [(-s, i, [s] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    name = len(sizes)
    while len(heap) > 1:
        _, _, x, p = heapq.heappop(heap)
        _, _, y, q = heapq.heappop(heap)
        both = sorted(zip([a + b for a, b in zip(x, y[::-1])], [a + b for a, b in zip(p, q[::-1])]), key=lambda z: -z[0])
        sums = [s - both[-1][0] for s, _ in both]
        heapq.heappush(heap, (-sums[0], name, sums, [i for _, i in both]))
        name += 1
    return heap[0][3]


def test_differencing_equals_plain_form():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randrange(1, 500) for _ in range(rng.randrange(1, 60))]
        k = rng.randrange(1, 12)
        got = packing.differencing(np.array(sizes), k)
        sums = sorted(np.bincount(got, weights=sizes, minlength=k).astype(int).tolist())
        want = sorted(sum(sizes[i] for i in bin) for bin in plain_differencing(sizes, k))
        assert max(sums) - min(sums) <= max(max(sizes), 1) and sum(sums) == sum(sizes)
        assert sums == want


def test_count_rises_with_capacity():
    window, k = packing.windows_of(np.array([60, 60, 60]), 100)
    assert k == 3 and sorted(window.tolist()) == [0, 1, 2]


def test_small_rests_do_not_grow_large_items():
    packer = packing._Packer(0, 4096, 256)
    for k in range(400):
        packer.add(k, np.zeros(4095 if k % 2 else 30, np.uint32))
    packer.finish()
    filled = {}
    for piece in packer.out:
        filled[piece[4]] = filled.get(piece[4], 0) + len(piece[2])
    assert max(filled.values()) <= 4096 and sum(filled.values()) == 200 * 4125


def corpus():
    rng = random.Random(3)
    vocabulary = ["the", "Window's", "naïve", "été", "ÀB", "x1y22", "don't", "...!?", "日本語", "<|endoftext|>", "a b", "́x", "ΑΣ", "\x1c", "İ"]
    out = [None, "", " ", "  two  blanks ", "tab\tand\nline\r\nbreak", "a" * 3000, "word " * 9000, "a"]
    return out + [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 200, 900, 6000]))) for _ in range(80)]


@pytest.mark.parametrize(("window", "block"), [(4096, 256), (256, 4)])
def test_pieces_hold_all_ids(spark, window, block):
    texts = corpus()
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "no id", 1), (7, "other text of one id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(3)
    pieces = packing.pack(docs, window=window, block=block).persist()
    got = pieces.collect()
    model = Tokenizer.from_file(packing.MODEL)
    ids = lambda t: model.encode(t or "", add_special_tokens=False).ids + [2]
    by_doc, by_window = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        if i == 7:
            continue
        mine = sorted(by_doc[i], key=lambda r: r["start"])
        assert [r["start"] for r in mine] == np.cumsum([0] + [r["length"] for r in mine])[:-1].tolist()
        assert np.frombuffer(b"".join(r["ids"] for r in mine), "<u4").tolist() == ids(t)
        assert {r["doc_tokens"] for r in mine} == {len(ids(t))}
    assert sorted(r["doc_tokens"] for r in by_doc[7] if r["start"] == 0) == sorted([len(ids("a")), len(ids(rows[-1][1]))])
    assert len([r for r in by_doc[None] if r["start"] == 0]) == 1
    for rows_ in by_window.values():
        rows_.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows_] == np.cumsum([0] + [r["length"] for r in rows_])[:-1].tolist()
        assert sum(r["length"] for r in rows_) <= window
    pad = packing.padding(pieces, window).first()
    assert pad["n_tokens"] == sum(r["length"] for r in got) and pad["n_padding"] <= (0.006 if window == 4096 else 0.09) * pad["n_tokens"]
    for r in packing.digests(pieces).join(pieces.select("sequence_id", "offset", "ids"), ["sequence_id", "offset"]).collect():
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
    pieces.unpersist()


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0
    ties = spark.createDataFrame([(i, "same words here") for i in range(500)] + [(i, None) for i in range(500, 3000)], "doc_id long, text string").coalesce(1)
    pieces = packing.pack(ties)
    pad = packing.padding(pieces).first()
    assert pad["n_tokens"] == 500 * 4 + 2500 and pad["n_padding"] <= packing.SLACK * 2


def test_texts_are_cut_into_pieces_that_are_known_once():
    """All characters after each kind of another; a stem with other marks beside it is not a string of its own."""
    cut = re.compile(r"[^\W\d_]+|\d|(?:[^\w \n\t]|_)+[^\W\d_]*").findall
    rng = random.Random(6)
    kinds = ["a", "É", "日", "²", "½", "7", "٣", "_", "-", "é", "̈", " ", "\n", "\t", "\r", "\x1c", "\xa0", "😀", " ", "ª"]
    texts = ["", " ", "a", "", *("".join(rng.choice(kinds) for _ in range(n)) for n in range(90)), "", "".join(chr(c) + "x " for c in range(0x11000) if not 0xD800 <= c < 0xE000), "9"]
    pieces, per = packing._cut(pa.array(texts, pa.large_string()))
    pieces = pieces.to_pylist()
    assert [pieces[a:b] for a, b in zip(per[:-1], per[1:])] == [cut(t) for t in texts]
    words = packing.Words(packing.MODEL)
    texts = ["Haus, haus. (HAUS) haus!", "haus- über ÜBER, 12 1.2", ""]
    ids, ends = words.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [words.model.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(words.known) == sorted({p for t in texts for p in cut(t.lower())})


def test_long_merges_equal_plain_form():
    rng = random.Random(8)
    for k in (1, 2, 5, 40):
        sizes = [rng.choice([8, 64, 64, rng.randrange(1, 4000)]) for _ in range(300)]
        got = np.bincount(packing.differencing(np.array(sizes), k), weights=sizes, minlength=k)
        assert sorted(got.astype(int).tolist()) == sorted(sum(sizes[i] for i in own) for own in plain_differencing(sizes, k))
