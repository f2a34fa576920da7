"""Packing of documents into windows of equal size by Karmarkar-Karp multiway differencing.

Documents become token ids by a public tokenizer and an end mark. What fills whole windows is cut off first. The rest
is gathered into blocks of BLOCK windows. Each rest is an item; only the end of a block is cut into smaller items
(FINE), which level the windows once the others are placed. Each item begins as a partial partition: it alone in one
of k windows. The two partitions with the largest imbalance are merged, the fullest window
of one with the emptiest of the other, until one partition is left, whose windows are nearly equal. Whenever a window
exceeds the capacity the number of windows rises and the block is partitioned anew.

A block is closed SLACK tokens a window short of full, which is what the windows may differ by. The end of a Spark
partition seldom fills its last window; its tokens go to windows of powers of two, which need no padding.

Blocks form inside a Spark partition, from consecutive documents, so nothing is shuffled and a task holds one block.
"""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
from bisect import bisect_left, bisect_right
from codecs import charmap_decode
from collections.abc import Collection, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plotweave.llm.arrow_text import chunks, utf8

MODEL = "/opt/tokenizers/word_bpe_49k.json"
WINDOW = 4096
END = 2  # the id that closes a document
BLOCK = 256  # windows of a block
FINE = ((64, 32, 4), (8, 256, 1))  # (tokens of an item, a block's share that is cut so is one in so many, windows at least)
SLACK = 16  # tokens a window that stay free in a block
CHUNK = 4_000_000  # bytes of text that are worked on together
PART = 1 << 16  # characters that are looked up at once
KNOWN = 16_000_000  # characters of pieces whose ids a Python worker remembers
_BLANK, _LETTER, _DIGIT, _MARK = range(4)
#: Whether a piece begins at a character (column) after another (row). A piece is letters, a digit, or marks and the letters after them.
_BEGINS = np.array([[0, 1, 1, 1], [0, 0, 1, 1], [0, 1, 1, 1], [0, 0, 1, 0]], bool)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Whether each code point is a blank, a letter, a digit or a mark."""
    kinds, everything = np.full(0x110000, _MARK, np.uint8), "".join(map(chr, range(0x110000)))
    for pattern, kind in (("[ \n\t]", _BLANK), (r"[^\W\d_]+", _LETTER), (r"\d+", _DIGIT)):
        for found in re.finditer(pattern, everything):
            kinds[found.start() : found.end()] = kind
    return kinds


class Known(dict):
    """Numbers of strings in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.fresh.append(key)
        return number

    def numbers(self, keys: Collection[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class Ids:
    """Ids of numbered strings in one flat array."""

    def __init__(self):
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings, one after another, and the size of each."""
        sizes = self.ends[numbers + 1] - self.ends[numbers]
        stop = np.cumsum(sizes)
        return self.flat[np.repeat(self.ends[numbers] - (stop - sizes), sizes) + np.arange(stop[-1] if len(stop) else 0)], sizes


def _bytes_as_letters() -> str:
    """The character by which the vocabulary writes each byte: visible ones stand for themselves, the others follow from 256 on; a blank stays."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in seen} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(seen)))} | {32: " "}
    return "".join(letters[b] for b in range(256))


_LETTERS = _bytes_as_letters()
_LATIN = re.compile("[\x00-\xff]*").fullmatch
_LATIN_LETTERS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+").fullmatch


class Words:
    """Ids of texts by their pieces. Texts are cut in numpy, and the pieces that are new are encoded together.

    Tokens of this kind of model span neither blanks, nor the place before or after a digit, nor that between a letter
    and a mark, so texts may be cut there. A text that isn't in the normal form C, or may hold the name of a special
    token, is encoded as a whole instead. Pieces of Latin letters need no normalising and no cutting by the tokenizer,
    so its merges alone are asked for them.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        names = self.model.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.characters = Known(), Ids(), 0

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and the number of each."""
        plain = np.fromiter(map(bool, map(_LATIN_LETTERS, new)), bool, len(new))
        letters, odd = list(compress(new, plain)), list(compress(new, ~plain))
        found = Ids()
        if letters:
            written = charmap_decode(" ".join(letters).lower().encode(), "strict", _LETTERS)[0]
            ids = np.array(self.merges.encode_batch_fast([written], add_special_tokens=False)[0].ids, np.uint32)
            found.add(ids, np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))
        if odd:
            whole = self.model.encode(" ".join(odd), add_special_tokens=False)
            starts = np.fromiter((o[0] for o in whole.offsets), np.int64, len(whole))
            of = np.searchsorted(np.cumsum([len(p) + 1 for p in odd]), starts, side="right")
            found.add(np.array(whole.ids, np.uint32), np.bincount(of, minlength=len(odd)))
        place = np.empty(len(new), np.int64)
        place[plain], place[~plain] = np.arange(len(letters)), len(letters) + np.arange(len(odd))
        return found.of(place)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each."""
        if self.characters > KNOWN:
            self.forget()
        whole = [k for k, t in enumerate(texts) if not t.isascii() and not unicodedata.is_normalized("NFC", t) or "<|" in t]
        odd = dict(zip(whole, (e.ids for e in self.model.encode_batch([texts[k] for k in whole], add_special_tokens=False)))) if whole else {}
        plain = ["" if k in odd else t.lower() if t.isascii() or _LATIN(t) else t for k, t in enumerate(texts)]  # in Latin letters, cases of a piece share an entry
        pieces, per = _cut(pa.array(plain, pa.large_string()))
        found = pieces.dictionary_encode()  # so that Python sees each piece of the texts once
        numbers = self.known.numbers(found.dictionary.to_numpy(zero_copy_only=False))[found.indices.to_numpy()]
        del plain, pieces, found  # as a long text fills the memory several times
        if fresh := self.known.fresh:
            self.known.fresh = []
            self.ids.add(*self._encoded(fresh))
            self.characters += sum(map(len, fresh))
        flat, sizes = self.ids.of(numbers)
        ends = np.concatenate([[0], np.cumsum(sizes)])[per]
        if not odd:
            return flat, ends
        parts = [np.array(odd[k], np.uint32) if k in odd else flat[ends[k] : ends[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, and the offsets of each text among them."""
    data, offsets = utf8(texts)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins, last = np.empty(len(points), bool), _BLANK
    for k in range(0, len(points), PART):  # as indexes take up 8 bytes each
        kind = _kinds().take(points[k : k + PART])
        before = np.append(np.uint8(last), kind[:-1])
        begins[k : k + PART] = _BEGINS.ravel().take(before * 4 + kind)
        last = kind[-1]
    del points
    solid = (data != 32) & (data != 10) & (data != 9)
    starts = np.zeros(len(data), bool)
    starts[(data & 0xC0) != 0x80] = begins  # the first bytes of characters
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    starts[firsts] = solid[firsts]  # whatever the text before ends with
    per = np.searchsorted(np.flatnonzero(starts), offsets)
    data, starts = data[solid], starts[solid]
    ends = np.append(np.flatnonzero(starts), len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]), per


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each item, by the largest differencing method.

    A partial partition holds the sums of its windows, negative and rising, without empty ones. Most merges add one
    item, so sums are lists. Windows that are merged become a node of a forest, from which items read their window in
    the end.
    """
    n = len(sizes)
    heap = [(-size, i) for i, size in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    parts: dict[int, tuple[list[int], list[int]]] = {}  # of merged items
    left: list[int] = []
    right: list[int] = []
    pop = lambda: parts.pop(i) if (i := (top := heapq.heappop(heap))[1]) >= n else ([top[0]], [i])
    name = n
    while len(heap) > 1:
        (x, p), (y, q) = pop(), pop()
        shared = len(x) + len(y) - k  # windows that hold something of both: the least of x with the least of y
        one = min(len(x), len(y)) == 1
        if one and len(y) > 1:
            x, p, y, q, search = y, q, x, p, bisect_left  # of equal sums, those of the first partition come first
        else:
            search = bisect_right
        if one:
            (size,), (node,) = y, q
            if shared > 0:
                size += x.pop()
                left.append(p.pop())
                right.append(node)
                node = n + len(left) - 1
            at = search(x, size)
            x.insert(at, size)
            p.insert(at, node)
        else:
            both = max(shared, 0)
            a, b = len(x) - both, len(y) - both
            fresh = range(n + len(left), n + len(left) + both)
            left += p[a:]
            right += q[b:][::-1]
            x, p = x[:a] + [c + d for c, d in zip(x[a:], y[b:][::-1])] + y[:b], p[:a] + [*fresh] + q[:b]
            order = sorted(range(len(x)), key=x.__getitem__)
            x, p = [x[i] for i in order], [p[i] for i in order]
        parts[name] = x, p
        heapq.heappush(heap, (x[0] - (x[-1] if len(x) == k else 0), name))
        name += 1
    window = [-1] * (n + len(left))
    for _, i in heap:
        for w, node in enumerate(parts[i][1] if i >= n else [i]):
            window[node] = w
    for m in range(len(left) - 1, -1, -1):
        window[left[m]] = window[right[m]] = window[n + m]
    return np.array(window[:n], np.int64)


def windows_of(sizes: np.ndarray, capacity: int, least: int = 1) -> tuple[np.ndarray, int]:
    """The window of each item and the number of windows, which rises whenever one exceeds the capacity."""
    k = max(least, -(-int(sizes.sum()) // capacity), 1)
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, weights=sizes, minlength=k).max(initial=0) <= capacity:
            return window, k
        k += 1


class _Packer:
    """Turns the documents of one Spark partition into placed pieces."""

    def __init__(self, first: int, window: int, block: int):
        self.window = window
        self.room = window - SLACK
        self.full = block * self.room
        self.sequence = first
        self.waiting: list[tuple[int | None, int, np.ndarray, int]] = []  # id, start, ids, tokens of the document
        self.held = 0
        self.out: list[tuple[int | None, int, np.ndarray, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), len(ids) // self.window * self.window
        for start in range(0, at, self.window):
            self.out.append((doc_id, start, ids[start : start + self.window], total, self.sequence, 0))
            self.sequence += 1
        while at < total:
            stop = min(total, at + self.full - self.held)
            self.waiting.append((doc_id, at, ids[at:stop], total))
            self.held += stop - at
            at = stop
            if self.held == self.full:
                self.close()

    def close(self) -> None:
        """Place all that waits, as whole windows of items."""
        items, loose, glued, left = [], [], 0, self.held
        bounds = [(size, max(self.held // share, windows * self.window)) for size, share, windows in FINE]
        for doc_id, at, ids, total in self.waiting:
            grain = min([size for size, end in bounds if left <= end], default=0)
            step, grain = grain or len(ids), grain or FINE[0][0]
            left -= len(ids)
            for start in range(0, len(ids), step):
                piece = (doc_id, at + start, ids[start : start + step], total)
                if len(piece[2]) >= grain:
                    items.append([piece])
                    continue
                loose.append(piece)  # smaller rests share an item
                glued += len(piece[2])
                if glued >= grain:
                    items.append(loose)
                    loose, glued = [], 0
        if loose:
            items.append(loose)
        sizes = np.array([sum(len(p[2]) for p in item) for item in items], np.int64)
        window, k = windows_of(sizes, self.window, max(1, self.held // self.window))
        at = np.zeros(k, np.int64)
        for w, item in zip(window.tolist(), items):
            for doc_id, start, ids, total in item:
                self.out.append((doc_id, start, ids, total, self.sequence + w, int(at[w])))
                at[w] += len(ids)
        self.sequence += k
        self.waiting, self.held = [], 0

    def finish(self) -> None:
        """Place what waits at the end of a partition: windows while they are full, then powers of two."""
        over = self.held - self.held // self.room * self.room
        rest = []
        while over:
            doc_id, at, ids, total = self.waiting.pop()
            cut = max(0, len(ids) - over)
            if cut:
                self.waiting.append((doc_id, at, ids[:cut], total))
            rest.append((doc_id, at + cut, ids[cut:], total))
            over -= len(ids) - cut
        self.held -= sum(len(r[2]) for r in rest)
        if self.held:
            self.close()
        left = sum(len(r[2]) for r in rest)
        rest.reverse()
        while left:
            size = 1 << (left.bit_length() - 1)
            left, at = left - size, 0
            while at < size:
                doc_id, start, ids, total = rest.pop(0)
                take = min(len(ids), size - at)
                self.out.append((doc_id, start, ids[:take], total, self.sequence, at))
                if take < len(ids):
                    rest.insert(0, (doc_id, start + take, ids[take:], total))
                at += take
            self.sequence += 1

    def pieces(self) -> pa.RecordBatch:
        """What has been placed since the last call."""
        out, self.out = self.out, []
        ids = pa.array([o[2].astype("<u4").tobytes() for o in out], pa.binary())
        long = lambda k: pa.array([o[k] for o in out], pa.int64())
        return pa.RecordBatch.from_arrays([long(0), long(1), pa.array([len(o[2]) for o in out], pa.int64()), ids, long(3), long(4), long(5)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


_words: dict[str, Words] = {}  # of a Python worker, which serves task after task


def _packed(path: str, window: int, block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _words:
            _words[path] = Words(path)
        words = _words[path]
        packer = _Packer(TaskContext.get().partitionId() << 40, window, block)
        for batch in chunks(batches, "text", CHUNK):
            flat, offsets = words.encode([t or "" for t in batch.column("text").to_pylist()])
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                packer.add(doc_id, np.append(flat[offsets[k] : offsets[k + 1]], np.uint32(END)))
            if packer.out:
                yield packer.pieces()
        packer.finish()
        if packer.out:
            yield packer.pieces()

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of each piece of each row of ``docs``.

    A row's tokens are the ids of its text and END. Each lies in one piece: ``start`` is the number of the document's
    tokens before it, ``ids`` the piece as little-endian unsigned 32-bit integers, ``sequence_id`` its window and
    ``offset`` the tokens before it there. No window has more than ``window`` tokens.
    Null and empty texts are END alone. Rows are told apart by place, so null and repeated ids and repeated rows are
    documents of their own; their pieces carry the same doc_id. A very long text fills windows of its own and is held
    whole in its task. An empty table gives an empty result. Other columns are not read. Sequence ids are distinct,
    with gaps between Spark partitions, and a partition that is computed again gives the same ones.
    """
    if window <= SLACK or block < 1:
        raise ValueError("a window must exceed the slack, and a block has a window at least")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packed(model, window, block), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """n_windows, n_tokens, n_padding of packed pieces: windows are filled up to ``window`` unless a power of two."""
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    exact = F.expr("n & (n - 1)") == 0
    return sizes.agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_tokens"), F.sum(F.when(exact, 0).otherwise(window - F.col("n"))).alias("n_padding"))


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
