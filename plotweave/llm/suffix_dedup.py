"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if a string of LENGTH bytes covers it that also starts in a document with a smaller id.

1. Each document is sampled at anchors: minimizers, so that every string of LENGTH bytes holds one, and equal strings
   hold the same one at the same place. An anchor is filed by the hash of its gram with hashes of its surroundings,
   as far as strings that hold it can reach. A map task settles what repeats inside it, comparing bytes, so that a
   passage or copy, however frequent, is sent about once a map task.
2. Anchors whose surroundings have the hash of a smaller document's ask for proof: those that follow each other at
   one distance from their partners are a run, whose bytes go to the partner and are compared with it.
3. Other anchors that share the bytes on one side with another document, the ends of passages, are settled by suffix
   sorts: the suffixes at the grams, and those that run backwards from there, are sorted by mergesort, comparing by
   the longest common extension, which a binary search over prefix polynomial hashes finds in logarithmic time.
   Neighbours are compared by their bytes.
4. Each document is cut by all settled spans. No span rests on hashes alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotweave.llm.arrow_text import chunks, utf8
from plotweave.plans.durable import Scratch

LENGTH = 50
GRAM = 16
REACH = LENGTH - GRAM  # bytes before an anchor that a string holding it may cover
HALF = REACH // 2  # a string holding an anchor reaches as far before or behind its gram
BUCKET_BYTES = 4_000_000  # bytes of text for each bucket of anchors and of documents
HELD = 600_000  # anchors that a task holds before it sends them
CHUNK = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NO_ID = (1 << 63) - 1
_BYTES = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers 0 to n of the base."""
    global _POWERS
    if len(_POWERS) <= n:
        with np.errstate(over="ignore"):
            grown = np.full(max(n + 1, 2 * len(_POWERS)), _BASE, np.uint64)
            grown[0] = 1
            _POWERS = np.multiply.accumulate(grown)
    return _POWERS


class Hashed:
    """Prefix polynomial hashes of a byte string; equal substrings have equal hashes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTES[data] * powers(len(data))[: len(data)], out=self.prefix[1:])
            back = np.full(len(data) + 1, _BACK, np.uint64)
            back[0] = 1
            self.back = np.multiply.accumulate(back)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[stop] - self.prefix[start]) * self.back[start]

    def extension(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """Length up to ``depth`` of the longest common extension of the suffixes at a and b."""
        out = np.zeros(len(a), np.int64)
        step = 1 << (depth.bit_length() - 1)
        while step:
            fits = np.flatnonzero(out + step <= depth)
            to = out[fits] + step
            same = self.of(a[fits] + out[fits], a[fits] + to) == self.of(b[fits] + out[fits], b[fits] + to)
            out[fits[same]] = to[same]
            step >>= 1
        return out

    def less(self, a: np.ndarray, b: np.ndarray, depth: int, or_equal: np.ndarray) -> np.ndarray:
        """Whether the first ``depth`` bytes at a come before those at b, or equal them where that counts."""
        common = self.extension(a, b, depth)
        end = common >= depth
        last = len(self.data) - 1
        return np.where(end, or_equal, self.data[np.minimum(a + common, last)] < self.data[np.minimum(b + common, last)])


def suffix_sort(text: Hashed, starts: np.ndarray, group: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Order of ``starts`` by group, and in each group by the ``depth`` bytes from there.

    A bottom-up mergesort whose merges go on in all groups at once: the place of each suffix in the run beside its own
    is found by binary search.
    """
    order = np.argsort(group, kind="stable")
    sorted_group = group[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(group)))
    base, total = np.repeat(first, size), np.repeat(size, size)
    local = np.arange(len(group)) - base
    width = 1
    while width < (size.max() if len(size) else 0):
        live = np.flatnonzero(total > width)
        run = local[live] // width
        low = np.minimum((run ^ 1) * width, total[live])
        high = np.minimum(low + width, total[live])
        begin, right = low.copy(), run % 2 == 1
        me, offset = starts[order[live]], base[live]
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) // 2
            before = text.less(starts[order[offset[todo] + mid]], me[todo], depth, right[todo])
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        place = offset + (run & ~1) * width + local[live] - run * width + low - begin
        moved = order.copy()
        moved[place] = order[live]
        order = moved
        width *= 2
    return order


def _common(data: np.ndarray, starts: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, up to ``depth``, that each suffix of ``order`` shares with the one before, counted on the bytes, and whether it is smaller."""
    x, y = starts[order[:-1]], starts[order[1:]]
    out, same, less = np.zeros(len(order), np.int64), np.ones(len(x), bool), np.zeros(len(order), bool)
    for k in range(depth):
        less[1:] |= same & (data[y + k] < data[x + k])
        same &= data[x + k] == data[y + k]
        out[1:] += same
    return out, less


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffix_sort, and the bytes that each suffix shares with the one before, -1 at the first of a group."""
    order = suffix_sort(Hashed(data), starts, group, depth)
    new = np.concatenate([[True], group[order[1:]] != group[order[:-1]]])[: len(order)]
    common, less = _common(data, starts, order, depth)
    if (less & ~new).any():  # hashes have collided
        order = np.array(sorted(range(len(starts)), key=lambda i: (group[i], data[starts[i] : starts[i] + depth].tobytes())), np.int64)
        common, _ = _common(data, starts, order, depth)
    return order, np.where(new, -1, common)


def settle_windows(data: np.ndarray, gram: np.ndarray, lead: np.ndarray, strings: np.ndarray, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, left): strings of LENGTH bytes that equal one of a smaller document in their group.

    An entry is a gram of ``data`` with ``lead`` bytes before it, from which ``strings`` strings start one after the
    other; a string with ``left`` bytes before the gram has LENGTH - left from there. The suffixes at the grams are
    sorted, and so are those that run backwards from there. Neighbours in either order are compared by their bytes, so
    strings are equal where the entries are in one class of both orders, at the depths that the string has on each side.
    """
    edge = np.zeros(LENGTH, np.uint8)
    padded = np.concatenate([edge, data, edge])
    ahead, back = gram + LENGTH, LENGTH + len(data) - gram
    right, right_common = sorted_suffixes(padded, ahead, group, LENGTH)
    left, left_common = sorted_suffixes(np.ascontiguousarray(padded[::-1]), back, group, REACH)
    by_doc, n = np.argsort(doc, kind="stable"), len(gram)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    entries, lefts = [], []
    for reach in range(REACH + 1):
        mine = by_doc[(lead[by_doc] >= reach) & (lead[by_doc] - reach < strings[by_doc])]
        if not len(mine):
            continue
        a[right], b[left] = np.cumsum(right_common < LENGTH - reach), np.cumsum(left_common < reach)
        both = a[mine] * (n + 1) + b[mine]
        order = np.argsort(both, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], both[order][1:] != both[order][:-1]]))
        least = np.repeat(doc[mine[order[heads]]], np.diff(np.append(heads, len(mine))))
        hit = mine[order[doc[mine[order]] > least]]
        entries.append(hit)
        lefts.append(np.full(len(hit), reach))
    return (np.concatenate(entries), np.concatenate(lefts)) if entries else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values."""
    pick = np.minimum if least else np.maximum
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def _minimizers(text: Hashed, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the gram at each place, the least gram of each string of LENGTH bytes (0 across texts), and the text of each byte."""
    size = np.diff(offsets)
    at = np.arange(len(text.data) - GRAM + 1)
    gram = _mix(text.of(at, at + GRAM))
    owner = np.repeat(np.arange(len(size)), size)
    gram[owner[: len(gram)] != owner[GRAM - 1 :]] = np.uint64((1 << 64) - 1)  # grams across texts
    least = _slide(gram, REACH + 1, True)
    return gram, np.where(owner[: len(least)] == owner[LENGTH - 1 :], least, np.uint64(0)), owner


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, hashes of the surroundings, of HALF bytes before and behind (0: a text's edge is nearer), text and place of each anchor of ``data``."""
    if not (np.diff(offsets) >= LENGTH).any():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.uint64, np.int64, np.int64))
    text = Hashed(data)
    gram, least, owner = _minimizers(text, offsets)
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    chosen = np.flatnonzero(_slide(padded, REACH + 1, False) == gram)
    chosen = chosen[gram[chosen] > 0]
    mine = owner[chosen]
    low, high = offsets[mine], offsets[mine + 1]
    start, stop = np.maximum(chosen - REACH, low), np.minimum(chosen + LENGTH, high)
    around = _mix(text.of(start, stop) ^ _mix(((chosen - start) * 64 + (stop - chosen)).astype(np.uint64)))
    half = lambda inside, a, b: np.where(inside, _mix(text.of(a, b)) | np.uint64(1), np.uint64(0))
    before = half(chosen - HALF >= low, np.maximum(chosen - HALF, low), chosen + GRAM)
    behind = half(chosen + GRAM + HALF <= high, chosen, np.minimum(chosen + GRAM + HALF, high))
    return _mix(gram[chosen] + _BASE), around, before, behind, mine, chosen - low


def reach_of(text: Hashed, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First string whose minimizer is the gram at each place, and the number of such strings, which follow each other."""
    gram, least, _ = _minimizers(text, offsets)
    begin = at[:, None] - REACH + np.arange(REACH + 1)
    own = (begin >= 0) & (begin < len(least))
    own &= least[np.clip(begin, 0, len(least) - 1)] == gram[np.minimum(at, len(gram) - 1)][:, None]
    return begin[np.arange(len(at)), own.argmax(1)], own.sum(1)


def _packed(columns: list[np.ndarray], widths: list[int]) -> bytes:
    """Columns of whole numbers in so many bytes each."""
    parts = [np.array([len(columns[0]), *widths], np.uint32).tobytes()]
    for c, w in zip(columns, widths):
        parts.append(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w]).tobytes())
    return b"".join(parts)


def _unpacked(blob: bytes, n_columns: int) -> list[np.ndarray]:
    n, *widths = np.frombuffer(blob, np.uint32, n_columns + 1).tolist()
    at, out = 4 * (n_columns + 1), []
    for w in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = np.frombuffer(blob, np.uint8, n * w, at).reshape(n, w)
        out.append(wide.view("<u8").ravel())
        at += n * w
    return out


def _width(values: np.ndarray) -> int:
    """Bytes that the largest value needs."""
    return max(1, (int(values.astype(np.uint64).max()).bit_length() + 7) // 8) if len(values) else 1


def _pack(*columns: np.ndarray) -> bytes:
    return _packed(list(columns), [_width(c) for c in columns])


def _concat(blobs: list[bytes | None], n_columns: int) -> list[np.ndarray]:
    found = [_unpacked(b, n_columns) for b in blobs if b]
    return [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64) for k in range(n_columns)]


def _before(key: np.ndarray, around: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For entries sorted by (key, around, doc): the last one of the same surroundings in a smaller document, else -1."""
    n = np.arange(len(key))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (around[1:] != around[:-1])])
    other = new | np.concatenate([[True], doc[1:] != doc[:-1]])
    first, begin = np.maximum.accumulate(np.where(other, n, 0)), np.maximum.accumulate(np.where(new, n, 0))
    return np.where(first > begin, first - 1, -1)


def _same_around(data: np.ndarray, at: np.ndarray, like: np.ndarray, lead: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``lead`` before to ``tail`` behind are the same at both places."""
    same, last = np.ones(len(at), bool), len(data) - 1
    for k in range(-REACH, LENGTH):
        inside = (k >= -lead) & (k < tail)
        same &= ~inside | (data[np.clip(at + k, 0, last)] == data[np.clip(like + k, 0, last)])
    return same


def _shared(key: np.ndarray, half: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries another document has with the same key and the same bytes on one side."""
    order = np.lexsort((half, key))
    k, h = key[order], half[order]
    heads = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]))
    several = np.minimum.reduceat(doc[order], heads) < np.maximum.reduceat(doc[order], heads)
    out = np.zeros(len(key), bool)
    out[order] = np.repeat(several, np.diff(np.append(heads, len(key))))
    return out & (half > 0)


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    """The same as _doc_bucket_column on whole numbers."""
    bits = doc.astype(np.int64).view(np.uint64)
    return np.mod((bits ^ (bits >> np.uint64(7)) ^ (bits >> np.uint64(17))).view(np.int64), buckets)


def _doc_bucket_column(doc, buckets: int):
    return F.pmod(doc.bitwiseXOR(F.shiftrightunsigned(doc, 7)).bitwiseXOR(F.shiftrightunsigned(doc, 17)), F.lit(buckets))


def _sampler(buckets: int):
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        texts: list[np.ndarray] = []
        count = size = 0

        def flush():
            """Settle what repeats among the texts held, by their bytes, and file the rest."""
            columns, data = [np.concatenate(c) for c in zip(*held)], np.concatenate(texts)
            held.clear(), texts.clear()
            order = np.lexsort((columns[4], columns[1], columns[0]))
            key, around, before, behind, doc, place, at, high = (c[order] for c in columns)
            partner = _before(key, around, doc)
            later = np.flatnonzero(partner >= 0)
            like = partner[later]
            lead, tail = (np.minimum(x, y) for x, y in ((place, REACH), (high - at, LENGTH)))
            later = later[(lead[later] == lead[like]) & (tail[later] == tail[like]) & _same_around(data, at[later], at[like], lead[later], tail[later])]
            left = np.ones(len(key), bool)
            left[later] = False
            done = _pack(doc[later], place[later])
            entries = [c[left] for c in (key, around, before, behind, doc, place)]
            bucket = (entries[0] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            wide = [6, 4, 2, 2, _width(entries[4]), _width(entries[5])]
            for b in np.flatnonzero(edges[:-1] < edges[1:]):
                rows = by[edges[b] : edges[b + 1]]
                yield int(b), _packed([c[rows] for c in entries], wide), None
            if len(later):
                yield int(doc[0] % buckets), None, done

        def out(rows):
            rows = list(rows)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "entries", "done"])

        for batch in chunks(batches, "text", CHUNK):
            ids = batch.column("doc").to_numpy()
            data, offsets = utf8(batch.column("text"))
            key, around, before, behind, mine, place = anchors(data, offsets)
            if len(key):
                low = np.uint64((1 << 16) - 1)
                held.append((key, around & np.uint64((1 << 32) - 1), before & low, behind & low, ids[mine], place, size + offsets[mine] + place, size + offsets[mine + 1]))
                texts.append(data)
                count, size = count + len(key), size + len(data)
            if count > HELD:
                yield out(flush())
                count = size = 0
        if held:
            yield out(flush())

    return sampled


def _binaries(rows: list[tuple], name: str, *names: str) -> pa.Table:
    """A table of a whole number and several binaries from rows."""
    columns = list(zip(*rows)) or [()] * (len(names) + 1)
    return pa.table([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], [name, *names])


def _filer(doc_buckets: int):
    def filed(table: pa.Table) -> pa.Table:
        """Entries that repeat a smaller document's surroundings ask for proof; those that share one side only are open."""
        columns = _concat(table.column("entries").to_pylist(), 6)
        spans = _concat(table.column("done").to_pylist(), 2)
        order = np.argsort(columns[0], kind="stable")
        near = columns[0][order]
        again = np.concatenate([[False], near[1:] == near[:-1]])
        order = order[again | np.append(again[1:], False)] if len(order) else order
        order = order[np.lexsort((columns[4][order].view(np.int64), columns[1][order], columns[0][order]))]
        key, around, before, behind, doc, place = (c[order] for c in columns)
        doc = doc.view(np.int64)
        later = open_ = like = np.zeros(0, np.int64)
        if len(key):
            partner = _before(key, around, doc)
            later, left = np.flatnonzero(partner >= 0), np.flatnonzero(partner < 0)
            like = partner[later]
            open_ = left[_shared(key[left], before[left], doc[left]) | _shared(key[left], behind[left], doc[left])]
        parts = [("done", [spans[0].view(np.int64), spans[1]]), ("asked", [doc[later], place[later], doc[like], place[like]]), ("open", [doc[open_], key[open_], place[open_]])]
        found: dict[int, dict[str, bytes]] = {}
        for name, (own, *more) in parts:
            bucket = _doc_bucket(own, doc_buckets)
            by = np.argsort(bucket, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
                found.setdefault(int(bucket[rows[0]]), {})[name] = _pack(own[rows], *(c[rows] for c in more))
        return _binaries([(b, *(v.get(n) for n in ("done", "asked", "open"))) for b, v in found.items()], "doc_bucket", "done", "asked", "open")

    return filed


def _rows_of(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a place in ``wanted`` and a row that has the id."""
    order = np.argsort(ids, kind="stable")
    low, high = np.searchsorted(ids[order], wanted, "left"), np.searchsorted(ids[order], wanted, "right")
    count = high - low
    which = np.repeat(np.arange(len(wanted)), count)
    return which, order[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]]


def _cut_out(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several pieces, one after the other."""
    shift = np.cumsum(size) - size
    return data[np.repeat(begin - shift, size) + np.arange(size.sum())]


def _runs(doc: np.ndarray, place: np.ndarray, other: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last anchor of each run, in which anchors of one document overlap and have partners as far apart; the order comes sorted."""
    shift = place - there
    order = np.lexsort((place, shift, other, doc))
    new = np.zeros(len(order), bool)
    for c in (doc, other, shift):
        new[1:] |= c[order[1:]] != c[order[:-1]]
    new[1:] |= place[order[1:]] - place[order[:-1]] > REACH + LENGTH
    heads = np.concatenate([[0], np.flatnonzero(new)]) if len(order) else np.zeros(0, np.int64)
    return order[heads], order[np.append(heads[1:], len(order)) - 1] if len(order) else heads


def _shower(buckets: int, doc_buckets: int):
    def shown(docs: pa.Table, filed: pa.Table) -> pa.Table:
        """The bytes around the anchors that are open, packed by their keys, and those that ask for proof, by their partners."""
        key_doc, key, place = _concat(filed.column("open").to_pylist(), 3)
        doc, place = key_doc.view(np.int64), place.astype(np.int64)
        data, offsets = utf8(docs.column("text"))
        ids, sizes = docs.column("doc").to_numpy(), np.diff(offsets)
        which, row = _rows_of(ids, doc)
        inside = place[which] < sizes[row]
        which, row = which[inside], row[inside]
        key, doc, place = key[which], doc[which], place[which]
        rows = []
        if len(key):  # strings around that have another minimizer are told by that
            start, strings = reach_of(Hashed(data), offsets, offsets[row] + place)
            some = strings > 0
            key, doc, place, start, size = key[some], doc[some], place[some], start[some], strings[some] + LENGTH - 1
            lead = offsets[row[some]] + place - start
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(bucket).tolist():
                own = np.flatnonzero(bucket == b)
                rows.append((b, _pack(key[own], doc[own], place[own], lead[own], size[own]), None, _cut_out(data, start[own], size[own]).tobytes()))
        doc, place, other, there = (c.view(np.int64) for c in _concat(filed.column("asked").to_pylist(), 4))
        first, last = _runs(doc, place, other, there)
        which, row = _rows_of(ids, doc[first])
        begin, end = np.maximum(place[first][which] - REACH, 0), np.minimum(place[last][which] + LENGTH, sizes[row])
        whole = np.flatnonzero(place[last][which] + GRAM <= sizes[row])
        first, begin, size, row = first[which][whole], begin[whole], (end - begin)[whole], row[whole]
        shift = place[first] - there[first]
        bucket = _doc_bucket(other[first], doc_buckets)
        for b in np.unique(bucket).tolist():
            own = np.flatnonzero((bucket == b) & (begin >= shift))
            rows.append((b, None, _pack(doc[first[own]], begin[own], size[own], other[first[own]], (begin - shift)[own]), _cut_out(data, offsets[row[own]] + begin[own], size[own]).tobytes()))
        return _binaries(rows, "bucket", "open", "runs", "text")

    return shown


def _prover(doc_buckets: int):
    def proved(docs: pa.Table, shown: pa.Table) -> pa.Table:
        """The runs whose bytes are those of their partners."""
        doc, begin, size, other, there = (c.view(np.int64) for c in _concat(shown.column("runs").to_pylist(), 5))
        text = np.frombuffer(b"".join(shown.column("text").to_pylist()), np.uint8)
        first = np.cumsum(size) - size
        data, offsets = utf8(docs.column("text"))
        which, row = _rows_of(docs.column("doc").to_numpy(), other)
        fits = there[which] + size[which] <= np.diff(offsets)[row]
        which, row = which[fits], row[fits]
        n = size[which]
        same = _cut_out(text, first[which], n) == _cut_out(data, offsets[row] + there[which], n)
        good = which[np.logical_and.reduceat(same, np.cumsum(n) - n)] if len(which) else which
        bucket = _doc_bucket(doc[good], doc_buckets)
        return _binaries([(b, _pack(doc[own], begin[own], size[own])) for b in np.unique(bucket).tolist() for own in [good[bucket == b]]], "doc_bucket", "proved")

    return proved


def _teller(doc_buckets: int):
    def told(table: pa.Table) -> pa.Table:
        """Settle the open anchors of a bucket by the suffix sort of the bytes around them."""
        key, doc, place, lead, size = _concat(table.column("open").to_pylist(), 5)
        data = np.frombuffer(b"".join(table.column("text").to_pylist()), np.uint8)
        doc, place, lead, size = doc.view(np.int64), place.astype(np.int64), lead.astype(np.int64), size.astype(np.int64)
        entry, left = settle_windows(data, np.cumsum(size) - size + lead, lead, size - LENGTH + 1, doc, key)
        own, at = doc[entry], place[entry] - left
        bucket = _doc_bucket(own, doc_buckets)
        return _binaries([(b, _pack(own[bucket == b], at[bucket == b])) for b in np.unique(bucket).tolist()], "doc_bucket", "told")

    return told


def _cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """Each document without the bytes that settled spans cover."""
    data, offsets = utf8(docs.column("text"))
    ids = docs.column("doc").to_numpy()
    mask = np.zeros(len(data) + 1, np.int32)
    done, told, proved = ([c.view(np.int64) for c in _concat(spans.column(name).to_pylist(), n)] for name, n in (("done", 2), ("told", 2), ("proved", 3)))
    for doc, begin, end in ((done[0], done[1] - REACH, done[1] + LENGTH), (told[0], told[1], told[1] + LENGTH), (proved[0], proved[1], proved[1] + proved[2])):
        which, row = _rows_of(ids, doc)
        low, high = offsets[row], offsets[row + 1]
        np.add.at(mask, np.clip(low + begin[which], low, high), 1)
        np.subtract.at(mask, np.clip(low + end[which], low, high), 1)
    covered = np.cumsum(mask[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(covered)])
    begins = covered & ~np.concatenate([[False], covered[:-1]])
    head = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[head] = covered[head]
    runs = np.concatenate([[0], np.cumsum(begins)])
    kept = data[~covered]
    left = offsets - total[offsets]
    n = docs.num_rows
    view = memoryview(np.ascontiguousarray(kept))
    digest = [hashlib.sha256(view[left[i] : left[i + 1]]).hexdigest() for i in range(n)]
    return pa.table([docs.column("doc_id"), pa.array(np.diff(offsets)), pa.array(total[offsets[1:]] - total[offsets[:-1]]), pa.array(runs[offsets[1:]] - runs[offsets[:-1]]), pa.array(digest, pa.string()), pa.array([bytes(view[left[i] : left[i + 1]]) for i in range(n)], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _cut_digests(docs: pa.Table, spans: pa.Table) -> pa.Table:
    return _cut(docs, spans).drop_columns(["kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) of every row of ``docs``.

    Null texts are empty; texts under LENGTH bytes lose nothing. A null id is larger than all others. Rows of one id,
    or without an id, are documents of their own, ordered by the digests of their texts, and of whole repeated rows
    the first is the smallest, so a text stays in one row at least. Other columns are not read. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("long")
    rows = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(_NO_ID)).alias("doc"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, total // BUCKET_BYTES)
    if not rows.groupBy("doc").count().where("count > 1").isEmpty():
        order = [F.asc_nulls_last("doc_id"), F.sha2(F.col("text").cast("binary"), 256)]
        numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id())  # rises with the order
        rows = scratch.write(numbered, "numbered")
    sampled = rows.drop("doc_id").mapInArrow(_sampler(buckets), "bucket int, entries binary, done binary")
    filed = scratch.write(sampled.groupBy("bucket").applyInArrow(_filer(buckets), "doc_bucket long, done binary, asked binary, open binary"), "filed")
    placed = rows.withColumn("doc_bucket", _doc_bucket_column(F.col("doc"), buckets))
    asking = filed.where("asked is not null or open is not null").select("doc_bucket", "asked", "open")
    shown = placed.groupBy("doc_bucket").cogroup(asking.groupBy("doc_bucket")).applyInArrow(_shower(buckets, buckets), "bucket long, open binary, runs binary, text binary")
    shown = scratch.write(shown, "shown")
    told = shown.where("open is not null").groupBy("bucket").applyInArrow(_teller(buckets), "doc_bucket long, told binary")
    proved = placed.groupBy("doc_bucket").cogroup(shown.where("runs is not null").select(F.col("bucket").alias("doc_bucket"), "runs", "text").groupBy("doc_bucket")).applyInArrow(_prover(buckets), "doc_bucket long, proved binary")
    none = F.lit(None).cast("binary")
    spans = filed.where("done is not null").select("doc_bucket", "done", none.alias("told"), none.alias("proved"))
    spans = spans.union(told.select("doc_bucket", none, "told", none)).union(proved.select("doc_bucket", none, none, "proved"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return placed.groupBy("doc_bucket").cogroup(spans.groupBy("doc_bucket")).applyInArrow(_cut if with_bytes else _cut_digests, schema)
