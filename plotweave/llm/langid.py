"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives, from any place of a text, the longest match; the whole text is
parsed greedily into such phrases (Ziv and Merhav, 1993). The language that needs the fewest phrases, normalised by
the size of its text and the length parsed, wins. Windows of all texts of a batch advance together, one letter a step;
a phrase may cross windows, as each window is then parsed on from where the phrase before it ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotweave.llm.arrow_text import chunks, code_points, utf8

PASSAGES_PER_LANG = 60  # bound of the sample that is learnt from: passages of labelled rows, drawn from all their text
PASSAGE = 1_000  # characters of a passage
WINDOW = 840  # divisible by 1 to 8, so that windows of texts of one short period agree about phrases at once
TABLE = 1 << 23  # moves of a language's automaton up to which they lie in a table over all states and symbols (32 MB)
FACTOR = 0x9E3779B97F4A7C15  # of the hash table's keys
FEW = 64  # windows up to which they are parsed on one by one
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Code point of the lower-case letter of each code point; 32 for all that is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low[0])
    return out


def letters(text: str) -> str:
    """Lower-case letters with single blanks for all else."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Windows:
    """Windows of texts, longest first; the symbols of all windows at one place lie side by side, so a step reads them in order."""

    def __init__(self, offsets: np.ndarray, window: int = WINDOW):
        self.texts = len(offsets) - 1
        per = -(-np.diff(offsets) // window)
        self.owner = np.repeat(np.arange(self.texts), per)
        self.rank = np.arange(len(self.owner)) - np.repeat(np.cumsum(per) - per, per)
        self.start, self.end = offsets[self.owner] + self.rank * window, offsets[self.owner + 1]
        self.stop = np.minimum(self.start + window, self.end)
        size = self.stop - self.start
        self.order = np.argsort(-size, kind="stable")
        longer = np.searchsorted(-size[self.order], -np.arange(size.max(initial=0)), side="left")  # windows longer than each place
        bounds = np.concatenate([[0], np.cumsum(longer)])
        row = np.empty(len(size), np.int64)
        row[self.order] = np.arange(len(size))
        self.place = (bounds[np.arange(int(size.sum())) - np.repeat(self.start, size)] + np.repeat(row, size)).astype(np.int32 if bounds[-1] < 1 << 31 else np.int64)
        self.bounds = bounds.tolist()


class Automaton:
    """The suffix automaton of a text. A move is the next state times 2, and 1 if a phrase starts at the symbol.

    States are multiples of ``width``, the number of symbols of the text and one for all others. Moves lie in a table
    over all states and symbols or, where that would exceed TABLE, in a hash table that numpy probes.
    """

    def __init__(self, symbols: list[int], alphabet: int):
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            moves.append({})
            link.append(0)
            length.append(length[last] + 1)
            new, p = len(moves) - 1, last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(moves)
                    moves.append(dict(moves[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        self.size = max(len(symbols), 2)
        seen = sorted(moves[0])
        self.width = len(seen) + 1
        self.code = np.zeros(alphabet, np.uint8 if len(seen) < 256 else np.uint32)
        self.code[seen] = np.arange(1, len(seen) + 1)
        self.root = np.ones(self.width, np.int64)  # a symbol that the language lacks is a phrase of its own
        self.root[self.code[list(moves[0])]] += np.array(list(moves[0].values()), np.int64) * (2 * self.width)
        states = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        keys = states * self.width + self.code[[c for m in moves for c in m]]
        values = np.array([to for m in moves for to in m.values()], np.int64) * (2 * self.width) + (states == 0)
        self.table = None
        if len(moves) * self.width <= TABLE:
            self.table = np.tile(self.root.astype(np.int32), len(moves))
            self.table[keys] = values
            self._entries = memoryview(self.table)
            return
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # each free slot takes the last of the keys that want it; the others go on to the next slot
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
        self.values[slots] = values
        self._keys, self._entries = memoryview(self.keys), memoryview(self.values)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(FACTOR)) >> np.uint64(64 - self.bits)).view(np.int64)

    def moves(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The move from each state by each symbol."""
        key = state + symbol
        if self.table is not None:
            return self.table.take(key)
        slot = self._slot(key)
        found = self.keys.take(slot)
        out = self.values.take(slot)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found[left] = self.keys[slot[left]]
            out[left] = self.values[slot[left]]
            left = left[(found[left] != key[left]) & (found[left] >= 0)]
        return np.where(found == key, out, self.root.take(symbol))

    def _move(self, state: int, symbol: int) -> int:
        key = state + symbol
        if self.table is not None:
            return self._entries[key]
        slot = (key * FACTOR & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (found := self._keys[slot]) != key:
            if found < 0:
                return int(self.root[symbol])
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return self._entries[slot]

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray, window: int = WINDOW, windows: Windows | None = None) -> np.ndarray:
        """The number of phrases of the greedy parse of each text; texts are ``symbols`` between ``offsets``, cut into ``windows``."""
        w = windows or Windows(offsets, window)
        own = self.code.take(symbols)
        side, starts = np.empty_like(own), np.empty(len(own), bool)  # by place in the windows
        side[w.place] = own
        state = np.zeros(len(w.order), np.int64)
        for a, b in zip(w.bounds[:-1], w.bounds[1:]):
            move = self.moves(state[: b - a], side[a:b])
            np.bitwise_and(move, 1, out=starts[a:b], casting="unsafe")
            np.right_shift(move, 1, out=state[: b - a])
        mark = starts[w.place]  # where a phrase starts, if one starts with its window
        before = np.zeros(len(own) + 1, np.int64)
        np.cumsum(mark, out=before[1:])
        counts, leave, entry = before[w.stop] - before[w.start], w.stop.copy(), w.start.copy()
        ahead = np.empty_like(state)
        ahead[w.order] = state
        rows = np.flatnonzero(w.stop < w.end)
        self._onward(own, mark, before, w, counts, leave, leave, rows, w.stop[rows], ahead[rows])  # to the end of the last phrase
        usual = leave.copy()
        follows = np.flatnonzero(w.rank > 0)
        while True:  # until each window is parsed from where the phrase before it ends
            late = follows[leave[follows - 1] != entry[follows]]
            if not len(late):
                return np.bincount(w.owner, counts, w.texts).astype(np.int64)
            entry[late] = leave[late - 1]
            counts[late], leave[late] = 0, entry[late]
            rows = late[entry[late] < w.stop[late]]
            self._onward(own, mark, before, w, counts, leave, usual, rows, entry[rows], np.zeros(len(rows), np.int64))

    def _onward(self, own, mark, before, w, counts, leave, usual, rows, at, state) -> None:
        """Parse the windows ``rows`` on from ``at`` until a phrase starts behind the window, or where the known parse has one.

        Adds to ``counts`` and sets ``leave``, where the phrase begins that starts behind the window. Few windows are
        parsed on one by one, as a step of all costs as much for one as for FEW.
        """
        while len(rows) > FEW:
            move = self.moves(state, own[at])
            begins = (move & 1) > 0
            out = begins & (at >= w.stop[rows])
            same = begins & ~out & mark[at]  # from here on the parse is the one that is known
            leave[rows[out]] = at[out]
            counts[rows[same]] += before[w.stop[rows[same]]] - before[at[same]]
            leave[rows[same]] = usual[rows[same]]
            counts[rows[begins & ~out & ~same]] += 1
            at = at + 1
            ended = ~out & ~same & (at == w.end[rows])
            leave[rows[ended]] = at[ended]
            on = ~(out | same | ended)
            rows, at, state = rows[on], at[on], move[on].astype(np.int64) >> 1
        text, known, move_of = memoryview(own), memoryview(mark), self._move
        for row, k, now, stop, end in zip(rows.tolist(), at.tolist(), state.tolist(), w.stop[rows].tolist(), w.end[rows].tolist()):
            count = 0
            while k < end:
                move = move_of(now, text[k])
                if move & 1:
                    if k >= stop:
                        break
                    if known[k]:
                        count += before[stop] - before[k]
                        k = usual[row]
                        break
                    count += 1
                now = move >> 1
                k += 1
            counts[row] += count
            leave[row] = k


class Model:
    """Automata of all languages over one alphabet: all letters of their texts, and one symbol for those of none."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        seen = sorted({" ", *(c for t in texts.values() for c in t)})
        code = {c: k for k, c in enumerate(seen)}
        self.symbol = np.full(0x110000, len(seen), np.int32)
        self.symbol[[ord(c) for c in seen]] = np.arange(len(seen))
        self.automata = [Automaton([code[c] for c in texts[lang]], len(seen) + 1) for lang in self.langs]

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The language index (-1 for none) and score of each text."""
        n = len(column)
        points, offsets = code_points(*utf8(column))
        low = _lower()[points]
        blank = low == 32
        keep = ~(blank & np.concatenate([[True], blank[:-1]]))
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        keep[firsts] = ~blank[firsts]
        kept = np.zeros(len(low) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        low, offsets = low[keep], kept[offsets]
        lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        keep = np.ones(len(low), bool)
        keep[lasts] = low[lasts] != 32  # no blank at either end, as in ``letters``
        kept = np.zeros(len(low) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        offsets, symbols = kept[offsets], self.symbol[low[keep]]
        size = np.diff(offsets)
        if not len(symbols) or not self.langs:
            return np.full(n, -1), np.zeros(n)
        windows = Windows(offsets)
        counts = np.array([x.phrases(symbols, offsets, windows=windows) for x in self.automata], np.float64)
        rate = counts * np.array([math.log2(x.size) for x in self.automata])[:, None] / np.maximum(size, 1)
        best = rate.argmin(0)
        low_rate = rate.min(0)
        second = np.partition(rate, 1, axis=0)[1] if len(self.langs) > 1 else np.full(n, np.inf)
        has = size > 0
        score = np.where(has, np.clip(1 - low_rate / np.maximum(second, 1e-12), 0, 1), 0.0)
        return np.where(has, best, -1), score


def held_out():
    """True for rows that must not be learnt from; false without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, passages_per_lang: int = PASSAGES_PER_LANG, passage: int = PASSAGE) -> dict[str, str]:
    """Training text of each language: a bounded sample of labelled rows, taken by a hash of id and place.

    All texts are cut into passages of ``passage`` characters and each passage of a language, wherever it lies in its
    text, is as likely to be taken. About 1.5 x passages_per_lang of them a language reach the driver; those of the
    least hashes are used. The driver also holds one count a language, as the model holds an automaton of each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(~held_out()).where("doc_id is not null and lang is not null and length(text) > 0")
    pieces = F.ceil(F.length("text") / F.lit(passage)).cast("long")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(pieces).alias("n")).collect()}
    if not counts:
        return {}
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, 1.5 * passages_per_lang / n) * (1 << 30)))).otherwise(share)
    draw = lambda k: F.pmod(F.xxhash64("doc_id", k, F.lit(17)), F.lit(1 << 30))
    drawn = F.filter(F.sequence(F.lit(0).cast("long"), pieces - 1), lambda k: draw(k) < share)
    cut = F.transform(drawn, lambda k: F.struct(draw(k).alias("draw"), F.substring("text", (k * passage + 1).cast("int"), F.lit(passage)).alias("text")))
    sample = rows.select("lang", F.explode(cut).alias("p")).select("lang", "p.*").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["draw"], r["text"])):
        own = texts.setdefault(r["lang"], [])
        if (t := letters(r["text"])) and t not in own and len(own) < passages_per_lang:
            own.append(t)
    return {lang: " ".join(own) for lang, own in texts.items() if own}


_MODELS: dict[str, Model] = {}


def _model(texts: dict[str, str]) -> Model:
    """Built once in each Python worker."""
    key = repr(sorted((k, hash(v)) for k, v in texts.items()))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(texts)
    return _MODELS[key]


def _predictor(texts: dict[str, str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(texts)
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in chunks(batches, "text"):
            best, score = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``, from its whole text.

    ``texts``: training text by language; by default learnt from ``docs``. A null text or one without a letter is
    ``und`` with score 0. Ties go to the language whose name sorts first. Rows of one id are told apart by nothing
    and each gets its own row; a row without an id is not learnt from. Without any labelled text all rows are ``und``;
    an empty table gives an empty result. Other columns are not read.
    """
    texts = learn(docs) if texts is None else texts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_predictor(texts), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
