"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

Words (runs of the blank mark and what follows) are cut between characters that stand side by side in no piece, where
no token can span, so that parts recur more often than words do. Each part is segmented once and remembered. New parts
of like lengths advance together, one character a step. At each end the hashes of all substrings that end there probe the sorted keys of the pieces, and the best of the candidates is
stored as a backpointer.

What is best follows from the kind of model. In a unigram model it is the largest sum of scores. In a BPE model it
is decided by stability: a segmentation is the one that merging makes exactly if merging any two neighbouring pieces
on their own leaves them as they are, so each prefix has exactly one last piece that is stable beside the last piece
of the prefix before it. Sums of BPE scores would give other ids than the model's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotweave.llm.arrow_text import chunks, give_back, utf8
from plotweave.llm.packing import Ids, Known

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_PENALTY = 10.0  # of an unknown character, below the least score of a unigram model
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(43)
_CODES = 0x110000
MAX_WORDS = 120_000  # words, and parts of words, that a Python worker remembers
CELLS = 600_000  # parts x characters x lengths of pieces that are worked on together
_PAIRS = 20  # log2 of the pairs of pieces that it remembers
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces(NamedTuple):
    """What a model file holds: pieces with scores and types, kind of model, whether a blank is put first."""

    names: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    prefix: bool
    fallback: bool


def read_pieces(path: str = MODEL) -> Pieces:
    """The pieces of a model file, read on the driver; models that rewrite texts otherwise are refused."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rule, spec = model.normalizer_spec, model.trainer_spec
    if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces or spec.treat_whitespace_as_suffix:
        raise ValueError("only models that keep texts as they are can be used")
    if spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be used")
    return Pieces([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], spec.model_type, rule.add_dummy_prefix, spec.byte_fallback)


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, pieces: Pieces):
        self.kind, self.prefix, self.size = pieces.kind, pieces.prefix, len(pieces.names)
        own = [i for i, t in enumerate(pieces.types) if t in (_NORMAL, _USER)]
        if any(MARK in pieces.names[i].lstrip(MARK) for i in own):
            raise ValueError("pieces must not hold a blank after another character")
        self.longest = max(len(pieces.names[i]) for i in own)
        self.powers = _BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        chars = np.zeros((len(own), self.longest), np.uint32)
        for row, i in enumerate(own):
            chars[row, : len(pieces.names[i])] = [ord(c) for c in pieces.names[i]]
        length = np.array([len(pieces.names[i]) for i in own])
        keys = np.zeros(len(own), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.longest):
                keys = np.where(k < length, keys * _BASE + chars[:, k] + np.uint64(1), keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], np.array(own, np.int64)[order]
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[self.keys >> _SHIFT] = True
        self.chars = np.zeros((self.size, self.longest), np.uint32)
        self.length = np.ones(self.size, np.int64)
        self.chars[own], self.length[own] = chars, length
        self.score = np.array(pieces.scores, np.float64)
        self.unknown_score = float(self.score[own].min()) - _PENALTY
        byte = {int(n[3:5], 16): i for i, (n, t) in enumerate(zip(pieces.names, pieces.types)) if t == _BYTE}
        self.bytes = np.array([byte.get(b, -1) for b in range(256)], np.int64)
        self.fallback = pieces.fallback and (self.bytes >= 0).all()
        self.unknown = next((i for i, t in enumerate(pieces.types) if t == _UNKNOWN), 0)
        raw = [b"" if t in (3, 5) else bytes([int(n[3:5], 16)]) if t == _BYTE else " ⁇ ".encode() if t == _UNKNOWN else n.replace(MARK, " ").encode() for n, t in zip(pieces.names, pieces.types)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.pairs = np.full(1 << _PAIRS, -1, np.int64)
        self._join(pieces, own)
        self.forget()
        if self.kind == BPE:
            self.whole = np.zeros(self.size, bool)
            for n in np.unique(length):
                of = np.array(own)[length == n]
                self.whole[of] = self._merged(self.chars[of, :n], np.full(len(of), n))[:, 0] == n

    def _join(self, pieces: Pieces, own: list[int]) -> None:
        """Classes of characters, and the pairs of classes between which a word isn't cut."""
        names = [pieces.names[i] for i in own]
        beside = {ab for name in names for ab in zip(name, name[1:])}
        chars = sorted({c for ab in beside for c in ab})
        single = {name for name in names if len(name) == 1}
        self.kinds = np.ones(_CODES, np.uint16)  # 1: unknown, 0: only a piece of its own
        self.kinds[[ord(c) for c in single]] = 0
        self.kinds[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        self.joined = np.zeros((len(chars) + 2, len(chars) + 2), bool)
        for a, b in beside:
            self.joined[self.kinds[ord(a)], self.kinds[ord(b)]] = True
        if not self.fallback:  # neighbouring unknown characters are one token
            odd = [1, *(k for k, c in enumerate(chars, 2) if c not in single)]
            self.joined[np.ix_(odd, odd)] = True

    def forget(self) -> None:
        """Drop the words and parts that are remembered."""
        self.words, self.word_ids, self.parts, self.part_ids = Known(), Ids(), Known(), Ids()

    def _found(self, chars: np.ndarray) -> np.ndarray:
        """(words, ends, lengths - 1): the piece that each substring is, or -1. chars: (words, characters)."""
        n, width = chars.shape
        out = np.full((n, width, min(self.longest, width)), -1, np.int32)
        prefix = np.zeros((n, width + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                prefix[:, k + 1] = prefix[:, k] * _BASE + chars[:, k] + np.uint64(1)
            for size in range(1, out.shape[2] + 1):
                key = prefix[:, size:] - prefix[:, :-size] * self.powers[size]
                row, end = np.nonzero(self.maybe[key >> _SHIFT])
                hit = key[row, end]
                at = np.minimum(np.searchsorted(self.keys, hit), len(self.keys) - 1)
                same = self.keys[at] == hit
                row, end, piece = row[same], end[same], self.ids[at[same]]
                same = self.length[piece] == size  # equal hashes are checked by the characters
                for k in range(size):
                    same &= self.chars[piece, k] == chars[row, end + k]
                out[row[same], end[same] + size - 1, size - 1] = piece[same]
        return out

    def _merged(self, chars: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(words, characters): the end of the symbol that starts at each place once all merges are done, or 0. Beyond its length a word has none."""
        n, width = chars.shape
        found = self._found(chars)
        place = np.arange(width)
        ends = np.where(place < length[:, None], place + 1, 0)
        live = np.flatnonzero(length > 1)
        while len(live):
            end = ends[live]
            beyond = np.concatenate([end, np.zeros((len(live), 1), np.int64)], axis=1)
            second = np.take_along_axis(beyond, end, axis=1)  # end of the next symbol, 0 beyond the last
            size = second - place
            can = (end > 0) & (second > 0) & (size <= found.shape[2])
            row, at = np.nonzero(can)
            piece = found[live[row], second[row, at] - 1, size[row, at] - 1]
            score = np.full(end.shape, -np.inf)
            score[row, at] = np.where(piece >= 0, self.score[piece], -np.inf)
            best = score.argmax(1)  # the leftmost of equals
            some = score[np.arange(len(live)), best] > -np.inf
            live, best, second, end = live[some], best[some], second[some], end[some]
            rows = np.arange(len(live))
            ends[live, end[rows, best]] = 0
            ends[live, best] = second[rows, best]
        return ends

    def _token_chars(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters and lengths of tokens; beyond the pieces a token is an unknown character."""
        piece = np.minimum(tokens, self.size - 1)
        chars = self.chars[piece].copy()
        unknown = tokens >= self.size
        chars[unknown] = 0
        chars[unknown, 0] = tokens[unknown] - self.size
        return chars, np.where(unknown, 1, self.length[piece])

    def _stable(self, left: np.ndarray, right: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether merging each pair of tokens on its own leaves both as they are; at most one pair of a row does.

        So a row that has a pair known to be stable needs no other pair tried, and all its others count as not stable.
        """
        keys = left * (self.size + _CODES) + right
        slot = (keys.astype(np.uint64) * _BASE >> np.uint64(64 - _PAIRS)).astype(np.int64)
        known = self.pairs[slot]  # twice the key, and 1 if stable
        same = known >> 1 == keys
        good = same & (known & 1 > 0)
        settled = np.zeros(row.max() + 1, bool)
        settled[row[good]] = True
        rest = np.flatnonzero(~same & ~settled[row])
        if len(rest):
            new, back = np.unique(keys[rest], return_inverse=True)
            a, b = new // (self.size + _CODES), new % (self.size + _CODES)
            (ca, la), (cb, lb) = self._token_chars(a), self._token_chars(b)
            whole, order = np.zeros(len(new), bool), np.argsort(la + lb)
            for i in range(0, len(order), 2048):
                rows = order[i : i + 2048]
                place, before, total = np.arange((la + lb)[rows[-1]]), la[rows, None], (la + lb)[rows]
                joined = np.where(place < before, ca[rows[:, None], np.minimum(place, self.longest - 1)], cb[rows[:, None], np.clip(place - before, 0, self.longest - 1)])
                ends = self._merged(joined, total)
                whole[rows] = (ends[:, 0] == la[rows]) & (ends[np.arange(len(rows)), la[rows]] == total)
            good[rest] = whole[back]
            self.pairs[slot[rest]] = 2 * keys[rest] + good[rest]
        return good

    def _viterbi(self, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words in order of length, one word after the other, and the number of tokens of each."""
        n, width = chars.shape
        found = self._found(chars)
        single = found[:, :, 0]
        found[:, :, 0] = np.where(single >= 0, single, self.size + chars)  # unknown characters are tokens for now
        last = np.zeros((n, width + 1), np.int64)
        back = np.zeros((n, width + 1), np.int64)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        for end in range(1, width + 1):
            shorter = int(np.searchsorted(length, end))
            sizes = np.arange(1, min(found.shape[2], end) + 1)
            token = found[shorter:, end - 1, : len(sizes)]
            value = np.full(token.shape, -np.inf)
            row, k = np.nonzero(token >= 0)
            at, what, own = end - sizes[k], token[row, k].astype(np.int64), shorter + row
            if self.kind == BPE:
                head = at == 0
                good = np.ones(len(row), bool)
                good[head] = np.where(what[head] < self.size, self.whole[np.minimum(what[head], self.size - 1)], True)
                if not head.all():
                    good[~head] = self._stable(last[own[~head], at[~head]], what[~head], row[~head])
                value[row, k] = np.where(good & (best[own, at] > -np.inf), 0.0, -np.inf)
            else:
                value[row, k] = best[own, at] + np.where(what < self.size, self.score[np.minimum(what, self.size - 1)], self.unknown_score)
            choice = value.argmax(1)
            rows = np.arange(len(token))
            best[shorter:, end], back[shorter:, end], last[shorter:, end] = value[rows, choice], sizes[choice], token[rows, choice]
        if not (best[np.arange(n), length] > -np.inf).all():
            raise AssertionError("a word has no segmentation")
        tokens, place = np.zeros((n, width), np.int64), length.copy()
        count, live = np.zeros(n, np.int64), np.arange(n)
        while len(live):
            tokens[live, width - 1 - count[live]] = last[live, place[live]]
            place[live] -= back[live, place[live]]
            count[live] += 1
            live = live[place[live] > 0]
        return tokens[np.arange(width) >= width - count[:, None]], count

    def _with_bytes(self, tokens: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as their bytes, or as the unknown piece."""
        odd = tokens >= self.size
        if not odd.any():
            return tokens, count
        owner = np.repeat(np.arange(len(count)), count)
        if not self.fallback:  # neighbouring unknown characters are one token
            again = odd & np.concatenate([[False], odd[:-1] & (owner[1:] == owner[:-1])])
            tokens = np.where(odd, self.unknown, tokens)[~again]
            return tokens, np.bincount(owner[~again], minlength=len(count))
        spelt = {int(t): [int(self.bytes[b]) for b in chr(int(t) - self.size).encode("utf-8", "surrogatepass")] for t in np.unique(tokens[odd])}
        size = np.ones(len(tokens), np.int64)
        size[odd] = [len(spelt[int(t)]) for t in tokens[odd]]
        out = np.repeat(tokens, size)
        first = np.cumsum(size) - size
        for at, t in zip(first[odd].tolist(), tokens[odd].tolist()):
            out[at : at + len(spelt[t])] = spelt[t]
        return out, np.bincount(owner, size, len(count)).astype(np.int64)

    def _segmented(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after the other, and the number of each; parts are worked on in order of length."""
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(length, kind="stable")
        found, i = Ids(), 0
        cells = length[order] * np.minimum(length[order], self.longest)  # what a part takes if it is the longest of its batch
        while i < len(order):
            most = np.flatnonzero(cells[i:] * np.arange(1, len(order) - i + 1) > CELLS) if CELLS < cells[-1] * (len(order) - i) else []
            own = order[i : i + max(1, int(most[0]))] if len(most) else order[i:]
            size = length[own]
            chars = np.zeros((len(own), size[-1]), np.uint32)
            chars[np.arange(size[-1]) < size[:, None]] = np.frombuffer("".join([parts[k] for k in own.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
            tokens, count = self._with_bytes(*self._viterbi(chars, size))
            found.add(tokens.astype(np.uint32), count)
            i += len(own)
        place = np.empty(len(parts), np.int64)
        place[order] = np.arange(len(parts))
        return found.of(place)

    def _learn(self) -> None:
        """Cut the words that are new, segment the parts that are new, and remember both."""
        fresh, self.words.fresh = self.words.fresh, []
        if not fresh:
            return
        mark = MARK if self.prefix else ""
        text = mark + mark.join(fresh)
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh)) + len(mark)
        kinds = self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        first = np.concatenate([[True], ~self.joined[kinds[:-1], kinds[1:]]])
        starts = np.cumsum(sizes) - sizes
        first[starts] = True
        cuts = np.flatnonzero(first).tolist()
        numbers = self.parts.numbers([text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])])
        new, self.parts.fresh = self.parts.fresh, []
        if new:
            self.part_ids.add(*self._segmented(new))
        flat, count = self.part_ids.of(numbers)
        self.word_ids.add(flat, np.add.reduceat(count, (np.cumsum(first) - 1)[starts]))

    def split(self, text: str) -> list[str]:
        """The words of a text, with the marks of the blanks before each; the first mark is left out if one is put first."""
        if not text:
            return []
        if not self.prefix:
            return _WORD.findall(text.replace(" ", MARK))
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each."""
        if len(self.words) > MAX_WORDS:
            self.words, self.word_ids = Known(), Ids()
        if len(self.parts) > MAX_WORDS:
            self.parts, self.part_ids = Known(), Ids()
        split = [self.split(t or "") for t in texts]
        code = self.words.numbers(list(chain.from_iterable(split)))
        self._learn()
        ids, sizes = self.word_ids.of(code)
        total = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return ids.astype(np.int32), total[np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, one after the other, and the offsets of each; the blank put first is dropped."""
        ids = ids.astype(np.int64)
        sizes = self.raw_size[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = self.raw[np.repeat(self.raw_start[ids] - total[:-1], sizes) + np.arange(total[-1])]
        at = total[offsets]
        if self.prefix and len(out):
            keep = np.ones(len(out), bool)
            head = at[:-1][at[:-1] < at[1:]]
            keep[head[out[head] == 32]] = False
            out, at = out[keep], np.concatenate([[0], np.cumsum(keep)])[at]
        return out, at


_CODECS: dict[str, Codec] = {}


def _codec(pieces: Pieces) -> Codec:
    """Built once in each Python worker."""
    key = repr((pieces.kind, len(pieces.names), hash(tuple(pieces.names)), hash(tuple(pieces.scores))))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(pieces)
    return _CODECS[key]


def _encoder(shared, keep: list[str]):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in chunks(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids, offsets = codec.encode(texts)
            data, at = codec.decode(ids, offsets)
            source, of = utf8(pa.array([t or "" for t in texts], pa.large_string()))
            same = np.diff(at) == np.diff(of)
            if not (same.all() and np.array_equal(data, source)):
                same = np.array([s and np.array_equal(data[at[i] : at[i + 1]], source[of[i] : of[i + 1]]) for i, s in enumerate(same)], bool)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array(np.diff(offsets)), pa.array(same)], [*keep, "ids", "n_tokens", "round_trip"])
            del batch, texts, ids, offsets, data, at, source, of, same, lists
        codec.forget()  # workers wait idle beside the tasks of later stages
        give_back()

    return encoded


def encode_documents(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of every row of ``docs``; ids are those of the model's own encoder.

    round_trip: decoding the ids gives the text, which fails where it holds a literal blank mark: that is read as a blank, as the model has
    no other sign for it. A null text has no ids. Repeated rows are repeated; other columns are not read. The model
    is read on the driver and sent once to each executor; its size doesn't depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoder(shared, ["doc_id"]), "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def _decoder(shared):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            offsets = np.asarray(lists.offsets).astype(np.int64)
            data, at = codec.decode(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0])
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string())], ["doc_id", "text"])

    return decoded


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids are an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_pieces(path))
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(shared), "doc_id long, text string")
