"""SentencePiece encoding and decoding by suffix-array matching.

Encoding works on units: a run of blanks with what follows it up to the next
blank.  No piece of the vocabulary reaches from one unit into another, so every
distinct unit is encoded once per worker.  New units of a batch are concatenated;
a suffix array of the concatenation (sorted to the length of the longest piece)
is searched for every piece, which gives the piece's occurrences as a range.  The
occurrences are the edges of a lattice over the text.  They are sorted by position
and relaxed in the order of the vocabulary's scores: of all edges that span two
neighbouring symbols of a unit the best is taken, the leftmost first, until no
edge is left.  That is the library's segmentation for vocabularies of merged pairs
(a plain best path through the lattice would not be).  Characters without a piece
become their bytes.

Decoding joins the pieces' bytes, turns the blank mark into a blank and takes off
the one that encoding put in front.

Null texts give null ids and back; empty texts give none.  A literal blank mark
(U+2581) comes back as a blank, as in the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligora.llm.batches import BLOCK_BYTES, HashIndex, ragged, span_hashes
from eligora.llm.wordbpe import grown

MARK = "▁"
END = 0x110000  # beyond all characters, after each unit
_LAST = np.iinfo(np.int32).max


class Vocabulary:
    """Pieces of a SentencePiece file as arrays."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        texts, ids = [], []
        shown: list[bytes] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                shown.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                shown.append(b"")
            else:
                texts.append(piece)
                ids.append(i)
                shown.append(piece.replace(MARK, " ").encode())
        # the best score first; pieces of one score in the order of their ids
        order = sorted(range(len(ids)), key=lambda k: (-model.get_score(ids[k]), ids[k]))
        self.ids = np.array([ids[k] for k in order], np.int32)
        self.longest = max(map(len, texts))
        self.letters = np.zeros((len(order), self.longest), np.uint32)
        self.lengths = np.array([len(texts[k]) for k in order])
        for row, k in enumerate(order):
            self.letters[row, :len(texts[k])] = list(map(ord, texts[k]))
        lengths = np.array([len(x) for x in shown], np.int64)
        self.shown_length, self.shown_start = lengths, np.cumsum(lengths) - lengths
        self.shown = np.frombuffer(b"".join(shown), np.uint8)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of their next ``depth`` values (doubling)."""
    _, rank = np.unique(text, return_inverse=True)
    step = 1
    while step < depth:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-step] = rank[step:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 1) + ahead, return_inverse=True)
        step *= 2
    return np.argsort(rank, kind="stable")


def _lower_bound(text: np.ndarray, order: np.ndarray, depth: int, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """In each range [low, high) of the suffix array the first suffix whose value at ``depth`` is at least ``wanted``."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        below = open_ & (text[np.minimum(order[np.minimum(middle, len(order) - 1)] + depth, len(text) - 1)] < wanted)
        low = np.where(below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)


def occurrences(text: np.ndarray, order: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its range in the suffix array, by binary search letter after letter."""
    low = np.zeros(len(vocabulary.ids), np.int64)
    high = np.full(len(vocabulary.ids), len(order))
    for depth in range(vocabulary.longest):
        at = np.flatnonzero((vocabulary.lengths > depth) & (low < high))
        wanted = vocabulary.letters[at, depth]
        first = _lower_bound(text, order, depth, wanted, low[at], high[at])
        high[at] = _lower_bound(text, order, depth, wanted + np.uint32(1), first, high[at])
        low[at] = first
    return low, high


def segment(units: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units one after the other, and the number of ids of each."""
    letters = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    sizes = np.array(list(map(len, units)))
    stop = np.zeros(len(letters) + len(units), bool)
    stop[np.cumsum(sizes + 1) - 1] = True
    text = np.full(len(stop), END, np.uint32)
    text[~stop] = np.where(letters == 0x20, np.uint32(ord(MARK)), letters)
    order = suffix_array(text, vocabulary.longest)
    low, high = occurrences(text, order, vocabulary)
    piece = np.repeat(np.arange(len(low), dtype=np.int32), high - low)
    start = order[ragged(low, high - low)]
    keys = start * 32 + vocabulary.lengths[piece]
    by_place = np.argsort(keys, kind="stable")
    keys, piece = keys[by_place], piece[by_place]

    def edge(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The piece from ``at`` over ``length`` letters, _LAST where there is none."""
        wanted = np.where(length < 32, at * 32 + length, -1)
        k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[k] == wanted, piece[k], _LAST) if len(keys) else np.full(len(at), _LAST)

    begin = np.flatnonzero(~stop)
    unit = (np.cumsum(stop) - stop)[begin]
    size = np.ones(len(begin), np.int64)
    done_begin, done_size, done_unit = [], [], []
    while len(begin):
        rank = np.full(len(begin), _LAST)
        both = np.flatnonzero(unit[1:] == unit[:-1])
        rank[both] = edge(begin[both], size[both] + size[both + 1])
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(unit))))
        over = least == _LAST
        done_begin.append(begin[over])
        done_size.append(size[over])
        done_unit.append(unit[over])
        at = np.flatnonzero((rank == least) & ~over)
        stay = ~over
        if len(at):
            lead = np.append(True, np.diff(at) != 1)
            run = np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            size[at] += size[at + 1]
            stay[at + 1] = False
        begin, size, unit = begin[stay], size[stay], unit[stay]
    begin, size, unit = (np.concatenate(x) for x in (done_begin, done_size, done_unit))
    by_begin = np.argsort(begin)
    begin, size, unit = begin[by_begin], size[by_begin], unit[by_begin]
    found = edge(begin, size)
    ids = np.append(vocabulary.ids, 0)[np.minimum(found, len(vocabulary.ids))]
    counts = np.ones(len(begin), np.int64)
    unknown = np.flatnonzero(found == _LAST)
    if len(unknown):
        raw = [chr(c).encode() for c in text[begin[unknown]].tolist()]
        counts[unknown] = [len(r) for r in raw]
        out = np.zeros(int(counts.sum()), np.int32)
        at = np.cumsum(counts) - counts
        out[at] = ids
        out[ragged(at[unknown], counts[unknown])] = vocabulary.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        ids = out
    return ids, np.bincount(unit, counts, len(units)).astype(np.int64)


class Encoder:
    """Encodes texts, remembering units until there are ``limit`` of them."""

    def __init__(self, path: str, limit: int = 400_000) -> None:
        self.vocabulary, self.limit = Vocabulary(path), limit
        self._forget()

    def _forget(self) -> None:
        self.index, self.begin, self.length = HashIndex(16), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.pool, self.used = np.zeros(1 << 14, np.int32), 0

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        if self.index.count > self.limit:
            self._forget()
        full = [b" " + t for t in texts if t]
        data = np.frombuffer(b"\n".join(full) + b"\n", np.uint8)
        sizes = np.array([len(t) for t in full], np.int64)
        ends_text = np.cumsum(sizes + 1) - 1
        blank = data == 0x20
        starts = np.flatnonzero(blank & ~np.append(False, blank[:-1]))
        first = np.searchsorted(starts, np.append(ends_text - sizes, len(data)))
        ends = np.append(starts[1:], 0)
        ends[first[1:] - 1] = ends_text
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        hashes = span_hashes(data, starts, ends) | np.uint64(1)
        known = self.index.find(hashes)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            fresh, at = np.unique(hashes[missing], return_index=True)
            at, raw = missing[at], data.tobytes()
            ids, counts = segment([raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())], self.vocabulary)
            low, high = self.index.count, self.index.count + len(fresh)
            self.begin, self.length, self.pool = grown(self.begin, high), grown(self.length, high), grown(self.pool, self.used + len(ids))
            self.begin[low:high] = self.used + np.cumsum(counts) - counts
            self.length[low:high] = counts
            self.pool[self.used:self.used + len(ids)] = ids
            self.used += len(ids)
            self.index.insert(fresh, np.arange(low, high, dtype=np.int32))
            known[missing] = self.index.find(hashes[missing])
        lengths = self.length[known]
        counts = np.zeros(len(texts), np.int64)
        counts[[bool(t) for t in texts]] = np.diff(np.append(0, np.cumsum(lengths))[first])
        return self.pool[ragged(self.begin[known], lengths)], counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        v = self.vocabulary
        lengths = v.shown_length[ids]
        data = v.shown[ragged(v.shown_start[ids], lengths)].tobytes()
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))].tolist()
        return [data[a + (data[a:a + 1] == b" "):b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    low = total = 0
    for high, size in enumerate(sizes):
        if total + size > limit and high > low:
            yield low, high
            low, total = high, 0
        total += size
    if low < len(sizes):
        yield low, len(sizes)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), limit: int = BLOCK_BYTES) -> DataFrame:
    """The ``keep`` columns and ``ids``: little-endian unsigned 32-bit ids of the column ``text``."""
    names = [*keep, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for low, high in _runs([len(t or b"") for t in texts], limit):
                ids, counts = model.encode([t or b"" for t in texts[low:high]])
                raw, at = ids.astype("<u4").tobytes(), np.append(0, np.cumsum(counts) * 4).tolist()
                made = [None if t is None else raw[a:b] for t, a, b in zip(texts[low:high], at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([*(c[low:high] for c in batch.columns[1:]), pa.array(made, pa.binary())], names)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(F.col("text").cast("string").alias("_t"), *keep).mapInArrow(run, f"{types}, ids binary")


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), limit: int = BLOCK_BYTES) -> DataFrame:
    """The ``keep`` columns and ``decoded``: the texts of the column ``ids``."""
    names = [*keep, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for low, high in _runs([len(r or b"") for r in rows], limit):
                part = rows[low:high]
                texts = model.decode(np.frombuffer(b"".join(r or b"" for r in part), "<u4").astype(np.int64), np.array([len(r or b"") // 4 for r in part]))
                yield pa.RecordBatch.from_arrays([*(c[low:high] for c in batch.columns[1:]), pa.array([None if r is None else t for r, t in zip(part, texts)], pa.string())], names)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)
    return encoded.select(F.col("ids").alias("_i"), *keep).mapInArrow(run, f"{types}, decoded string")
