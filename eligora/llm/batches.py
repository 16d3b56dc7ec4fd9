"""Whole texts of an Arrow batch as NumPy arrays: bytes, words and their hashes.

An Arrow batch is worked off in blocks of a bounded number of bytes, so that the
arrays per byte or word stay small however many rows a batch has; a single text
beyond the bound is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the one of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random64(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(_BASE))


BYTE_VALUE = random64(256, 1)


@lru_cache(maxsize=2)
def _powers(n: int) -> np.ndarray:
    inverse = np.full(n, np.uint64(_BASE_INVERSE))
    inverse[0] = 1
    return np.multiply.accumulate(inverse)


@lru_cache(maxsize=2)
def _bases(n: int) -> np.ndarray:
    base = np.full(n, np.uint64(_BASE))
    base[0] = 1
    return np.multiply.accumulate(base)


def _room(n: int) -> int:
    return max(BLOCK_BYTES + (1 << 16), 1 << int(n).bit_length())


@dataclass
class Block:
    """Texts ``rows`` of the batch; text i is data[starts[i]:ends[i]], a line feed stands between texts."""

    rows: slice
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of consecutive rows; a null text is empty."""
    texts = [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
    low, size = 0, 0
    for high in range(len(texts) + 1):
        if high == len(texts) or (size + len(texts[high]) > limit and high > low):
            if high > low:
                part = texts[low:high]
                lengths = np.fromiter(map(len, part), np.int64, len(part))
                ends = np.cumsum(lengths + 1) - 1
                yield Block(slice(low, high), np.frombuffer(b"\n".join(part) + b"\n", np.uint8), ends - lengths, ends)
            low, size = high, 0
        if high < len(texts):
            size += len(texts[high]) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], from the bytes alone."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * _powers(_room(n))[:n], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _bases(_room(n))[starts]
    return mix(raw ^ (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def word_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word between ASCII white space, and for each text its first word's number (one more at the end)."""
    space = SPACE[block.data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(block.data) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    first = np.searchsorted(starts, np.append(block.starts, len(block.data)))
    return starts, ends, first


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive hashes."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k, salt in enumerate(random64(width, 2) | np.uint64(1)):
        out = mix(out + hashes[k:k + n] * salt)
    return out


class HashIndex:
    """Integer values by non-zero 64-bit keys: open addressing with whole arrays of keys at a time."""

    def __init__(self, bits: int) -> None:
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> HashIndex:
        index = cls(max(4, int(2 * len(keys)).bit_length()))
        index.insert(keys, values)
        return index

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct new keys; the table grows so that it stays at most half full."""
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            held = self.keys != 0
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self.bits = int(2 * self.count).bit_length()
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        at, last = self._home(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            won = free & (self.keys[at] == keys)
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & last

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where a key is not there."""
        at, last = self._home(keys), (1 << self.bits) - 1
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there != 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & last
            there, wanted = self.keys[at], keys[open_]
            hit = there == wanted
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (there != 0)
            open_, at = open_[go], at[go]
        return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all spans [start, start + length), one span after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
