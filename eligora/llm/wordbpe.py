"""Token ids of a word-level BPE vocabulary for whole batches of texts.

The vocabulary lower-cases, drops white space and never joins symbols across it,
so a text's ids are those of its words in order.  Each distinct word is encoded
once per worker.  Words of Latin letters with trailing ASCII marks are merged all
together in NumPy, by the ranks in the tokenizer's own file; every other word goes
to the ``tokenizers`` library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from eligora.llm.batches import Block, HashIndex, ragged, span_hashes, word_spans

PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[!-&(-/:;=>?@\\[-`{-~]*")
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies (the published rule)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordEncoder:
    """Ids of words, remembered until there are ``limit`` distinct words and then begun anew."""

    def __init__(self, path: str, limit: int = 600_000) -> None:
        from tokenizers import Tokenizer

        self.library, self.limit = Tokenizer.from_file(path), limit
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocabulary[x] for x in letters], np.int32)
        self.final = np.array([vocabulary[x + end] for x in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.uint64)
        right = np.array([vocabulary[b] for _, b in pairs], np.uint64)
        self.joined = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.ranks = HashIndex.of((left << np.uint64(20) | right) + np.uint64(1), np.arange(len(pairs), dtype=np.int32))
        self._forget()

    def _forget(self) -> None:
        self.index = HashIndex(16)
        self.begin, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.pool, self.used = np.zeros(1 << 14, np.int32), 0

    def merge(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs of letters and of marks in ``data`` (words, each ended by a line feed), and how many each word has."""
        stop = data == 10
        letter = (data >= 97) & (data <= 122) | (data >= 128)
        kind = np.where(stop, 2, letter).astype(np.int8)
        new = np.append(True, kind[1:] != kind[:-1])
        word = np.cumsum(stop) - stop
        ends_run = np.append(new[1:], True)
        symbols = np.where(ends_run, self.final[data], self.inner[data])
        run, keep = np.cumsum(new), ~stop
        symbols, run, word = symbols[keep], run[keep], word[keep]
        n_words = int(stop.sum())
        done_symbols, done_words, done_places = [], [], []
        place = np.arange(len(symbols))
        while len(symbols):
            rank = np.full(len(symbols), _NONE, np.int32)
            both = np.flatnonzero(run[1:] == run[:-1])
            found = self.ranks.find((symbols[both].astype(np.uint64) << np.uint64(20) | symbols[both + 1].astype(np.uint64)) + np.uint64(1))
            rank[both] = np.where(found < 0, _NONE, found)
            first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            sizes = np.diff(np.append(first, len(run)))
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            over = least == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                done_places.append(place[over])
            at = np.flatnonzero((rank == least) & ~over)
            if len(at):
                lead = np.append(True, np.diff(at) != 1)
                start = np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
                symbols[at] = self.joined[rank[at]]
            stay = ~over
            stay[at + 1] = False
            symbols, run, word, place = symbols[stay], run[stay], word[stay], place[stay]
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(n_words, np.int64)
        order = np.argsort(np.concatenate(done_places), kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(np.concatenate(done_words), minlength=n_words)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((PLAIN.fullmatch(w) is not None for w in words), bool, len(words))
        fast = "".join(w + "\n" for w, p in zip(words, plain) if p).lower().encode()
        fast_ids, fast_counts = self.merge(np.frombuffer(fast, np.uint8))
        slow = [x.ids for x in self.library.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False)]
        counts = np.zeros(len(words), np.int64)
        counts[plain] = fast_counts
        counts[~plain] = list(map(len, slow))
        starts = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.int32)
        ids[ragged(starts[plain], counts[plain])] = fast_ids
        ids[ragged(starts[~plain], counts[~plain])] = [i for x in slow for i in x]
        return ids, counts

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block one after the other, and the number of ids of each text."""
        starts, ends, first = word_spans(block)
        hashes = span_hashes(block.data, starts, ends) | np.uint64(1)
        if self.index.count > self.limit:
            self._forget()
        known = self.index.find(hashes)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            fresh, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            raw = block.data.tobytes()
            ids, counts = self._learn([raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            low, high = self.index.count, self.index.count + len(fresh)
            self.begin, self.length = grown(self.begin, high), grown(self.length, high)
            self.pool = grown(self.pool, self.used + len(ids))
            self.begin[low:high] = self.used + np.cumsum(counts) - counts
            self.length[low:high] = counts
            self.pool[self.used:self.used + len(ids)] = ids
            self.used += len(ids)
            self.index.insert(fresh, np.arange(low, high, dtype=np.int32))
            known[missing] = self.index.find(hashes[missing])
        lengths = self.length[known]
        ids = self.pool[ragged(self.begin[known], lengths)]
        return ids, np.diff(np.append(0, np.cumsum(lengths))[first])


def grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The encoder of this worker."""
    return WordEncoder(path)
