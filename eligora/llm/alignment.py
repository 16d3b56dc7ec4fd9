"""Alignment of two tokenizers' tokens over the bytes of whole texts.

A is a byte-level BPE file, B a SentencePiece file; both encode a blank and the text.
Byte offsets where tokens of both end cut a text into groups; an A and a B token
whose byte ranges overlap are linked.  Two tokens that make up a group of their own
have the same bytes, so an array built once, the B id with the same bytes for each A
id, tells such a group's link from its A id.  These are counted in one vector of the
vocabulary's length per task.  Only links of irregular groups are shuffled as pairs,
and of those each block of texts sends its distinct pairs with their numbers.

Units make this fast: a text is cut before a blank between two characters that are
neither blanks nor rare kinds of space.  Neither tokenizer joins anything across such
a place, which is checked for the pieces of B, so a unit's tokens, links and groups
are those it has in every text; each distinct unit is encoded once per worker.

1. One pass encodes the texts in blocks of about ``BLOCK_TEXT`` bytes and stores, per
   block, its distinct units' ids, each text as a list of units, and the distinct
   irregular pairs; per task the vector of exact groups.
2. Pairs are counted by grouping over all blocks and tasks.
3. The counts of a block's pairs meet its texts (one row per distinct pair and block
   instead of one per link); the rest is two vectors of the vocabularies' lengths,
   the only things that pass through the driver.

Null and empty texts, and texts whose joined token bytes differ from blank and text
in A or in B (such as ones with a literal U+2581), have no tokens: all numbers are 0
and ``groups`` is ''.  Rows with a null doc_id and repeated rows are texts like all
others.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligora.llm.batches import Block, HashIndex, blocks, ragged, span_hashes
from eligora.llm.stored import stored
from eligora.llm.wordbpe import byte_letters, grown
from eligora.session import cut

BLOCK_TEXT = 4 << 20
MARK = "▁"
ENCODED = "block long, doc_id long, units binary, ids_a binary, sizes_a binary, ids_b binary, sizes_b binary, a int, b int, n long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
_MASK = (1 << 32) - 1


def a_token_bytes(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level BPE file."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    byte = {letter: b for b, letter in enumerate(byte_letters())}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def b_token_bytes(path: str) -> list[bytes]:
    """Bytes of every id of a SentencePiece file; the blank mark is a blank, control pieces have none."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    kinds = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if kinds(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(model.get_piece_size())]


def identity(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each A id the B id with the same bytes (a whole piece before a byte piece), or -1."""
    known: dict[bytes, int] = {}
    for i, token in enumerate(b):
        if token:
            known[token] = i  # later ids are whole pieces, byte pieces come first in such files
    return np.array([known.get(token, -1) for token in a], np.int64)


def unit_starts(block: Block) -> np.ndarray:
    """Where units begin: at the start of each text and before blanks between two plain characters."""
    d = np.concatenate([np.zeros(3, np.uint8), block.data, np.zeros(1, np.uint8)])
    ascii_ = (d > 0x20) & (d < 0x7F)
    two, three = (d >= 0xC3) & (d <= 0xDF), (d >= 0xE4) & (d <= 0xED)
    more = (d >= 0x80) & (d < 0xC0)
    before = ascii_[2:-2] | two[1:-3] & more[2:-2] | three[:-4] & more[1:-3] & more[2:-2]
    after = ascii_[4:] | two[4:] | three[4:]
    return np.union1d(np.flatnonzero((block.data == 0x20) & before & after), block.starts[block.ends > block.starts])


class Vocabularies:
    """Token bytes of both sides and the identity array."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a_bytes, self.b_bytes = a_token_bytes(a_path), b_token_bytes(b_path)
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.identity = identity(self.a_bytes, self.b_bytes)


@dataclass
class Aligned:
    """Alignment of texts: per text the numbers of tokens, groups and links; all links (A id * 2^32 + B id), and which of them are exact groups."""

    numbers: np.ndarray
    links: np.ndarray
    exact: np.ndarray
    shown: list[str]


def align(v: Vocabularies, a: np.ndarray, count_a: np.ndarray, b: np.ndarray, count_b: np.ndarray, show: bool) -> Aligned:
    """Aligns texts given as their ids one after the other; a text has the same bytes on both sides, or no tokens.  ``show``: write the groups as text."""
    end_a, end_b = np.cumsum(v.a_length[a]), np.cumsum(v.b_length[b])
    ends = np.union1d(end_a, end_b)
    of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    common = (end_a[of_a] == ends) & (end_b[of_b] == ends)
    links = a[of_a] << 32 | b[of_b]
    exact = common & np.append(True, common[:-1])[:len(common)] & (v.identity[a[of_a]] == b[of_b])
    close = np.append(0, end_a)[np.cumsum(count_a)]  # where the texts end
    at = np.searchsorted(ends, close, side="right")
    numbers = np.column_stack([count_a, count_b, np.diff(np.append(0, np.cumsum(common))[at], prepend=0), np.diff(at, prepend=0)])
    shown: list[str] = []
    if show:
        cuts = ends[common]
        order = np.argsort(np.concatenate([2 * np.searchsorted(cuts, end_a), 2 * np.searchsorted(cuts, end_b) + 1]), kind="stable")
        mark = np.concatenate([np.isin(end_a, cuts).astype(int), 2 * np.isin(end_b, cuts)])[order]
        tokens = [f"{i}{',|;'[m]}" for i, m in zip(np.concatenate([a, b])[order].tolist(), mark.tolist())]
        edge = np.append(0, np.cumsum(count_a + count_b)).tolist()
        shown = ["".join(tokens[s:e])[:-1] for s, e in zip(edge[:-1], edge[1:])]
    return Aligned(numbers, links, exact, shown)


class Encoder:
    """Ids of units on both sides, remembered until there are ``limit`` distinct ones and then begun anew."""

    def __init__(self, a_path: str, b_path: str, limit: int = 800_000) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b, self.limit = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path), limit
        self.a.encode_special_tokens = True
        self.v = Vocabularies(a_path, b_path)
        self.local = not any(re.search(f"[^{MARK}]{MARK}", self.b.id_to_piece(i)) for i in range(len(self.v.b_bytes)))
        self.forget()

    def forget(self) -> None:
        self.index = HashIndex(16)
        self.pools = [np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)]
        self.begin = [np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)]
        self.size = [np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)]
        self.used = [0, 0]

    def _learn(self, units: list[bytes], hashes: np.ndarray) -> None:
        texts = [u.decode() for u in units]
        both = [[x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)],
                self.b.encode([t[1:] for t in texts], num_threads=1)]  # B puts the blank in front itself
        table_a, table_b = self.v.a_bytes, self.v.b_bytes
        for i, (u, x, y) in enumerate(zip(units, *both)):
            if b"".join([table_a[k] for k in x]) != u or b"".join([table_b[k] for k in y]) != u:
                both[0][i] = both[1][i] = []  # a unit without tokens is one that its text can't be read back from
        low, high = self.index.count, self.index.count + len(units)
        for k, ids in enumerate(both):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.begin[k], self.size[k] = grown(self.begin[k], high), grown(self.size[k], high)
            self.begin[k][low:high], self.size[k][low:high] = self.used[k] + np.cumsum(sizes) - sizes, sizes
            total = int(sizes.sum())
            self.pools[k] = grown(self.pools[k], self.used[k] + total)
            self.pools[k][self.used[k]:self.used[k] + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
            self.used[k] += total
        self.index.insert(hashes, np.arange(low, high, dtype=np.int32))

    def units(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of a block of texts (each with its blank in front), and for each text its first unit (one more at the end)."""
        starts = unit_starts(block) if self.local else block.starts[block.ends > block.starts]
        text = np.searchsorted(block.starts, starts, side="right") - 1
        ends = np.minimum(np.append(starts[1:], len(block.data)), block.ends[text])
        hashes = span_hashes(block.data, starts, ends) | np.uint64(1)
        known = self.index.find(hashes)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            fresh, at = np.unique(hashes[missing], return_index=True)
            at, raw = missing[at], block.data.tobytes()
            self._learn([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())], fresh)
            known[missing] = self.index.find(hashes[missing])
        first = np.searchsorted(text, np.arange(len(block.starts) + 1))
        bad = np.append(0, np.cumsum(self.size[0][known] == 0))
        spoilt = np.flatnonzero(bad[first[1:]] > bad[first[:-1]])
        if len(spoilt):  # texts with such a unit have no tokens at all
            keep = ~np.isin(text, spoilt)
            known, text = known[keep], text[keep]
            first = np.searchsorted(text, np.arange(len(block.starts) + 1))
        return known, first

    def ids(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and sizes, ids of B and sizes."""
        out = []
        for pool, begin, size in zip(self.pools, self.begin, self.size):
            out += [pool[ragged(begin[units], size[units].astype(np.int64))].astype(np.int64), size[units].astype(np.int64)]
        return tuple(out)


@lru_cache(maxsize=1)
def encoder(a_path: str, b_path: str) -> Encoder:
    """The encoder of this worker."""
    return Encoder(a_path, b_path)


@lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


def blanked(texts: pa.Array) -> Iterator[Block]:
    """Blocks of the texts with a blank in front; null and empty texts stay empty."""
    return blocks(pa.array([b" " + t if t else b"" for t in texts.cast(pa.large_binary()).to_pylist()], pa.large_binary()))


def _rows(size: int, **columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in ENCODED.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in ENCODED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[x], t) if x in columns else pa.nulls(size, t) for x, t in zip(names, types)], names)


def encoded(docs: DataFrame, a_path: str, b_path: str, block_text: int = BLOCK_TEXT) -> DataFrame:
    """Stored rows of three kinds: (block, doc_id, units), a text as numbers of units of its block; (block, ids_a, sizes_a,
    ids_b, sizes_b), the block's units; (block, a, b, n), its irregular links, or with a null block exact groups of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e = encoder(a_path, b_path)
        vector = np.zeros(len(e.v.a_bytes), np.int64)
        number, size, held = TaskContext.get().partitionId() << 32, 0, []

        def pairs(block, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 100_000):
                part = keys[k:k + 100_000]
                yield _rows(len(part), block=[block] * len(part), a=(part >> 32).astype(np.int32), b=(part & _MASK).astype(np.int32), n=n[k:k + 100_000])

        def close() -> Iterator[pa.RecordBatch]:
            distinct, at, n = np.unique(np.concatenate([known for _, known, _ in held]), return_inverse=True, return_counts=True)
            ids_a, sizes_a, ids_b, sizes_b = e.ids(distinct)
            low = 0
            for keys, known, first in held:
                raw = at[low:low + len(known)].astype("<i4").tobytes()
                low += len(known)
                yield _rows(len(keys), block=[number] * len(keys), doc_id=keys, units=[raw[4 * s:4 * t] for s, t in zip(first[:-1].tolist(), first[1:].tolist())])
            binary = {k: [x.astype("<i4").tobytes()] for k, x in zip(("ids_a", "sizes_a", "ids_b", "sizes_b"), (ids_a, sizes_a, ids_b, sizes_b))}
            yield _rows(1, block=[number], **binary)
            made = align(e.v, ids_a, sizes_a, ids_b, sizes_b, show=False)
            n = np.repeat(n, made.numbers[:, 3])
            vector[:] += np.bincount(made.links[made.exact] >> 32, n[made.exact], len(vector)).astype(np.int64)
            keys, where = np.unique(made.links[~made.exact], return_inverse=True)
            yield from pairs(number, keys, np.bincount(where, n[~made.exact], len(keys)).astype(np.int64))

        for batch in batches:
            for block in blanked(batch.column(1)):
                if size + len(block.data) > block_text and held:
                    yield from close()
                    number, size, held = number + 1, 0, []
                    if e.index.count > e.limit:
                        e.forget()
                known, first = e.units(block)
                held.append((batch.column(0)[block.rows], known, first))
                size += len(block.data)
        if held:
            yield from close()
        seen = np.flatnonzero(vector)
        yield from pairs(None, seen << 32 | e.v.identity[seen], vector[seen])

    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED), "alignment")


def counted(kept: DataFrame) -> DataFrame:
    """(a, b, count): how many links of the corpus hold each pair of ids."""
    return kept.where("n is not null").groupBy("a", "b").agg(F.sum("n").alias("count"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a, b, count) over all texts."""
    return counted(encoded(docs, a_path, b_path))


def alignments(docs: DataFrame, a_path: str, b_path: str, block_text: int = BLOCK_TEXT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is a most frequent one of its B id), count_sum (of the pairs' counts over the links), groups (``a1,a2|b1;...``)."""
    kept = encoded(docs, a_path, b_path, block_text)
    counts = cut(counted(kept))
    exact = kept.where("n is not null and block is null").select("a", "b").distinct().join(counts, ["a", "b"]).select("a", "count").toArrow()
    top = counts.groupBy("b").agg(F.max("count").alias("count")).toArrow()
    vectors = docs.sparkSession.sparkContext.broadcast((exact["a"].to_numpy(), exact["count"].to_numpy(), top["b"].to_numpy(), top["count"].to_numpy()))
    of_block = kept.where("n is not null and block is not null").select(F.col("block").alias("of"), "a", "b").join(counts, ["a", "b"])
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RESULT.split(", ")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        v = vocabularies(a_path, b_path)
        of_a, best = np.zeros(len(v.a_bytes), np.int64), np.zeros(len(v.b_bytes), np.int64)
        a, n_a, b, n_b = vectors.value
        of_a[a], best[b] = n_a, n_b
        keys = right["a"].to_numpy().astype(np.int64) << 32 | right["b"].to_numpy()
        order = np.argsort(keys)
        keys, of_pair = keys[order], right["count"].to_numpy()[order]
        whole = left.filter(left["ids_a"].is_valid())
        ids = [np.frombuffer(whole[c][0].as_py(), "<i4").astype(np.int64) for c in ("ids_a", "sizes_a", "ids_b", "sizes_b")]
        made = align(v, *ids, show=True)
        n = of_a[made.links >> 32]
        if len(keys):
            n[~made.exact] = of_pair[np.searchsorted(keys, made.links[~made.exact])]
        edge = np.append(0, np.cumsum(made.numbers[:, 3]))
        sums = [np.append(0, np.cumsum(x))[edge] for x in (n == best[made.links & _MASK], n)]
        per_unit = np.column_stack([made.numbers, *(x[1:] - x[:-1] for x in sums)])
        texts = left.filter(left["units"].is_valid())
        raw = texts["units"].to_pylist()
        units = np.frombuffer(b"".join(raw), "<i4")
        first = np.append(0, np.cumsum([len(x) // 4 for x in raw]))
        total = np.concatenate([np.zeros((1, per_unit.shape[1]), np.int64), np.cumsum(per_unit[units], axis=0)])[first]
        at, listed = units.tolist(), first.tolist()
        groups = [";".join([made.shown[u] for u in at[s:e]]) for s, e in zip(listed[:-1], listed[1:])]
        return pa.Table.from_arrays([texts["doc_id"], *(pa.array(x) for x in (total[1:] - total[:-1]).T), pa.array(groups, pa.string())], schema=schema)

    shown = kept.where("n is null").drop("a", "b", "n")
    return shown.groupBy("block").cogroup(of_block.groupBy("of")).applyInArrow(run, RESULT)
