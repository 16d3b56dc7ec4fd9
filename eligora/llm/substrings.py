"""Substring dedup: content-defined chunks of words by a gear rolling hash.

The gear hash of the last 16 bytes decides at which word ends a chunk of text
ends, so boundaries move with their content and return after an insertion.  What
is looked up in all documents is the digest of a window: consecutive chunks that
together have at least ``MIN_WORDS`` words, as few as do from their first chunk on
or back from their last.  A window is a repeat when it stands as a whole in a
document with a smaller doc_id, or earlier in the same document without touching
it; the chunks of repeats are taken out.  Shorter passages are phrases and stay,
also where several from different documents stand side by side.

Two narrow shuffles of (digest, doc_id), one row per document and distinct window,
find the repeats; texts move once, to meet their list of repeats, whose length
their own chunks bound.  Digests of very common passages are pre-aggregated, and
the join on them has one row per digest on one side, so AQE may split the other.

Null texts stay null; empty texts and texts of white space stay as they are.  Rows
with a null doc_id stay as they are and are no origin of others.  Rows that share
a doc_id are versions of one document and no repeats of each other.  A text without
white space is one chunk.  Extra columns pass through; n_chars is counted anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligora.llm.batches import _BASE, BYTE_VALUE, Block, _bases, _powers, _room, blocks, mix, span_hashes, word_spans
from eligora.llm.names import fresh

GEAR_BYTES = 16
DIVISOR = 5
MIN_WORDS = 16
_GEAR = (BYTE_VALUE >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 16 bytes' values, each shifted by its distance."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint32(step)
        h = shifted
    return h


def chunk_spans(block: Block, divisor: int = DIVISOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every chunk, its number of words, and each text's first chunk (one more at the end)."""
    starts, ends, first = word_spans(block)
    if not len(starts):
        return starts, ends, starts, np.zeros(len(block.starts) + 1, np.int64)
    text = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
    value = gear(block.data)[ends - 1] >> np.uint32(6)
    last = (value % np.uint32(divisor) == 0) & (ends - block.starts[text] >= GEAR_BYTES)
    last[first[1:][first[1:] > 0] - 1] = True
    close = np.flatnonzero(last)
    open_ = np.append(0, close[:-1] + 1)
    return starts[open_], ends[close], close - open_ + 1, np.searchsorted(open_, first)


def windows(values: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First chunk, last chunk and digest of every window of one text; ``values`` are the digests of its chunks."""
    n = len(values)
    sums = np.append(0, np.cumsum(words))
    last = np.searchsorted(sums, sums[:-1] + min_words) - 1
    low = np.flatnonzero(last < n)
    first = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1
    high = np.flatnonzero(first >= 0)
    pairs = np.unique(np.append(low * n + last[low], first[high] * n + high))
    first, last = pairs // max(n, 1), pairs % max(n, 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values.view(np.uint64) * _powers(_room(n))[:n], out=total[1:])
    raw = (total[last + 1] - total[first]) * _bases(_room(n))[first]
    return first, last, mix(raw ^ (last - first + 1).astype(np.uint64) * np.uint64(_BASE)).view(np.int64)


def digests(docs: DataFrame, divisor: int = DIVISOR, min_words: int = MIN_WORDS) -> DataFrame:
    """(digest, doc_id): the distinct windows of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                starts, ends, words, first = chunk_spans(block, divisor)
                values = span_hashes(block.data, starts, ends).view(np.int64)
                parts = [np.unique(windows(values[a:b], words[a:b], min_words)[2]) for a, b in zip(first[:-1], first[1:])]
                doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*parts, values[:0]])), batch.column(0)[block.rows].take(pa.array(doc))], ["digest", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(run, "digest long, doc_id long")


def repeats(docs: DataFrame, divisor: int = DIVISOR, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, digests): the windows of each document that stand in one with a smaller id."""
    found = digests(docs, divisor, min_words)
    origin = found.groupBy("digest").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last")).where("origin <> last").select("digest", "origin")
    return found.join(origin, "digest").where("doc_id <> origin").groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))


def removable(values: np.ndarray, words: np.ndarray, gone: np.ndarray, min_words: int) -> np.ndarray:
    """Which chunks of one text go: those of windows that stand in ``gone`` or earlier in the text."""
    first, last, digest = windows(values, words, min_words)
    _, origin, at = np.unique(digest, return_index=True, return_inverse=True)
    repeat = np.isin(digest, gone) | (last[origin[at]] < first)
    edge = np.bincount(first[repeat], minlength=len(values) + 1) - np.bincount(last[repeat] + 1, minlength=len(values) + 1)
    return np.cumsum(edge)[:-1] > 0


def cleaned(block: Block, gone: list, divisor: int, min_words: int) -> Iterator[str]:
    """Each text of the block without its repeated chunks; ``gone`` has each text's digests or None."""
    starts, ends, words, first = chunk_spans(block, divisor)
    values = span_hashes(block.data, starts, ends).view(np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        out = removable(values[a:b], words[a:b], np.array(gone[i] or [], np.int64), min_words) if b > a else np.zeros(0, bool)
        if not out.any():
            yield block.text(i).decode()
            continue
        data, low, high = block.text(i), int(block.starts[i]), len(block.text(i))
        begin = np.append(starts[a:b] - low, high)
        kept = [data[:begin[0]]]
        for k in np.flatnonzero(~out):
            kept.append(data[begin[k]:begin[k + 1]])
        yield b"".join(kept).decode().rstrip() if out[-1] else b"".join(kept).decode()


def without_repeats(docs: DataFrame, divisor: int = DIVISOR, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; all its columns, in their order."""
    repeat_doc, repeated = fresh(docs.columns, "repeat_doc", "repeated_digests")
    gone = repeats(docs, divisor, min_words).select(F.col("doc_id").alias(repeat_doc), F.col("digests").alias(repeated))
    met = docs.join(gone, F.col("doc_id").cast("long") == F.col(repeat_doc), "left").select(*[F.col(f"`{c}`") for c in docs.columns], repeated)
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    known, names = docs.columns.index("doc_id"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists, ids = batch.column(at), batch.column(batch.num_columns - 1), batch.column(known)
            null = texts.is_null().to_pylist()
            for block in blocks(texts):
                rows = block.rows
                free = ids[rows].is_null().to_pylist()
                new = list(cleaned(block, lists[rows].to_pylist(), divisor, min_words))
                new = [None if null[rows.start + i] else block.text(i).decode() if free[i] else t for i, t in enumerate(new)]
                columns = [c[rows] for c in batch.columns[:-1]]
                columns[at] = pa.array(new, texts.type)
                if count is not None:
                    before = columns[count].to_pylist()
                    changed = [len(t) if t is not None and len(t.encode()) != e - s else n for t, n, s, e in zip(new, before, block.starts.tolist(), block.ends.tolist())]
                    columns[count] = pa.array(changed, columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return met.mapInArrow(run, docs.schema)
