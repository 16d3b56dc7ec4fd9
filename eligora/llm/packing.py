"""Packing of tokenised documents into sequences: cutting stock by column generation.

1. ``token_pieces`` tokenises whole texts and cuts every document into full
   sequences and one remainder (one pass, no shuffle).
2. The remainders' lengths, rounded up to a grid, form a histogram of at most
   capacity / grid classes.  ``cutting_plan`` solves the linear program over
   patterns on the driver: knapsack dynamic programming prices new patterns, the
   solution is rounded down and the few items left over are put in by best fit.
   The problem's size depends on the grid alone, not on the number of documents.
3. ``layout`` ranks the pieces of each class (range partitions, so a class that
   holds most pieces is spread) and gives each rank its pattern's place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eligora.llm.batches import blocks
from eligora.llm.wordbpe import encoder
from eligora.operators.ranking import rank_all
from eligora.session import cut

CAPACITY = 2048
GRID = 16
MAX_ROUNDS = 6000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
PLAN = "class int, first long, last long, each long, base long, place int"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids: little-endian unsigned 32-bit ids and their place in the document.

    A null text is empty and gives the end id alone; a null doc_id is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            keys = batch.column(0)
            for block in blocks(batch.column(1)):
                ids, counts = encode(block)
                totals = counts + 1
                ends = np.cumsum(totals)
                tokens = np.full(int(ends[-1]), end_id, "<u4")
                inside = np.ones(len(tokens), bool)
                inside[ends - 1] = False
                tokens[inside] = ids
                n = -(-totals // capacity)
                doc = np.repeat(np.arange(len(totals)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, totals[doc] - start)
                offsets = np.append(0, np.cumsum(length)) * 4
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(tokens.tobytes())])
                yield pa.RecordBatch.from_arrays([keys[block.rows].take(pa.array(doc)), pa.array(start), pa.array(length), binary.cast(pa.binary()), pa.array(totals[doc])],
                                                 ["doc_id", "start", "length", "ids", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern (count of each size) of the highest value that fits into ``room``."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = np.searchsorted(sizes, c, side="right")
        best[c], choice[c] = best[c - 1], -1
        if fits:
            total = best[c - sizes[:fits]] + values[:fits]
            k = int(np.argmax(total))
            if total[k] > best[c] + 1e-12:
                best[c], choice[c] = total[k], k
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[room]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in the linear program, by revised simplex steps."""
    per = room // sizes
    patterns = np.diag(per.astype(float))
    inverse, amounts = np.diag(1.0 / per), demand / per
    for _ in range(MAX_ROUNDS):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(prices, sizes, room)
        if value <= 1 + 1e-9:
            break
        direction = inverse @ pattern
        ratios = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        step = ratios[out]
        amounts = np.maximum(amounts - step * direction, 0)
        amounts[out] = step
        inverse[out] /= direction[out]
        factor = direction.copy()
        factor[out] = 0
        inverse -= np.outer(factor, inverse[out])
        patterns[:, out] = pattern
    return patterns, amounts


def best_fit(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[np.ndarray]:
    """Patterns for the items that rounding left over, the largest first into the fullest sequence with room."""
    open_: list[list[np.ndarray]] = [[] for _ in range(room + 1)]
    made = []
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(int(counts[k])):
            left = next((c for c in range(int(sizes[k]), room) if open_[c]), room)
            if open_[left]:
                pattern = open_[left].pop()
            else:
                pattern = np.zeros(len(sizes))
                made.append(pattern)
            pattern[k] += 1
            open_[left - int(sizes[k])].append(pattern)
    return made


def cutting_plan(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (class, first rank, last rank, pieces per sequence, first sequence, place): see PLAN."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    columns, amounts = solve(sizes, demand.astype(float), room)
    used = []
    left = demand.copy()
    for j in np.flatnonzero(amounts >= 1 - 1e-9):
        pattern = columns[:, j].astype(np.int64)
        times = min([int(amounts[j] + 1e-9), *(left[pattern > 0] // pattern[pattern > 0]).tolist()])
        if times:
            left -= times * pattern
            used.append((pattern, times))
    used += [(p.astype(np.int64), 1) for p in best_fit(sizes, left, room)]
    rows, base, rank = [], 0, np.ones(len(sizes), np.int64)
    for pattern, times in used:
        for place, k in enumerate(np.flatnonzero(pattern)[::-1]):
            n = int(pattern[k])
            rows.append((int(sizes[k]), int(rank[k]), int(rank[k]) + n * times - 1, n, base, place))
            rank[k] += n * times
        base += times
    return rows


def layout(pieces: DataFrame, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (doc_id, start, length, ...).

    The plan is a broadcast table whose size the grid bounds: at most
    capacity / grid patterns, and best-fit sequences for their remainders.
    """
    spark, room = pieces.sparkSession, capacity // grid
    classed = pieces.withColumn("_class", F.ceil(F.col("length") / F.lit(grid)).cast("int"))
    histogram = {r[0]: r[1] for r in classed.groupBy("_class").count().collect()}
    plan = _plan_table(spark, cutting_plan(histogram, room))
    ranked = rank_all(classed, ["_class"], [F.col("doc_id"), F.col("start")], "_rank")
    slot = (F.col("_rank") - F.col("first"))
    placed = (ranked.join(F.broadcast(plan), (F.col("_class") == F.col("class")) & F.col("_rank").between(F.col("first"), F.col("last")))
              .withColumn("sequence_id", F.col("base") + F.floor(slot / F.col("each")))
              .withColumn("_slot", F.col("place").cast("long") * capacity + slot % F.col("each")))
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(*pieces.columns, "sequence_id", "offset")


def _plan_table(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, PLAN)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """Pieces with their ids, sequence_id and offset; the token table is stored once and moved once.

    Repeated documents are packed as often as they come; an empty table gives no rows.
    """
    return layout(cut(token_pieces(docs, tokenizer, end_id, capacity)), capacity, grid)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences: sequence_id, length and the ids of all pieces in order (at most ``capacity`` ids each)."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "length"))).alias("p"))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"),
                       F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def packed_digests(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Layout with a CRC-32 of each piece's ids in their stead, so that no ids are shuffled."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity)
    narrow = cut(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return layout(narrow, capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
