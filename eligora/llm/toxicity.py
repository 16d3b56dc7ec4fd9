"""Toxicity by two class-conditional Kneser-Ney models over the bytes of words.

A text is its words between ASCII white space (A-Z lower-cased, digits as 0), each with
``ORDER`` - 1 blanks in front and one behind, so a word of any length, the first of a
text included, gives one expression of ``ORDER`` bytes per byte.  For each class the
model is

    P_c(w | h) = max(n_c(h w) - D_c, 0) / n_c(h) + D_c * types_c(h) / n_c(h) * P_c(w | h')

with h' one byte shorter than h and, below the longest expressions, n_c(h w) the
number of distinct left neighbours of ``h w`` in the class.  From ``SHARED`` bytes
down the backoff counts are those of both classes together.  Rare expressions are
thus smoothed by counts that the classes share, and where neither class has seen
an expression the shared factor cancels.  A text's evidence is the difference of the
length-normalised log-likelihoods, over the whole text and over its most toxic windows
of ``WINDOWS`` bytes, so that a few insults in a long text are not thinned out.  A
logistic curve over this evidence, fitted on labelled rows by models that have not
seen them, gives the score.

Counts, levels, discounts and backoff weights are tables made by grouped aggregation;
they cover all expressions of all labelled rows and grow with them.  Texts without a
label are left out by a bit table of the labelled ids, so that the join with the labels
moves little but what is learnt from.  The curve's sums are
added up over the partitions of the rows' evidence, which never comes to the driver.
Scoring needs one number per expression.  If the table has at most
``broadcast_rows`` rows it is broadcast; a larger one stays partitioned: the texts are
stored in blocks, each block's distinct expressions are joined with the table, and the
numbers found meet the block's texts.  Both ways give the same scores.

Null and empty texts and such of white space alone score as evidence 0; without labels
of both classes every score is the share of toxic labels (0 without any).  A document
labelled more than once counts as toxic if one label says so; null labels are left out.
Repeated rows are scored each; an empty table gives no rows; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligora.llm.batches import LOWER, SPACE, Block, HashIndex, blocks
from eligora.llm.stored import stored
from eligora.session import cut, sized

ORDER = 6
SHARED = 2
WINDOWS = (12, 48)
BROADCAST_ROWS = 4_000_000
BLOCK_TEXT = 32 << 20
FOLDS = 5
FILTER_BLOCKS = 1024
_PLAIN = LOWER.copy()
_PLAIN[48:58] = 48
_PLAIN[SPACE] = 32


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS))


def expressions(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all expressions of the texts' words in order, the text of each, and the number of each text's first (one more at the end)."""
    data = _PLAIN[block.data]
    blank = data == 32
    at = np.arange(len(data))
    # how many bytes before each one belong to its word; the blank behind a word goes with it
    word = np.maximum.accumulate(np.where(blank, at + 1, 0))
    depth = at - np.append(0, word[:-1])
    keys = np.zeros(len(data), np.uint64)
    for k in range(ORDER):
        byte = np.full(len(data), 32, np.uint64)
        byte[k:] = np.where(depth[k:] >= k, data[:len(data) - k], 32)
        keys |= byte << np.uint64(8 * k)
    kept = np.flatnonzero(~blank | (depth > 0))
    first = np.searchsorted(kept, np.append(block.starts, len(data)))
    return keys[kept], np.repeat(np.arange(len(block.starts)), np.diff(first)), first


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)


COUNTS = ("toxic_a", "ordinary_a", "toxic_b", "ordinary_b")


def count_expressions(labelled: DataFrame) -> DataFrame:
    """(expression, COUNTS) over all rows of (text, cell), cell being the number of one of COUNTS; each task sends its distinct expressions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in COUNTS]
        numbers: list[list] = [[] for _ in COUNTS]
        for batch in batches:
            cell = batch.column(1).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(0)):
                keys, text, _ = expressions(block)
                of = cell[block.rows][text]
                for c in range(len(COUNTS)):
                    distinct, n = np.unique(keys[of == c], return_counts=True)
                    held[c].append(distinct)
                    numbers[c].append(n)
                    if sum(map(len, held[c])) > 4_000_000 and len(held[c]) > 8:
                        held[c][:], numbers[c][:] = ([x] for x in _summed(held[c], numbers[c]))
        for c in range(len(COUNTS)):
            if held[c]:
                distinct, n = _summed(held[c], numbers[c])
                for k in range(0, len(distinct), 100_000):
                    part = n[k:k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(distinct[k:k + 100_000].view(np.int64)), pa.array(np.full(len(part), c)), pa.array(part)], ["expression", "cell", "n"])

    partial = labelled.select("text", "cell").mapInArrow(run, "expression long, cell long, n long")
    return partial.groupBy("expression").agg(*[F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(name) for c, name in enumerate(COUNTS)])


#: The models: one of each half of the labelled rows, and that of both; each has a toxic and an ordinary count.
MODELS = ("a", "b", "ab")
_CLASSES = [f"{c}_{m}" for m in MODELS for c in ("toxic", "ordinary")]


def _mask(bytes_: int):
    return F.lit((1 << (8 * bytes_)) - 1)


def _tag(level: int, context: bool = False) -> int:
    """Set above the bytes of a key to tell levels, and contexts from expressions."""
    return level + 8 * context << 56


def shared_chances(left: dict[int, int]) -> dict[int, float]:
    """P(w | h') of both classes together for two-byte keys, from the number of distinct left neighbours of each; at most 2^16 keys."""
    total: dict[int, int] = {}
    types: dict[int, int] = {}
    ends: dict[int, int] = {}
    for key, n in left.items():
        total[key >> 8], types[key >> 8] = total.get(key >> 8, 0) + n, types.get(key >> 8, 0) + 1
        ends[key & 255] = ends.get(key & 255, 0) + 1
    one, two = (sum(n == k for n in left.values()) for k in (1, 2))
    d, all_ = discount(one, two), sum(ends.values())
    return {key: max(n - d, 0) / total[key >> 8] + d * types[key >> 8] / total[key >> 8] * (ends[key & 255] + 0.5) / (all_ + 128) for key, n in left.items()}


def discount(one: int, two: int) -> float:
    """The absolute discount from how many expressions were counted once and twice."""
    return one / (one + 2 * two) if one and two else 0.75


def ratios(counts: DataFrame) -> DataFrame:
    """(entry, a, b, ab): for each model the difference of the classes' log-probabilities by expression and level, and of their log backoff weights by context."""
    spark = counts.sparkSession
    both = {f"{c}_ab": F.col(f"{c}_a") + F.col(f"{c}_b") for c in ("toxic", "ordinary")}
    levels = {ORDER: cut(counts.select(F.col("expression").alias("key"), *[both.get(c, F.col(c)).alias(c) for c in _CLASSES]))}
    for level in range(ORDER - 1, SHARED, -1):
        above = levels[level + 1]
        levels[level] = cut(above.groupBy(F.col("key").bitwiseAND(_mask(level)).alias("key")).agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in _CLASSES]))
    seen = {r["key"]: r["count"] for r in levels[SHARED + 1].groupBy(F.col("key").bitwiseAND(_mask(SHARED)).alias("key")).count().collect()}
    chances = shared_chances(seen)
    lower = spark.createDataFrame([(k, *[p] * len(_CLASSES)) for k, p in chances.items()], "suffix long, " + ", ".join(f"p_{c} double" for c in _CLASSES))
    entries = []
    for level in range(SHARED + 1, ORDER + 1):
        own = levels[level]
        few = own.agg(*[F.count(F.when(F.col(c) == k, 1)).alias(f"{c}_{k}") for c in _CLASSES for k in (1, 2)]).first()
        d = {c: discount(few[f"{c}_1"], few[f"{c}_2"]) for c in _CLASSES}
        context = F.shiftright("key", 8)
        sums = [x for c in _CLASSES for x in (F.sum(c).alias(f"n_{c}"), F.sum((F.col(c) > 0).cast("long")).alias(f"k_{c}"))]
        weight = lambda c: F.when(F.col(f"n_{c}") > 0, d[c] * F.col(f"k_{c}") / F.col(f"n_{c}")).otherwise(1.0)  # noqa: E731, B023
        contexts = own.groupBy(context.alias("context")).agg(*sums).select("context", *[F.col(f"n_{c}") for c in _CLASSES], *[weight(c).alias(f"w_{c}") for c in _CLASSES])
        met = own.select("key", context.alias("context"), F.col("key").bitwiseAND(_mask(level - 1)).alias("suffix"), *_CLASSES).join(contexts, "context").join(lower, "suffix")
        chance = lambda c: F.greatest(F.col(c) - d[c], F.lit(0.0)) / F.greatest(f"n_{c}", F.lit(1)) + F.col(f"w_{c}") * F.col(f"p_{c}")  # noqa: E731, B023
        made = cut(met.select("key", *[chance(c).alias(f"p_{c}") for c in _CLASSES]))
        apart = lambda x: [(F.log(f"{x}_toxic_{m}") - F.log(f"{x}_ordinary_{m}")).cast("float").alias(m) for m in MODELS]
        entries += [made.select(F.col("key").bitwiseOR(F.lit(_tag(level))).alias("entry"), *apart("p")),
                    contexts.select(F.col("context").bitwiseOR(F.lit(_tag(level, True))).alias("entry"), *apart("w"))]
        lower = made.withColumnRenamed("key", "suffix")
    out = entries[0]
    for more in entries[1:]:
        out = out.unionByName(more)
    return cut(out)


@dataclass
class Model:
    """Differences by entry of ``ratios``; the last is 0 and stands for entries that are not there."""

    index: HashIndex
    ratio: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, ratio: np.ndarray) -> Model:
        return cls(HashIndex.of(entries.astype(np.int64).view(np.uint64), np.arange(len(entries), dtype=np.int32)), np.append(ratio, 0).astype(np.float32))

    def differences(self, keys: np.ndarray) -> np.ndarray:
        """log P_toxic - log P_ordinary of the last byte of each expression, given the others."""
        out = np.zeros(len(keys), np.float32)
        open_ = np.arange(len(keys))
        for level in range(ORDER, SHARED, -1):
            own = keys[open_] & np.uint64((1 << (8 * level)) - 1)
            at = self.index.find(own | np.uint64(_tag(level)))
            out[open_] += self.ratio[at]
            open_, own = open_[at < 0], own[at < 0]
            out[open_] += self.ratio[self.index.find(own >> np.uint64(8) | np.uint64(_tag(level, True)))]
        return out

    def evidence(self, block: Block) -> np.ndarray:
        """For each text: mean difference, means over the most toxic window of each length, 1."""
        keys, _, first = expressions(block)
        sums = np.append(0, np.cumsum(self.differences(keys), dtype=np.float64))
        n = np.diff(first)
        mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
        columns = [mean]
        for size in WINDOWS:
            peak, long = mean.copy(), np.flatnonzero(n > size)
            if len(long):
                windows = (sums[size:] - sums[:-size]) / size
                bounds = np.column_stack([first[:-1][long], first[1:][long] - size + 1]).ravel()
                peak[long] = np.maximum.reduceat(np.append(windows, -np.inf), bounds)[::2]
            columns.append(peak)
        return np.column_stack([*columns, np.ones(len(n))])


def wanted_entries(keys: np.ndarray) -> np.ndarray:
    """All entries that ``Model.differences`` may look up for these expressions, distinct."""
    out, own = [], np.unique(keys)
    for level in range(ORDER, SHARED, -1):
        own = np.unique(own & np.uint64((1 << (8 * level)) - 1))
        out += [own | np.uint64(_tag(level)), np.unique(own >> np.uint64(8)) | np.uint64(_tag(level, True))]
    return np.concatenate(out).view(np.int64)


def _slope(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The log-likelihood's gradient, and below it its negative Hessian, summed over rows."""
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return np.vstack([z.T @ (y - p), (z * (p * (1 - p))[:, None]).T @ z])


def _newton(slope: Callable[[np.ndarray], np.ndarray], scale: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    """Newton steps; ``slope`` is that of all rows, divided by ``scale``."""
    w = np.zeros(len(scale))
    shrink = np.diag(np.append(np.full(len(scale) - 1, ridge), 1e-9))
    for _ in range(rounds):
        sums = slope(w)
        step = np.linalg.solve(sums[1:] + shrink + 1e-9 * np.eye(len(w)), sums[0] - shrink @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps; the last column is the constant and is not shrunk."""
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
    z = x / scale
    return _newton(lambda w: _slope(z, y, w), scale, ridge, rounds)


def fit_rows(rows: DataFrame, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray | None:
    """``fit_logistic`` over all rows of (toxic, EVIDENCE); None without rows of both classes.

    Each partition sends its sums only.  Rows are dealt and sorted by value, so that sums
    are added up in one order and equal rows give equal weights.
    """
    columns, width = ["toxic", *EVIDENCE], len(EVIDENCE)
    dealt = rows.select(*columns).repartition(rows.sparkSession.sparkContext.defaultParallelism, *columns)
    rows = cut(dealt.sortWithinPartitions(*columns))

    def total(sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((width + 1, width))
            for batch in batches:
                y, *x = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
                out += sums(np.column_stack(x), y)
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        parts = [np.reshape(r.sums, (width + 1, width)) for r in rows.mapInArrow(run, "sums array<double>").collect()]
        return sum(parts, np.zeros((width + 1, width)))

    def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((width + 1, width))
        out[0], out[1], out[2, 0] = x.sum(axis=0), (x * x).sum(axis=0), y.sum()
        return out

    first = total(moments)
    n, toxic = first[0, -1], first[2, 0]
    if not 0 < toxic < n:
        return None
    apart = np.sqrt(np.maximum(first[1] / n - (first[0] / n) ** 2, 0))
    scale = np.where(apart > 1e-9, apart, 1)
    return _newton(lambda w: total(lambda x, y: _slope(x / scale, y, w)), scale, ridge, rounds)


EVIDENCE = tuple(f"e{k}" for k in range(len(WINDOWS) + 2))


def _typed(kept: list[str]) -> str:
    return ", ".join([f"{k} long" for k in kept] + [f"{e} double" for e in EVIDENCE])


def _broadcast_evidence(docs: DataFrame, model, which: str, kept: list[str]) -> DataFrame:
    """The ``kept`` long columns and EVIDENCE for each row of (text, ...), by a broadcast table of (index, ratios by model)."""
    names = [*kept, *EVIDENCE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ratio = model.value
        own = Model(index, ratio[which])
        for batch in batches:
            for block in blocks(batch.column(0)):
                e = own.evidence(block)
                yield pa.RecordBatch.from_arrays([*(batch.column(i + 1)[block.rows] for i in range(len(kept))), *(pa.array(x) for x in e.T)], names)

    return docs.select("text", *kept).mapInArrow(run, _typed(kept))


def _partitioned_evidence(docs: DataFrame, table: DataFrame, which: str, kept: list[str], block_text: int = BLOCK_TEXT) -> DataFrame:
    """The same by a table that stays partitioned; texts are stored in blocks of about ``block_text`` bytes, a block meets the entries it asks for."""
    names, columns = [*kept, *EVIDENCE], ["block", "text", *kept]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, done = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = np.array([len(t or "") for t in batch.column(0).to_pylist()], np.int64)
            number = (done + np.cumsum(sizes) - sizes) // block_text
            done += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(base + number), *batch.columns], columns)

    dealt = stored(docs.select("text", *kept).mapInArrow(deal, "block long, text string" + "".join(f", {k} long" for k in kept)), "toxicity-texts")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for number in np.unique(numbers):
                rows = pa.array(np.flatnonzero(numbers == number))
                entries = np.unique(np.concatenate([wanted_entries(expressions(b)[0]) for b in blocks(batch.column(1).take(rows))]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entries), number)), pa.array(entries)], ["of", "entry"])

    found = dealt.select("block", "text").mapInArrow(ask, "of long, entry long").distinct().join(table.select("entry", F.col(which).alias("ratio")), "entry")
    schema = pa.schema([(k, pa.int64()) for k in kept] + [(e, pa.float64()) for e in EVIDENCE])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        model = Model.of(right["entry"].to_numpy(), right["ratio"].to_numpy())
        out = []
        for block in blocks(left["text"].combine_chunks()):
            e = model.evidence(block)
            out.append(pa.Table.from_arrays([*(left[k].combine_chunks()[block.rows] for k in kept), *(pa.array(x) for x in e.T)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return dealt.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(meet, _typed(kept)).select(*names)


def likely_labelled(docs: DataFrame, known: DataFrame, n: int, most: int = FILTER_BLOCKS) -> DataFrame:
    """Rows of (doc_id, text) whose id may be one of the ``n`` in ``known``: all that are, and few others.

    A bit is set for the hash of each known id, in blocks of 2^15 bits: 8 to 16 bits an
    id up to ``most`` blocks of 4 KB; with more ids more other rows pass.  The blocks are
    broadcast, their size being bounded.
    """
    bits = 1 << 15
    while bits < min(8 * n, most << 15):
        bits *= 2
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    block, bit = F.shiftright(place, 15).alias("block"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")
    masks = known.select(block, bit).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("mask"))
    byte = F.conv(F.hex(F.substring("mask", F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, F.col("bit").bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return docs.select("doc_id", "text", block, bit).join(F.broadcast(masks), "block").where(is_set).select("doc_id", "text")


def toxicity_scores(docs: DataFrame, labels: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Learns from all labelled rows whose fold is not 0.  Two models of one half of them
    each (folds 1 and 2, folds 3 and 4) give the evidence of the other half for the
    curve; the model that scores has the counts of both.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = sized(labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic")).where(fold() != 0))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    cell = 2 * (fold() > 2).cast("long") + 1 - F.col("toxic")
    weights = None
    if 0 < toxic < n:
        # read three times; beyond Spark's threshold for a broadcast the join moves the texts it gets
        labelled = stored(likely_labelled(docs, known, n).join(known, "doc_id").withColumn("cell", cell), "toxicity-labelled")
        table = ratios(count_expressions(labelled))
        if table.count() <= broadcast_rows:
            rows = table.toArrow()
            index = HashIndex.of(rows["entry"].to_numpy().view(np.uint64), np.arange(len(rows), dtype=np.int32))
            shared = docs.sparkSession.sparkContext.broadcast((index, {m: np.append(rows[m].to_numpy(), 0).astype(np.float32) for m in MODELS}))
            evidence = lambda d, which, kept: _broadcast_evidence(d, shared, which, kept)
        else:
            evidence = lambda d, which, kept: _partitioned_evidence(d, table, which, kept)
        first, second = (evidence(labelled.where(other), m, ["toxic"]) for m, other in (("a", "cell >= 2"), ("b", "cell < 2")))
        weights = fit_rows(first.unionByName(second))
    held_out = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    if weights is None:
        prior = float(toxic) / n if n else 0.0
        return docs.select("doc_id", held_out, F.lit(prior).alias("score"), F.lit(int(prior >= 0.5)).alias("predicted"))
    logit = sum((F.col(e) * float(w) for e, w in zip(EVIDENCE, weights)), F.lit(0.0))
    scored = evidence(docs, "ab", ["doc_id"]).select("doc_id", held_out, (1 / (1 + F.exp(-logit))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
