"""Quality by weak supervision: rules vote or abstain, and EM learns how far to trust each of them.

``measures`` takes counts of every whole text in one pass.  Each rule votes good
(1), bad (-1) or abstains (0) on these counts.  A two-class model with votes that
are independent given the class is fitted by expectation-maximisation, without
labels, over the table of vote patterns: at most 3 ** len(RULES) rows however
many documents there are, and all of them are counted.  A document is kept when
its posterior probability of being good is at least one half and it did not fail
the base rules.

Null and empty texts have no words and fail the base rules; repeated rows are
judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligora.llm.batches import Block, blocks, span_hashes, window_hashes, word_spans
from eligora.session import cut

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_distinct_words")


def _flags(codes: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_SYMBOL, _MARK = _flags(SYMBOLS), _flags(b"!?=_~^@{}[]\\/+")
_UPPER, _LOWER, _DIGIT = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123))), _flags(bytes(range(48, 58)))


def _per_text(flags: np.ndarray, block: Block) -> np.ndarray:
    sums = np.append(0, np.cumsum(flags))
    return sums[block.ends] - sums[block.starts]


def repeated_words(words: np.ndarray) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more, the first one included."""
    windows = window_hashes(words, WINDOW)
    if len(windows) < 2:
        return 0
    _, at, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[at] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def block_measures(block: Block) -> list[np.ndarray]:
    starts, ends, first = word_spans(block)
    hashes = span_hashes(block.data, starts, ends)
    inside = np.zeros(len(block.data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    in_word = np.cumsum(inside[:-1]) > 0
    lines, ended, dup, repeat, distinct = [], [], [], [], []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        own = [x for x in block.text(i).split(b"\n") if x.strip()]
        lines.append(len(own))
        ended.append(sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in own))
        dup.append(len(own) - len(set(own)))
        repeat.append(repeated_words(hashes[a:b]))
        distinct.append(len(np.unique(hashes[a:b])))
    data = block.data
    chars = _per_text(in_word & ((data & 0xC0) != 0x80), block)
    return [np.diff(first), chars, _per_text(_SYMBOL[data], block), np.array(dup), np.array(repeat), np.array(lines), np.array(ended),
            _per_text(_UPPER[data], block), _per_text(_LOWER[data], block), _per_text(_DIGIT[data], block), _per_text(_MARK[data], block), np.array(distinct)]


def measures(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` as strings, and the MEASURES of each whole text."""
    names = ["doc_id", *keep, *MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                columns = [pa.array(c.astype(np.int64)) for c in block_measures(block)]
                yield pa.RecordBatch.from_arrays([*(c[block.rows] for c in batch.columns[1:]), *columns], names)

    schema = ", ".join(["doc_id long", *(f"{c} string" for c in keep), *(f"{c} long" for c in MEASURES)])
    return docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in keep)).mapInArrow(run, schema)


#: name -> (votes bad if, votes good if); it abstains otherwise, as it does on texts too short for its question.
RULES = {
    "symbols": ("n_symbols > 0.10 * n_words", "n_symbols <= 0.02 * n_words"),
    "marks": ("n_symbols + n_marks > 0.06 * word_chars", "n_symbols + n_marks <= 0.015 * word_chars"),
    "word_length": ("word_chars < 2.5 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    "dup_lines": ("n_dup_lines > 0.30 * n_lines", "n_dup_lines <= 0.05 * n_lines"),
    "repeats": ("n_repeat_words > 0.25 * n_words", "n_repeat_words <= 0.05 * n_words"),
    "capitals": ("n_upper > 0.5 * (n_upper + n_lower)", "n_upper < 0.2 * (n_upper + n_lower)"),
    "line_ends": ("n_lines >= 4 and n_ended_lines < 0.2 * n_lines", "n_ended_lines >= 0.6 * n_lines"),
    "digits": ("n_digits > 0.25 * word_chars", "n_digits <= 0.05 * word_chars"),
    "variety": ("n_distinct_words < 0.15 * n_words and n_words >= 50", "n_distinct_words > 0.3 * n_words"),
}


def votes() -> list[Column]:
    return [F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end").alias(f"v_{name}") for name, (bad, good) in RULES.items()]


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of good documents and P(vote | class) as an array (class, rule, vote + 1), from vote patterns and their counts."""
    posterior = np.where((patterns < 0).any(axis=1), 0.1, 0.95)
    share, table = 0.5, np.full((2, patterns.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        before = table.copy()
        for c, weight in ((0, (1 - posterior) * counts), (1, posterior * counts)):
            for v in (-1, 0, 1):
                table[c, :, v + 1] = ((patterns == v) * weight[:, None]).sum(axis=0) + 1.0
            table[c] /= table[c].sum(axis=1, keepdims=True)
        share = float(np.clip((posterior * counts).sum() / counts.sum(), 0.01, 0.99))
        posterior = posteriors(patterns, share, table)
        if np.abs(before - table).max() < 1e-7:
            break
    return share, table


def posteriors(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    rule = np.arange(patterns.shape[1])[None, :]
    log = [np.log(table[c][rule, patterns + 1]).sum(axis=1) for c in (0, 1)]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - share) / share), -500, 500)))


def quality_posteriors(docs: DataFrame) -> DataFrame:
    """doc_id, the MEASURES, every rule's vote, and ``posterior``: the probability of being good."""
    spark, names = docs.sparkSession, [f"v_{r}" for r in RULES]
    voted = cut(measures(docs).select("*", *votes()))
    table = voted.groupBy(*names).count().toArrow().to_pandas()  # at most 3 ** len(RULES) rows
    if not len(table):
        return voted.withColumn("posterior", F.lit(None).cast("double"))
    patterns = table[names].to_numpy().astype(int)
    table["posterior"] = posteriors(patterns, *fit(patterns, table["count"].to_numpy().astype(float)))
    known = spark.createDataFrame([tuple(map(int, r[:-1])) + (float(r[-1]),) for r in table[[*names, "posterior"]].itertuples(index=False)],
                                  ", ".join(f"{n} int" for n in names) + ", posterior double")
    return voted.join(F.broadcast(known), names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base measures, base_failed, kept and posterior."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return quality_posteriors(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                                           (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")
