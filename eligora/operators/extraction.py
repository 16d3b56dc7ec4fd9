"""Evidence extraction: scanning documents in order until something is found.

An *extractor* is a function from a DataFrame of batches to a DataFrame of
evidence rows that keeps the batch columns.  It may call a model (see
``eligora.sources.models``) or be a plain expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligora.operators.ranking import rank_all
from eligora.operators.retrieval import document_order
from eligora.session import cut

Extractor = Callable[[DataFrame], DataFrame]


def distinct_evidence(evidence: DataFrame, group: list[str], ordinal: str = "ordinal", several: str | None = None,
                      whole: bool = True) -> DataFrame:
    """First row per (document, value, source text), by a hash of the whole text.

    With ``several``, a flag column, only rows of criteria that want several items
    are folded; the others all stay.  Not ``whole``: only group, document, the
    trimmed value and the first ordinal, a number; then no text but the value is
    moved, and the states are numbers, so that the aggregation hashes.
    """
    if several:
        rest = evidence.where(~F.coalesce(F.col(several), F.lit(False)))
        return distinct_evidence(evidence.where(F.col(several)), group, ordinal).unionByName(rest)
    text = F.trim(F.coalesce("source_text", F.lit("")))
    keyed = evidence.withColumns({
        "_value": F.trim(F.coalesce(F.col("extracted_value").cast("string"), F.lit(""))),
        "_source": F.unhex(F.sha2(text, 256))})
    if not whole:
        firsts = keyed.groupBy(*group, "source_document", "_value", "_source").agg(F.min(ordinal).alias(ordinal))
        return firsts.select(*group, "source_document", F.col("_value").alias("extracted_value"), ordinal)
    columns = [c for c in evidence.columns if c not in (*group, "source_document", ordinal)]
    firsts = keyed.groupBy(*group, "source_document", "_value", "_source").agg(
        F.min(F.struct(ordinal, *columns)).alias("_e"))
    return firsts.select(*group, "source_document", "_e.*")


def with_document_confidence(evidence: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """OCR confidence of the document an evidence row names, NULL if unknown."""
    known = documents.groupBy(*keys).agg(F.min("ocr_confidence").alias("ocr_confidence"))
    return evidence.drop("ocr_confidence").join(known, keys, "left")


def sequence_batches(batches: DataFrame, group: list[str]) -> DataFrame:
    """Scan position of every batch: document order, then batch number.

    Batches are narrow rows here (keys, score, criterion fields); an extractor
    that needs their text joins it to the batches it is given.
    """
    batches = cut(batches)
    order = document_order(batches.groupBy(*group, "source_document", "doc_ordinal")
                           .agg(F.max("best_score").alias("best_score")), group)
    placed = batches.drop("best_score").join(order.select(*group, "doc_ordinal", "doc_rank"), group + ["doc_ordinal"])
    return rank_all(placed, group, [F.col("doc_rank"), F.col("batch")], "seq")


def scan(batches: DataFrame, group: list[str], extract: Extractor, merge_all: str = "merge_all",
         waves: bool = True) -> DataFrame:
    """Evidence of the first successful batch per group, or of all batches for
    groups that need several items.

    A cheap extractor (``waves=False``) sees all batches in one plan and the
    first hit is a minimum.  Otherwise it runs in waves of doubling width over the scan position; a group leaves
    after the wave that found something, so an expensive extractor is called
    for few batches beyond the first hit, in a logarithmic number of jobs.
    """
    if not waves:
        found = extract(batches)
        firsts = found.groupBy(*group).agg(F.min("seq").alias("_first"))
        return found.join(firsts, group).where(F.col(merge_all) | (F.col("seq") == F.col("_first"))).drop("_first")
    everything = cut(extract(batches.where(F.col(merge_all))))
    pending = batches.where(~F.col(merge_all))
    last = pending.agg(F.max("seq")).first()[0] or 0
    parts, solved, low, width = [everything], None, 1, 1
    while low <= last:
        wave = pending.where(F.col("seq").between(low, low + width - 1))
        if solved is not None:
            wave = wave.join(solved, group, "left_anti")
        found = cut(extract(wave))
        firsts = found.groupBy(*group).agg(F.min("seq").alias("seq"))
        parts.append(found.join(firsts, group + ["seq"], "left_semi"))
        done = firsts.select(*group)
        solved = done if solved is None else solved.unionByName(done)
        low, width = low + width, width * 2
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scan_reserving(batches: DataFrame, bidder: str, position: str, group: list[str], extract: Extractor,
                   waves: bool = True) -> DataFrame:
    """The same with document reservation: a document that gave evidence for one
    criterion is skipped for the bidder's later ones.  Reserved are the scanned
    document and, where one item is wanted, also every document that is named.

    Sequential over criterion positions (a handful), parallel over bidders.
    """
    batches = batches.withColumn("scanned_document", F.col("source_document"))
    batches = cut(batches)
    last = batches.agg(F.max(position)).first()[0] or 0
    reserved, parts = None, []
    for step in range(1, last + 1):
        free = batches.where(F.col(position) == step)
        if reserved is not None:
            free = free.join(reserved, [bidder, "source_document"], "left_anti")
        found = cut(scan(sequence_batches(free, group), group, extract, waves=waves))
        named = found.where(~F.col("merge_all")).select(bidder, "source_document")
        used = found.select(bidder, F.col("scanned_document").alias("source_document")).unionByName(named).distinct()
        reserved = used if reserved is None else reserved.unionByName(used).distinct()
        parts.append(found)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
