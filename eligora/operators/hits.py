"""Retrieval for the assessment: the best chunks of each pair, put before a model in one call.

The other way to find evidence is the scan of whole documents (``extraction``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.operators import retrieval as R
from eligora.operators import vectors as V

PAIR = ["bidder_id", "criterion_id"]


def keyword_hits(chunks: DataFrame, prepared: DataFrame, pending: DataFrame, k: int = K.TOP_K) -> DataFrame:
    """Pair, doc_ordinal, chunk_index, rank of the ``k`` best chunks by keywords.

    Where no chunk scores, the first ``k`` of the bidder's documents.
    """
    words = R.keyword_criteria(prepared, ["tender_id", "criterion_id"])
    scored = R.score_chunks(chunks, words, ["tender_id"], ["bidder_id", "doc_ordinal", "chunk_index"])
    wanted = scored.join(pending.select(*PAIR), PAIR, "left_semi")
    return R.keyword_top_k(wanted, PAIR, ["doc_ordinal", "chunk_index"], k).select(*PAIR, "doc_ordinal", "chunk_index", "rank")


def vector_hits(index: DataFrame, queries: DataFrame, chunks: DataFrame, keyword: DataFrame, pending: DataFrame,
                k: int = K.TOP_K, pool: int = K.VECTOR_POOL) -> DataFrame:
    """The same from three lists: near chunks, chunks of documents with a near summary, keyword hits.

    index: bidder_id, doc_pos, kind, chunk_index, embedding (``VectorIndex.rows``).
    queries: tender_id, criterion_id, embedding.  A bidder without an index and a
    criterion without a vector have keyword hits alone, as many as ``keyword`` has.
    """
    usable = F.exists("embedding", lambda x: x != 0)
    place = pending.select("bidder_id", "tender_id").distinct()
    vectors = index.where(usable).select("bidder_id", "kind", F.col("doc_pos").alias("source_document"), "chunk_index", "embedding")
    scored = V.similarities(vectors.join(place, "bidder_id"), queries.where(usable), ["tender_id"],
                            ["bidder_id", "kind", "source_document", "chunk_index"])
    wanted = scored.where("cosine is not null").join(pending.select(*PAIR), PAIR, "left_semi")
    near = V.nearest(wanted, [*PAIR, "kind"], ["source_document", "chunk_index"], max(pool, K.TOP_SUMMARIES))
    corpus = chunks.select("bidder_id", F.col("doc_ordinal").alias("source_document"), "chunk_index", F.col("chunk_index").alias("ordinal"))
    fused = V.fuse(near.where((F.col("kind") == "chunk") & (F.col("rank") <= pool)),
                   near.where((F.col("kind") == "doc_summary") & (F.col("rank") <= K.TOP_SUMMARIES)),
                   corpus, keyword.withColumnRenamed("doc_ordinal", "source_document"), PAIR, k, pool)
    return fused.select(*PAIR, F.col("source_document").alias("doc_ordinal"), "chunk_index", "rank")


def hit_batches(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """One batch per pair: its hits' texts by rank as context, and the best hit's document.

    ``hits`` has at most k rows per pair, so k chunks are gathered in a row and no
    more.  Chunks are first cut to those that some pair asked for.
    """
    place = ["bidder_id", "doc_ordinal", "chunk_index"]
    texts = chunks.select(*place, "source_document", "text").join(hits.select(*place).distinct(), place, "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_ordinal", "source_document", "text")))
    rows = hits.join(texts, place).groupBy(*PAIR).agg(ordered.alias("_h"))
    lines = F.transform("_h", lambda h, i: F.concat(F.lit("[CHUNK "), (i + 1).cast("string"), F.lit(" from "), h["source_document"],
                                                    F.lit("]\n"), h["text"]))
    first = F.element_at("_h", 1)
    return rows.select(*PAIR, first["doc_ordinal"].alias("doc_ordinal"), first["source_document"].alias("source_document"),
                       F.lit(0).alias("batch"), F.array_join(lines, "\n\n").alias("context"))
