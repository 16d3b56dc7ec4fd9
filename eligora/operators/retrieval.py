"""Chunks, keyword retrieval and document order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.functions import text as X
from eligora.operators.ranking import rank_all, top_k
from eligora.session import cut


def _chunk_arrays(documents: DataFrame, keys: list[str], text: str, size: int, overlap: int) -> DataFrame:
    """``keys`` and ``_chunks``, the array of all chunks of each text that is not blank.

    The text is cut into stride-long blocks in one pass; a chunk is a block plus
    the first ``overlap`` characters of the next one.
    """
    stride = size - overlap
    stripped = documents.where(~X.is_blank(text)).select(*keys, X.strip(text).alias("_t"))
    starts = X.chunk_starts(F.col("_t"), size, overlap)
    if overlap > stride:
        return stripped.select(*keys, F.transform(starts, lambda s: F.substr(F.col("_t"), s + 1, F.lit(size))).alias("_chunks"))
    blocks = F.regexp_extract_all("_t", F.lit("(?s).{1,%d}" % stride), F.lit(0))
    staged = stripped.select(*keys, F.size(starts).alias("_n"), blocks.alias("_b"))
    following = F.slice("_b", F.lit(2), F.greatest(F.size("_b"), F.lit(1)))
    joined = F.zip_with("_b", following, lambda b, n: F.concat(b, X.left(F.coalesce(n, F.lit("")), overlap)))
    return staged.select(*keys, F.slice(joined, F.lit(1), F.col("_n")).alias("_chunks"))


def chunk_documents(documents: DataFrame, keys: list[str], text: str = "full_text",
                    size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: ``keys``, chunk_index, text.  Blank texts give none.

    A narrow explode: no shuffle, and the full text is not carried along.
    """
    # outer: an inner explode of a named array makes Spark compute the array again in a filter at the scan
    exploded = _chunk_arrays(documents, keys, text, size, overlap).select(*keys, F.posexplode_outer("_chunks").alias("chunk_index", "text"))
    return exploded.where("text is not null")


def document_batches(documents: DataFrame, keys: list[str], batch_size: int = K.CHUNKS_PER_CALL, text: str = "full_text",
                     size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Model-call batches of consecutive chunks: ``keys``, batch, chunks (their number) and context.

    Batches are slices of a document's own chunk array, so no text is shuffled;
    ``keys`` must hold source_document, which the context names.
    """
    per = batch_size if batch_size >= 1 else K.TOP_K
    whole = _chunk_arrays(documents, keys, text, size, overlap)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_chunks") - 1) / per).cast("int")),
                        lambda b: F.slice("_chunks", b * per + 1, F.lit(per)))
    part = whole.select(*keys, F.posexplode(parts).alias("batch", "_part"))
    lines = F.transform("_part", lambda c, i: F.concat(F.lit("[CHUNK "), (i + 1).cast("string"), F.lit(" from "), F.col("source_document"), F.lit("]\n"), c))
    return part.select(*keys, "batch", F.size("_part").cast("long").alias("chunks"), F.array_join(lines, "\n\n").alias("context"))


def keyword_criteria(criteria: DataFrame, keys: list[str]) -> DataFrame:
    return criteria.select(*keys, X.criterion_keywords().alias("keywords"))


def score_chunks(chunks: DataFrame, criteria: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Keyword score of each chunk for each criterion of its tender.

    An equi-join on ``on`` (the tender); the chunk text is read once, scored,
    and dropped in the same stage, so only ``keep`` and the score move on.
    ``criteria`` has ``on``, criterion_id and keywords.
    """
    narrow = chunks.select(*on, *keep, F.lower("text").alias("_low"))
    joined = narrow.join(criteria.select(*on, "criterion_id", "keywords"), on)
    return joined.select(*on, *keep, "criterion_id", X.keyword_score_low("_low", "keywords").alias("score"))


def keyword_top_k(scored: DataFrame, group: list[str], corpus_order: list[str], k: int = K.TOP_K) -> DataFrame:
    """Best ``k`` scoring chunks per group, in corpus order on ties.

    Where nothing scores, the first ``k`` chunks of the corpus.
    """
    best = top_k(scored, group, [F.col("score").desc(), *[F.col(c) for c in corpus_order]], k)
    top = F.first_value("score").over(Window.partitionBy(*group).orderBy("rank"))
    return best.withColumn("_top", top).where((F.col("score") > 0) | (F.col("_top") == 0)).drop("_top")


def document_scores(scored: DataFrame, group: list[str], document: list[str]) -> DataFrame:
    """Best chunk score per document; reduced where the chunks were made."""
    return scored.groupBy(*group, *document).agg(F.max("score").alias("best_score"))


def document_order(scores: DataFrame, group: list[str], name: str = "source_document",
                   ordinal: str = "doc_ordinal") -> DataFrame:
    """Scan order of the documents of each group: score, then name.

    Groups in which nothing scores keep corpus order.  The scores (one narrow
    row per document) are stored first, because the plan reads them several
    times and the texts behind them must be read once.
    """
    scores = cut(scores)
    tops = scores.groupBy(*group).agg(F.max("best_score").alias("_top"))
    key = F.when(F.col("_top") > 0, F.col(name)).otherwise(F.lpad(F.col(ordinal).cast("string"), 19, "0"))
    keyed = scores.join(tops, group).withColumn("_key", key).drop("_top")
    ranked = rank_all(keyed, group, [F.col("best_score").desc(), F.col("_key"), F.col(ordinal)], "doc_rank")
    return ranked.drop("_key")


def first_hit(hits: DataFrame, group: list[str]) -> DataFrame:
    """First (doc_rank, batch) with evidence per group: a plain minimum."""
    return (hits.groupBy(*group).agg(F.min(F.struct("doc_rank", "batch")).alias("_f"))
            .select(*group, F.col("_f.doc_rank").alias("doc_rank"), F.col("_f.batch").alias("batch")))


def attach_text(hits: DataFrame, chunks: DataFrame, key: list[str], index_copy: DataFrame | None = None) -> DataFrame:
    """Look hits up in the corpus by key, else in the index's own copy.

    The corpus is first cut to the distinct keys of the hits, a semi-join whose
    small side Spark may broadcast, so that only the texts of hits move on.
    """
    wanted = hits.select(*key).distinct()
    texts = lambda df, text, name: df.select(*key, F.col(text).alias(name)).join(wanted, key, "left_semi")
    out = hits.join(texts(chunks, "text", "_corpus"), key, "left")
    if index_copy is None:
        return out.withColumnRenamed("_corpus", "text")
    out = out.join(texts(index_copy, "document", "_index"), key, "left")
    return out.withColumn("text", F.coalesce("_corpus", "_index")).drop("_corpus", "_index")
