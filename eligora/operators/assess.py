"""The whole assessment: documents and criteria in, evidence and verdicts out."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.functions import text as X
from eligora.operators import evaluate as E
from eligora.operators import extraction as EX
from eligora.operators import hits as H
from eligora.operators import retrieval as R
from eligora.operators import worklist as W
from eligora.operators.ranking import rank_all
from eligora.options import Options
from eligora.session import cut
from eligora.sources.models import (Call, ClientFactory, ask, embed, model_extractor, money_with_model,
                                    no_evidence_rows, qualitative_verdicts)
from eligora.sources.replies import ReplyStore, ask_once, available

PAIR = E.PAIR


def _batches(chunks: DataFrame, prepared: DataFrame, pending: DataFrame, batch_size: int) -> DataFrame:
    """Narrow scan items of the pending pairs: keys, best score, wording."""
    words = R.keyword_criteria(prepared, ["tender_id", "criterion_id"])
    scored = R.score_chunks(chunks, words, ["tender_id"], ["bidder_id", "doc_ordinal", "source_document", "chunk_index"])
    best = scored.groupBy(*PAIR, "source_document", "doc_ordinal",
                          F.floor(F.col("chunk_index") / batch_size).cast("int").alias("batch")
                          ).agg(F.max("score").alias("best_score"))
    return best.join(pending.select(*PAIR), PAIR, "left_semi").join(_asked(prepared), "criterion_id")


def _asked(prepared: DataFrame) -> DataFrame:
    """What a prompt says of each criterion."""
    return prepared.select("criterion_id", "description", "threshold", "expected_evidence", "crit_code",
                           (F.col("required_count") > 1).alias("merge_all"))


def _hits(chunks: DataFrame, prepared: DataFrame, pending: DataFrame, client: ClientFactory | None,
          index: DataFrame | None, k: int, pool: int) -> DataFrame:
    """Ranked chunks of each pending pair, stored, since their texts are looked up by them."""
    if index is None or client is None:
        return cut(H.keyword_hits(chunks, prepared, pending, k))
    told = prepared.select("tender_id", "criterion_id", X.criterion_query_text().alias("_query"))
    queries = embed(told, "_query", client).drop("_query")
    keyword = cut(H.keyword_hits(chunks, prepared, pending, 2 * k))
    return cut(H.vector_hits(index, queries, chunks, keyword, pending, k, pool))


def assess(bidders: DataFrame, criteria: DataFrame, documents: DataFrame, client: ClientFactory | None,
           done: DataFrame | None = None, reserve: bool = False,
           batch_size: int = K.CHUNKS_PER_CALL, retrieval: str = "scan", index: DataFrame | None = None,
           k: int = K.TOP_K, pool: int = K.VECTOR_POOL, fast: ClientFactory | None = None, call: Call = ask,
           money_confidence: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Evidence and verdicts of all pairs that have no verdict in ``done``.

    bidders: id, tender_id, name.  criteria: the stored table.  documents:
    bidder_id, tender_id, doc_ordinal, filename, full_text, min_ocr_confidence.
    With ``reserve`` a document serves one criterion per bidder.  Without a
    ``client`` there is no evidence, and every pair gets the verdict for that.

    ``retrieval`` tells where evidence is looked for: "scan" reads documents batch
    by batch until something is found, "top_k" the ``k`` best chunks by keywords,
    "vector" chunks near the criterion in ``index`` (``VectorIndex.rows``) too, and
    keywords alone for a bidder without an index.  ``reserve`` belongs to scans.

    ``fast`` is a smaller model for evidence and amounts, if there is one; ``call``
    makes the calls.  With ``money_confidence`` amounts of criteria that the rules are
    less sure of are asked for; criteria ids must then be unique.
    """
    if retrieval not in ("scan", "top_k", "vector") or (retrieval == "vector") != (index is not None):
        raise ValueError("retrieval is scan, top_k, or vector with an index")
    if reserve and retrieval != "scan":
        raise ValueError("documents are reserved in a scan only")
    fast = fast or client
    asking = client is not None and money_confidence is not None
    prepared = E.prepare_criteria(criteria, partial(money_with_model, client=fast, call=call, confidence=money_confidence) if asking else None)
    pairs = W.work_list(bidders, criteria)
    pending = pairs if done is None else W.pending_pairs(pairs, done)
    named = documents.withColumnRenamed("filename", "source_document")
    chunks = R.chunk_documents(named, ["tender_id", "bidder_id", "doc_ordinal", "source_document"])
    usable = named.where(F.coalesce("full_text", F.lit("")).rlike(r"(?U)\S")).select("bidder_id")
    empty = E.empty_corpus_verdicts(pending, usable)
    pending = pending.join(usable.distinct(), "bidder_id", "left_semi")

    place = ["bidder_id", "doc_ordinal"]

    def contexts(wanted: DataFrame) -> DataFrame:
        """Batch texts of the documents of one wave; no other document is cut or moved."""
        return R.document_batches(named.join(wanted, place, "left_semi"), [*place, "source_document"], batch_size)
    confidences = named.withColumnRenamed("min_ocr_confidence", "ocr_confidence")
    if retrieval == "scan":
        extract = model_extractor(fast, contexts, confidences, ["bidder_id", "source_document"], place, call)
        batches = _batches(chunks, prepared, pending, batch_size)
    else:
        batches = cut(H.hit_batches(_hits(chunks, prepared, pending, client, index, k, pool), chunks))
        extract = model_extractor(fast, batches, confidences, ["bidder_id", "source_document"], PAIR, call)
        batches = batches.drop("context").join(_asked(prepared), "criterion_id").withColumn("seq", F.lit(1).cast("bigint"))
    if client is None:
        extract = no_evidence_rows
    if retrieval != "scan":
        found = extract(batches)
    elif reserve:
        order = prepared.select("tender_id", "criterion_id", "crit_code")
        position = rank_all(order, ["tender_id"], [F.length("crit_code"), F.col("crit_code"), F.col("criterion_id")], "position").select("criterion_id", "position")
        found = EX.scan_reserving(batches.join(position, "criterion_id"), "bidder_id", "position", PAIR, extract)
    else:
        found = EX.scan(EX.sequence_batches(batches, PAIR), PAIR, extract)
    rows = found.select(*PAIR, F.struct("seq", "item").alias("place"), "source_document", "extracted_value", "normalized_value",
                        "source_text", "ocr_confidence", "notes", "merge_all")
    kept = EX.distinct_evidence(rows, PAIR, "place", several="merge_all").drop("merge_all")
    evidence = rank_all(kept, PAIR, [F.col("place"), F.col("source_document"), F.xxhash64("extracted_value", "source_text", "notes")],
                        "ordinal").drop("place")
    evidence = cut(evidence)

    numbers = E.evidence_numbers(evidence, prepared)
    ruled = E.quantitative_verdicts(pending.select(*PAIR), prepared, numbers)
    judged = prepared.where(F.col("route") == "qualitative")
    other = pending.join(judged.select("criterion_id"), "criterion_id", "left_semi")
    columns = [*PAIR, "verdict", "explanation", "confidence"]
    told = qualitative_verdicts(other, judged, evidence, client, call=call) if client else E.unjudged_verdicts(other, prepared, evidence)
    verdicts = (ruled.select(*columns).unionByName(told.select(*columns))
                .unionByName(empty.select(*columns)))
    return evidence, verdicts


def assess_by(options: Options, bidders: DataFrame, criteria: DataFrame, documents: DataFrame, client: ClientFactory | None = None,
              fast: ClientFactory | None = None, index: DataFrame | None = None, done: DataFrame | None = None,
              store: ReplyStore | None = None) -> tuple[DataFrame, DataFrame]:
    """``assess`` as the options say: equal requests once, a bounded number at a time, stored replies first.

    A model that cannot be reached counts as none, a fast one that cannot be reached
    leaves its work to the other.  Stored replies belong to the factory's ``name``; give
    another model another name.  The index is used where options and ``index`` allow it.
    """
    spark = documents.sparkSession
    client = client if client and available(spark, client) else None
    fast = fast if client and fast and available(spark, fast) else None
    indexed = options.index and options.evidence_from_index and index is not None and client is not None

    def call(df: DataFrame, prompt: str, factory: ClientFactory, *more, **named) -> DataFrame:
        name = getattr(factory, "name", "fast" if fast is not None and factory is fast else "main")
        return ask_once(df, prompt, factory, *more, at_once=options.calls_at_once, store=store, model=name, **named)
    return assess(bidders, criteria, documents, client, done, options.reserve_documents and not indexed, options.batch_chunks,
                  "vector" if indexed else "scan", index if indexed else None, pool=options.vector_pool, fast=fast, call=call,
                  money_confidence=options.money_confidence if options.money_model else None)
