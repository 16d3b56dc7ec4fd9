"""Vector search over the given embeddings.

Vectors of label 0 are document summaries, all others chunks.  Five consecutive
vectors make a document, documents belong to five tenders in turn, and the
criteria of a tender are the mean vectors of its labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora.functions import text as X
from eligora.operators import retrieval as R
from eligora.operators import vectors as V
from eligora.plans import domain as D
from eligora.plans import model_queries as Q
from eligora.session import sized
from eligora.sources import models as M

DIMS = 64
GROUP = ["tender_id", "criterion_id"]


def _tender() -> Column:
    return F.pmod(F.floor(F.col("vec_id") / 5), F.lit(5)).alias("tender_id")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "embeddings").select(
        _tender(), F.when(F.col("label") == 0, "doc_summary").otherwise("chunk").alias("kind"),
        F.floor(F.col("vec_id") / 5).alias("source_document"), F.pmod("vec_id", F.lit(5)).alias("chunk_index"),
        F.col("vec_id").alias("ordinal"), "embedding")


def _criteria(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector per tender and label, a hash aggregate with a state per dimension."""
    means = D.table(spark, sf, "embeddings").groupBy(_tender(), "label").agg(
        *[F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"d{i}") for i in range(DIMS)])
    return sized(means.select("tender_id", F.col("label").cast("bigint").alias("criterion_id"),
                        F.array(*[f"d{i}" for i in range(DIMS)]).alias("embedding")))


def _hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Nearest vectors per criterion and kind; all kinds are scored together."""
    scored = V.similarities(_vectors(spark, sf), _criteria(spark, sf), ["tender_id"],
                            ["kind", "source_document", "chunk_index", "ordinal"], DIMS, digits=6)
    return V.nearest(scored, GROUP + ["kind"], ["ordinal"], k)


def _of_kind(hits: DataFrame, kind: str, k: int) -> DataFrame:
    return hits.where((F.col("kind") == kind) & (F.col("rank") <= k))


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _of_kind(_hits(spark, sf, 24), "chunk", 24).select(*GROUP, "rank", "ordinal", "cosine")


def summary_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _of_kind(_hits(spark, sf, 4), "doc_summary", 4).select(*GROUP, "rank", "source_document", "cosine")


def _fused(spark: SparkSession, sf: str, pool: int, k: int) -> DataFrame:
    corpus = _vectors(spark, sf).select("tender_id", "source_document", "chunk_index", "ordinal")
    words = X.keywords(F.lit("Thinly blended section of inner heed and worthless motion"))
    # scored at the scan, so that no text is moved; a vector without a text scores nothing
    scores = D.table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), X.keyword_score("text", words).alias("_score"))
    scored = corpus.join(scores, "ordinal", "left").select(
        "tender_id", "source_document", "chunk_index", "ordinal", F.coalesce("_score", F.lit(0)).alias("score"))
    labels = D.table(spark, sf, "embeddings").select(
        _tender(), F.col("label").cast("bigint").alias("criterion_id")).distinct()
    # The same words are used for all criteria of a tender, so one list serves them all.
    best = R.keyword_top_k(scored, ["tender_id"], ["ordinal"], 2 * k)
    keyword = labels.join(best, "tender_id")
    hits = _hits(spark, sf, max(pool, 4))
    return V.fuse(_of_kind(hits, "chunk", pool), _of_kind(hits, "doc_summary", 4), corpus, keyword, GROUP, k, pool)


def fused_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Usual sizes: 24 vector hits already fill the eight places."""
    return _fused(spark, sf, 24, 8)


def fused_topk_small_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Three vector hits, so that all three tiers show."""
    return _fused(spark, sf, 3, 16)


def index_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Index rows of the chunks and of the stand-in model's summaries of whole texts, without vectors."""
    files = D.files(spark, sf).select("bidder_id", F.col("doc_id").alias("doc_pos"), "filename", "full_text",
                                      F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 1.0).alias("min_ocr_confidence"))
    chunks = R.chunk_documents(files, ["bidder_id", "doc_pos"])
    told = M.summarise(files, ["bidder_id", "doc_pos"], Q.DigestModel)
    rows = V.index_rows(files, chunks, told)
    return rows.select("id", "bidder_id", "kind", "source_document", "chunk_index", F.md5("document").alias("document_md5"),
                       "ocr_confidence")


_SCORED = """v AS (SELECT vec_id, label, (vec_id // 5) % 5 AS tender_id, vec_id // 5 AS source_document, vec_id % 5 AS chunk_index,
  list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
q AS (SELECT tender_id, label::BIGINT AS criterion_id, list(a ORDER BY i) AS m FROM (SELECT tender_id, label, i, avg(e[i]) AS a
  FROM v, UNNEST(range(1, 65)) AS u(i) GROUP BY ALL) GROUP BY tender_id, label),
s AS (SELECT tender_id, criterion_id, vec_id, source_document, chunk_index, label, round(list_cosine_similarity(e, m), 6) AS cosine
  FROM v JOIN q USING (tender_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY tender_id, criterion_id ORDER BY cosine DESC, vec_id) AS rank FROM s WHERE label <> 0),
d AS (SELECT *, row_number() OVER (PARTITION BY tender_id, criterion_id ORDER BY cosine DESC, vec_id) AS rank FROM s WHERE label = 0)"""
_WORDS = ["thinly", "blended", "section", "inner", "heed", "worthless", "motion"]


def _fused_sql(pool: int, k: int) -> str:
    score = " + ".join(f"contains(lower(text), '{w}')::INT" for w in _WORDS)
    return f"""WITH {_SCORED}, t1 AS (SELECT tender_id, criterion_id, source_document, chunk_index, 1 AS tier, rank AS pos FROM c
   WHERE rank <= {pool}),
  boosted AS (SELECT tender_id, criterion_id, source_document, min(rank) AS dp FROM d WHERE rank <= 4 GROUP BY ALL),
  t2 AS (SELECT b.tender_id, b.criterion_id, v.source_document, v.chunk_index, 2 AS tier, dp * 2 + row_number() OVER
      (PARTITION BY b.criterion_id, v.source_document ORDER BY v.vec_id) AS pos,
    row_number() OVER (PARTITION BY b.criterion_id, v.source_document ORDER BY v.vec_id) AS rn FROM boosted b
    JOIN v USING (tender_id, source_document) WHERE NOT EXISTS (SELECT 1 FROM t1 WHERE t1.criterion_id = b.criterion_id
      AND t1.source_document = v.source_document AND t1.chunk_index = v.chunk_index)),
  k AS (SELECT tender_id, vec_id, source_document, chunk_index, coalesce({score}, 0) AS score FROM v LEFT JOIN documents ON doc_id = vec_id),
  m AS (SELECT tender_id, max(score) AS top FROM k GROUP BY tender_id),
  t3 AS (SELECT tender_id, criterion_id, source_document, chunk_index, 3 AS tier, row_number() OVER (PARTITION BY tender_id,
    criterion_id ORDER BY score DESC, vec_id) AS pos FROM k JOIN q USING (tender_id) JOIN m USING (tender_id)
    WHERE score > 0 OR top = 0),
  u AS (SELECT tender_id, criterion_id, source_document, chunk_index, min((tier, pos)) AS p FROM (
    SELECT tender_id, criterion_id, source_document, chunk_index, tier, pos FROM t1 UNION ALL
    SELECT tender_id, criterion_id, source_document, chunk_index, tier, pos FROM t2 WHERE rn <= 2 UNION ALL
    SELECT tender_id, criterion_id, source_document, chunk_index, tier, pos FROM t3 WHERE pos <= {2 * k}) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY tender_id, criterion_id ORDER BY p) AS rank FROM u)
 SELECT tender_id, criterion_id, source_document, chunk_index, p[1]::INT AS tier, rank::INT AS rank FROM r WHERE rank <= {k}"""


QUERIES = {
    "cosine_topk": (cosine_topk, f"""WITH {_SCORED} SELECT tender_id, criterion_id, rank::INT AS rank, vec_id AS ordinal, cosine
      FROM c WHERE rank <= 24"""),
    "summary_topk": (summary_topk, f"""WITH {_SCORED} SELECT tender_id, criterion_id, rank::INT AS rank, source_document, cosine
      FROM d WHERE rank <= 4"""),
    "fused_topk": (fused_topk, _fused_sql(24, 8)),
    "fused_topk_small_pool": (fused_topk_small_pool, _fused_sql(3, 16)),
    "index_metadata": (index_metadata, f"""WITH {D.CHUNKS_SQL}, m AS (SELECT doc_id,
        CASE WHEN doc_id % 3 = 0 THEN doc_id * 1.0 END::DOUBLE AS ocr FROM files)
      SELECT 'b' || bidder_id || '_d' || doc_id || '_c' || chunk_index AS id, bidder_id, 'chunk' AS kind,
        filename AS source_document, chunk_index, md5(text) AS document_md5, ocr AS ocr_confidence
      FROM chunks JOIN m USING (doc_id)
      UNION ALL SELECT 'b' || bidder_id || '_d' || doc_id || '_summary', bidder_id, 'doc_summary', filename, -1,
        md5(summary), ocr FROM ({Q.QUERIES['document_summaries'][1]}) s JOIN files USING (doc_id) JOIN m USING (doc_id)"""),
}
