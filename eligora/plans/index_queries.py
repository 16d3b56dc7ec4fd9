"""Index upkeep and the retrieval modes of the assessment, over all given documents with a stand-in model."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora.operators.assess import assess
from eligora.operators.index import VectorIndex
from eligora.plans import domain as D
from eligora.plans import model_queries as Q
from eligora.session import ensure_checkpoint_dir
from eligora.sources import models as M

REVISED = " (revised)"
POOL = 3


class DigestReader(Q.DigestModel):
    """Finds one item in every context, its digest; a text's vector is four bytes of its digest."""

    def chat(self, messages: list[dict], json_mode: bool, max_tokens: int) -> str:
        content = messages[-1]["content"]
        if "\nExcerpts:\n" not in content:
            return super().chat(messages, json_mode, max_tokens)
        return f'{{"evidence": [{{"extracted_value": "{hashlib.md5(content.encode()).hexdigest()}"}}]}}'

    def embed(self, text: str) -> list[float]:
        digest = hashlib.md5(text.encode()).digest()
        return [byte - 127.5 for byte in digest[:4]]


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return D.files(spark, sf).select("bidder_id", F.col("doc_id").alias("doc_pos"), "filename", F.md5("full_text").alias("file_hash"),
                                     "full_text", F.lit(None).cast("double").alias("min_ocr_confidence"))


def _new_index(spark: SparkSession) -> VectorIndex:
    ensure_checkpoint_dir(spark)
    index = VectorIndex(spark, f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}")
    index.create()
    return index


def index_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, then all again after every third bidder revised its files: only these get a new version."""
    index, files = _new_index(spark), _files(spark, sf)
    index.refresh(files, DigestReader, "digest")
    text = F.when(F.col("bidder_id") % 3 == 0, F.concat("full_text", F.lit(REVISED))).otherwise(F.col("full_text"))
    index.refresh(files.withColumn("full_text", text).withColumn("file_hash", F.md5("full_text")), DigestReader, "digest")
    return index.rows().select("id", "bidder_id", "kind", "source_document", "chunk_index", "version", F.md5("document").alias("document_md5"),
                               F.get("embedding", F.lit(0)).cast("double").alias("first_value"))


def _assessed(spark: SparkSession, sf: str, **mode) -> DataFrame:
    files = D.files(spark, sf)
    bidders = files.select(F.col("bidder_id").alias("id"), "tender_id", F.col("bidder_id").cast("string").alias("name")).distinct()
    criteria = D.text_criteria(spark, sf).select(
        (F.col("tender_id") * 10 + F.col("criterion_id")).alias("id"), "tender_id", F.concat(F.lit("C-"), F.col("criterion_id").cast("string")).alias("crit_code"),
        "description", F.lit("other").alias("category"), F.lit(True).alias("mandatory"), "threshold", "expected_evidence")
    documents = files.select("bidder_id", "tender_id", F.col("doc_id").alias("doc_ordinal"), "filename", "full_text",
                             F.lit(None).cast("double").alias("min_ocr_confidence"))
    evidence, _ = assess(bidders, criteria, documents, DigestReader, **mode)
    return evidence.select("bidder_id", "criterion_id", "source_document", "extracted_value")


def assess_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of every pair from its eight best chunks by keywords."""
    return _assessed(spark, sf, retrieval="top_k")


def assess_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of every pair from near chunks, near summaries and keywords; a small pool, so that all three show."""
    index = _new_index(spark)
    index.refresh(_files(spark, sf), DigestReader, "digest")
    return _assessed(spark, sf, retrieval="vector", index=index.rows(), pool=POOL)


def _stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _bytes(digest: str) -> str:
    return "[" + ", ".join(f"('0x' || substr({digest}, {2 * i + 1}, 2))::INT - 127.5::DOUBLE" for i in range(4)) + "]"


_SUMMARIES = Q.QUERIES["document_summaries"][1]
_REVISED = (f"FROM (SELECT * REPLACE (CASE WHEN CAST(substr(source, 4) AS BIGINT) % 3 = 0 THEN text || '{REVISED}' ELSE text END AS text) "
            "FROM documents) AS d")
_RULES = ", ".join(f"({p}::BIGINT, '{d}', '{e}', '{t}')" for p, d, e, t in D.TEXT_RULES)
_PROMPT = Q._filled(M.EVIDENCE_PROMPT, description="description", threshold="threshold", expected_evidence="expected_evidence", context="context")
_KEYWORD = f"""{D.SCORED_SQL}, rules(criterion_id, description, expected_evidence, threshold) AS (VALUES {_RULES}),
  tops AS (SELECT bidder_id, criterion_id, max(score) AS top FROM scored GROUP BY ALL),
  kw AS (SELECT bidder_id, tender_id, criterion_id, doc_id, chunk_index, row_number() OVER (PARTITION BY bidder_id, criterion_id
      ORDER BY score DESC, doc_id, chunk_index) AS rank FROM scored JOIN tops USING (bidder_id, criterion_id) WHERE score > 0 OR top = 0)"""


def _asked(hits: str) -> str:
    """Evidence of the ranked hits (bidder_id, tender_id, criterion_id, doc_id, chunk_index, rank) in table ``hits``."""
    return f"""asked AS (SELECT h.bidder_id, h.tender_id, h.criterion_id, min_by(c.filename, h.rank) AS source_document,
      string_agg('[CHUNK ' || h.rank || ' from ' || c.filename || ']' || chr(10) || c.text, chr(10) || chr(10) ORDER BY h.rank) AS context
    FROM {hits} h JOIN chunks c ON c.doc_id = h.doc_id AND c.chunk_index = h.chunk_index WHERE h.rank <= 8 GROUP BY ALL)
  SELECT bidder_id, tender_id * 10 + criterion_id AS criterion_id, source_document, md5({_PROMPT}) AS extracted_value
  FROM asked JOIN rules USING (criterion_id)"""


_QUERY_TEXT = "concat_ws(chr(10), description, nullif(threshold, ''), nullif(expected_evidence, ''), 'other')"
_DOT = "list_sum(list_transform(range(1, 5), lambda i: {a}[i] * {b}[i]))"
_VECTOR = f"""WITH {_KEYWORD},
  vec AS (SELECT bidder_id, tender_id, doc_id, chunk_index, 'chunk' AS kind, md5({_stripped('text')}) AS m FROM chunks WHERE regexp_matches(text, '\\S')
    UNION ALL SELECT bidder_id, tender_id, doc_id, -1, 'doc_summary', md5(summary) FROM ({_SUMMARIES}) s JOIN files USING (doc_id)),
  v AS (SELECT *, {_bytes('m')} AS e FROM vec), q AS (SELECT criterion_id, {_bytes('m')} AS g FROM (SELECT criterion_id, md5({_QUERY_TEXT}) AS m FROM rules)),
  s AS (SELECT bidder_id, tender_id, criterion_id, kind, doc_id, chunk_index, {_DOT.format(a='e', b='g')}
      / (sqrt({_DOT.format(a='e', b='e')}) * sqrt({_DOT.format(a='g', b='g')})) AS cosine FROM v CROSS JOIN q),
  n AS (SELECT *, row_number() OVER (PARTITION BY bidder_id, criterion_id, kind ORDER BY cosine DESC, doc_id, chunk_index) AS rank FROM s),
  t1 AS (SELECT bidder_id, tender_id, criterion_id, doc_id, chunk_index, 1 AS tier, rank AS pos FROM n WHERE kind = 'chunk' AND rank <= {POOL}),
  t2 AS (SELECT n.bidder_id, n.tender_id, n.criterion_id, c.doc_id, c.chunk_index, 2 AS tier, n.rank * 2 + row_number() OVER
      (PARTITION BY n.bidder_id, n.criterion_id, c.doc_id ORDER BY c.chunk_index) AS pos, row_number() OVER
      (PARTITION BY n.bidder_id, n.criterion_id, c.doc_id ORDER BY c.chunk_index) AS rn FROM n JOIN chunks c USING (doc_id)
    WHERE n.kind = 'doc_summary' AND n.rank <= 4 AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.bidder_id = n.bidder_id
      AND t1.criterion_id = n.criterion_id AND t1.doc_id = c.doc_id AND t1.chunk_index = c.chunk_index)),
  u AS (SELECT bidder_id, tender_id, criterion_id, doc_id, chunk_index, min((tier, pos)) AS p FROM (
      SELECT * FROM t1 UNION ALL SELECT * EXCLUDE (rn) FROM t2 WHERE rn <= 2
      UNION ALL SELECT bidder_id, tender_id, criterion_id, doc_id, chunk_index, 3, rank FROM kw WHERE rank <= 16) GROUP BY ALL),
  hits AS (SELECT *, row_number() OVER (PARTITION BY bidder_id, criterion_id ORDER BY p) AS rank FROM u),
  {_asked('hits')}"""

QUERIES = {
    "index_refresh": (index_refresh, f"""WITH {D.CHUNKS_SQL.replace('FROM documents', _REVISED)},
      r AS (SELECT 'b' || bidder_id || '_d' || doc_id || '_c' || chunk_index AS id, bidder_id, 'chunk' AS kind, filename AS source_document,
          chunk_index::INT AS chunk_index, text AS document FROM chunks
        UNION ALL SELECT 'b' || bidder_id || '_d' || doc_id || '_summary', bidder_id, 'doc_summary', filename, -1, summary
        FROM ({_SUMMARIES.replace('FROM documents', _REVISED)}) s JOIN files USING (doc_id))
      SELECT id, bidder_id, kind, source_document, chunk_index, CASE WHEN bidder_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version,
        md5(document) AS document_md5, CASE WHEN regexp_matches(document, '\\S') THEN {_bytes("md5(" + _stripped("document") + ")")}[1] END
        AS first_value FROM r"""),
    "assess_topk": (assess_topk, f"WITH {_KEYWORD}, {_asked('kw')}"),
    "assess_vector": (assess_vector, _VECTOR),
}
