"""Documents, chunks, retrieval, evidence texts and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora.functions import jsontext as J
from eligora.functions import text as X
from eligora.operators import dedupe
from eligora.operators import extraction as EX
from eligora.operators import retrieval as R
from eligora.operators import vectors as V
from eligora.plans import domain as D
from eligora.session import cut, spread
from eligora.sources import files as S

GROUP = ["bidder_id", "criterion_id"]


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return R.chunk_documents(D.files(spark, sf), ["doc_id", "bidder_id", "tender_id", "filename"])


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    criteria = R.keyword_criteria(D.text_criteria(spark, sf), ["tender_id", "criterion_id"])
    files = spread(D.files(spark, sf), "doc_id")
    chunks = R.chunk_documents(files, ["doc_id", "bidder_id", "tender_id", "filename"])
    return R.score_chunks(chunks, criteria, ["tender_id"], ["bidder_id", "doc_id", "filename", "chunk_index"])


def doc_hash(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))


def corpus_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.files(spark, sf).select("bidder_id", F.col("doc_id").alias("id"), "filename", "full_text",
                                     F.sha2("full_text", 256).alias("file_hash"))
    return V.corpus_fingerprint(docs)


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("doc_id", "chunk_index", F.length("text").alias("chars"),
                                     F.md5("text").alias("text_md5"))


def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).groupBy("bidder_id").agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"),
        F.max("chunk_index").alias("last_index"))


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    words = D.table(spark, sf, "documents").select("doc_id", X.keywords("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("n_keywords"),
                        F.md5(F.array_join(F.array_sort("w"), " ")).alias("keywords_md5"))


def chunk_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).groupBy("tender_id", "criterion_id", "score").agg(F.count("*").alias("chunks"))


def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    best = R.keyword_top_k(_scored(spark, sf), GROUP, ["doc_id", "chunk_index"])
    return best.select(*GROUP, "rank", "doc_id", "chunk_index", "score")


def topk_with_text(spark: SparkSession, sf: str) -> DataFrame:
    """Top chunks with their text looked up in the corpus."""
    chunks = _chunks(spark, sf).select("doc_id", "chunk_index", "text")
    found = R.attach_text(keyword_topk(spark, sf), chunks, ["doc_id", "chunk_index"])
    return found.select(*GROUP, "rank", "doc_id", "chunk_index", F.md5("text").alias("text_md5"))


def doc_order(spark: SparkSession, sf: str) -> DataFrame:
    scores = R.document_scores(_scored(spark, sf), GROUP, ["filename", "doc_id"])
    ranked = R.document_order(scores, GROUP, "filename", "doc_id")
    return ranked.select(*GROUP, "filename", "best_score", "doc_rank")


def chunk_batches(spark: SparkSession, sf: str) -> DataFrame:
    files = D.files(spark, sf).withColumnRenamed("filename", "source_document")
    return R.document_batches(files, ["doc_id", "source_document"]).select("doc_id", "batch", "chunks",
                                                      F.md5("context").alias("context_md5"))


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches with their best score; the score stands in for what they hold."""
    batched = _scored(spark, sf).withColumn("batch", F.floor(F.col("chunk_index") / 12).cast("int"))
    return batched.groupBy(*GROUP, F.col("filename").alias("source_document"),
                           F.col("doc_id").alias("doc_ordinal"), "batch").agg(F.max("score").alias("best_score"))


def first_hit_batch(spark: SparkSession, sf: str) -> DataFrame:
    """First document and batch with a chunk that holds two keywords."""
    batches = cut(_batches(spark, sf))
    order = R.document_order(batches.groupBy(*GROUP, "source_document", "doc_ordinal")
                             .agg(F.max("best_score").alias("best_score")), GROUP)
    hits = batches.where(F.col("best_score") >= 2).join(
        order.select(*GROUP, "doc_ordinal", "doc_rank"), GROUP + ["doc_ordinal"])
    return R.first_hit(hits, GROUP)


def reserve_fold(spark: SparkSession, sf: str) -> DataFrame:
    """First-hit scan in which a document serves one criterion per bidder."""
    batches = _batches(spark, sf).withColumns({
        "position": F.col("criterion_id"), "merge_all": F.lit(False), "batch_score": F.col("best_score")})

    def extract(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("batch_score") >= 2)
    found = EX.scan_reserving(batches, "bidder_id", "position", GROUP, extract, waves=False)
    return found.select(*GROUP, "source_document", "batch")


def evidence_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as evidence rows; same document, value and whole text fold."""
    lineitem = D.table(spark, sf, "lineitem")
    rows = lineitem.select(
        F.col("l_suppkey").alias("bidder_id"), F.col("l_linenumber").cast("bigint").alias("criterion_id"),
        F.pmod("l_orderkey", F.lit(50)).alias("source_document"),
        F.concat(F.lit(" "), F.col("l_returnflag"), F.col("l_linestatus")).alias("extracted_value"),
        F.concat(F.repeat(F.lit("x"), F.lit(239)), F.col("l_returnflag"), F.col("l_partkey").cast("string")
                 ).alias("source_text"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    kept = EX.distinct_evidence(rows, GROUP, whole=False)
    return kept.select(*GROUP, "source_document", F.col("extracted_value").alias("value"), "ordinal")


def _reply() -> Column:
    value = F.format_number("value", 2)
    return (F.when(F.col("event_type") == "click", F.col("props"))
            .when(F.col("event_type") == "view", F.concat(
                F.lit('Sure: {"evidence": [{"extracted_value": "v", "normalized_value": '),
                F.col("event_id").cast("string"), F.lit('}, 7, {"found": false}]} done')))
            .when(F.col("event_type") == "signup", F.concat(
                F.lit('[{"extracted_value": "'), value, F.lit('"}, {"extracted_value": "b"}]')))
            .when(F.col("event_type") == "purchase", F.concat(
                F.lit('{"evidence": {"extracted_value": "'), value, F.lit('", "found": true}}')))
            .otherwise(F.concat(F.lit("no json {"), value)))


def json_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    events = D.table(spark, sf, "events").select("event_id", "event_type", "props", "value")
    items = spread(events, "event_id").select("event_id", J.evidence_items(_reply()).alias("e"))
    return items.select("event_id", F.size("e").alias("items"), F.get("e", F.lit(0))["extracted_value"].alias("first_value"),
                        F.get("e", F.lit(0))["normalized_value"].alias("first_number"))


def safe_text(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("text"), F.lit(" “₹5” ≥ 3 – ok… Ωж"))
    return D.table(spark, sf, "documents").select("doc_id", F.md5(X.safe_text(text)).alias("safe_md5"))


def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "pages").select("page_id", F.md5(X.html_escape("html")).alias("escaped_md5"))


_ENDINGS = ["", ".PDF", ".txt", ".docx", ".Doc", ".jpeg", ".tiff", ".bmp", ".tar.gz", "/.txt"]


def type_detect(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.get(X.fixed_array(_ENDINGS), F.pmod("page_id", F.lit(len(_ENDINGS))).cast("int"))
    return D.table(spark, sf, "pages").select(
        "page_id", X.file_type(F.concat(F.regexp_replace("url", "[?#].*$", ""), ending)).alias("file_type"))


def doc_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents, turns as pages."""
    pages = D.table(spark, sf, "conversations").select(
        "conv_id", F.col("turn").alias("page_num"), "text",
        F.when(F.col("role") == "assistant", F.lit(50.0) + F.pmod(F.col("turn") * 7, F.lit(50))).alias("ocr_confidence"))
    docs = S.assemble_pages(pages, ["conv_id"])
    return docs.select("conv_id", F.md5("full_text").alias("text_md5"), F.length("full_text").alias("chars"),
                       "page_count", "min_ocr_confidence")


def ocr_words(spark: SparkSession, sf: str) -> DataFrame:
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(
        w.alias("text"), (F.pmod(i * 37 + F.col("turn") * 11, F.lit(120)) - 10).cast("double").alias("conf")))
    read = D.table(spark, sf, "conversations").select("conv_id", "turn", words.alias("w")).select(
        "conv_id", "turn", S.confident_words("w").alias("r"))
    return read.select("conv_id", "turn", F.md5("r.text").alias("text_md5"), F.col("r.confidence").alias("confidence"),
                       F.col("r.word_count").alias("word_count"))


def criterion_query_text(spark: SparkSession, sf: str) -> DataFrame:
    part = D.table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("description"), F.when(F.col("p_size") > 25, "").otherwise(
            F.concat(F.lit(">= "), F.col("p_size").cast("string"))).alias("threshold"),
        F.col("p_type").alias("expected_evidence"), F.col("p_brand").alias("category"))
    return part.select("p_partkey", X.criterion_query_text().alias("query_text"))


def display_forms(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "orders").select(
        "o_orderkey", X.display_time("o_orderdate").alias("shown_at"),
        X.path_safe(F.concat("o_orderpriority", F.lit("/a\\b"))).alias("path_name"),
        X.short_name(F.concat(F.repeat("o_orderpriority", F.lit(4)), F.lit(" Ltd."))).alias("short_name"))


def env_flags(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    raw = (F.when(kind == "click", " Off ").when(kind == "view", "TRUE").when(kind == "signup", "no")
           .when(kind == "purchase", "1"))
    return D.table(spark, sf, "events").select("event_id", X.flag(raw, True).alias("on_by_default"),
                                               X.flag(raw, False).alias("off_by_default"))


def section_union(spark: SparkSession, sf: str) -> DataFrame:
    """Market segments of a nation's customers, joined like source sections."""
    firsts = D.table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.min("c_custkey").alias("first"))
    listed = firsts.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("first", "c_mktsegment"))).alias("l"))
    names = F.transform("l", lambda x: x["c_mktsegment"])
    return listed.select("c_nationkey", dedupe.join_sections(F.lit(""), names).alias("sections"))


def greedy_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items and part names as criteria with near-duplicates."""
    items = D.table(spark, sf, "benchmark").select(
        F.lit("benchmark").alias("tender_id"), F.col("item_id").alias("ord"), F.col("text").alias("description"),
        F.lit("").alias("expected_evidence"))
    parts = D.table(spark, sf, "part").select(
        F.col("p_brand").alias("tender_id"), F.col("p_partkey").alias("ord"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"), F.col("p_type").alias("expected_evidence"))
    rows = items.unionByName(parts).select(
        "*", F.lit("other").alias("category"), F.lit(True).alias("mandatory"), F.lit("").alias("threshold"),
        F.lit("").alias("source_section"))
    return dedupe.merge_similar(rows).select("tender_id", "crit_code", "description", "expected_evidence", "merged")


_SAFE = "text || ' “₹5” ≥ 3 – ok… Ωж'"
for _char, _plain in X.K.SAFE_TEXT.items():
    _SAFE = f"replace({_SAFE}, '{_char}', '{_plain.replace(chr(39), chr(39) * 2)}')"
_ESCAPED = "html"
for _char, _entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _ESCAPED = f"replace({_ESCAPED}, '{_char}', '{_entity}')"
_STOP = ", ".join(f"'{w}'" for w in X.K.STOPWORDS)
_TOPK = f"""WITH {D.SCORED_SQL}, r AS (SELECT *, row_number() OVER w AS rank, max(score) OVER (PARTITION BY bidder_id,
  criterion_id) AS top FROM scored WINDOW w AS (PARTITION BY bidder_id, criterion_id ORDER BY score DESC, doc_id, chunk_index)),
 best AS (SELECT bidder_id, criterion_id, rank::INT AS rank, doc_id, chunk_index, score FROM r
  WHERE rank <= 8 AND (score > 0 OR top = 0))"""
_ORDER = f"""WITH {D.SCORED_SQL}, s AS (SELECT bidder_id, criterion_id, filename, doc_id, max(score) AS best_score
  FROM scored GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY bidder_id, criterion_id
    ORDER BY best_score DESC, filename) AS doc_rank FROM s)"""
_BATCH = f"""{_ORDER}, b AS (SELECT bidder_id, criterion_id, filename, doc_id, chunk_index // 12 AS batch,
  max(score) AS batch_score FROM scored GROUP BY ALL)"""


def _reserve_sql() -> str:
    steps, taken = [], []
    for c in (1, 2, 3):
        free = "".join(f" AND NOT EXISTS (SELECT 1 FROM r{t} WHERE r{t}.bidder_id = b.bidder_id AND "
                       f"r{t}.source_document = b.filename)" for t in taken)
        steps.append(f"""r{c} AS (SELECT b.bidder_id, b.criterion_id, arg_min(b.filename, (-s.best_score, b.filename, b.batch))
          AS source_document, arg_min(b.batch, (-s.best_score, b.filename, b.batch)) AS batch
          FROM b JOIN s USING (bidder_id, criterion_id, filename) WHERE b.criterion_id = {c} AND b.batch_score >= 2{free}
          GROUP BY ALL)""")
        taken.append(c)
    return f"{_BATCH}, {', '.join(steps)} " + " UNION ALL ".join(
        f"SELECT bidder_id, criterion_id, source_document, batch::INT AS batch FROM r{c}" for c in (1, 2, 3))


QUERIES = {
    "doc_hash": (doc_hash, "SELECT doc_id, sha256(text) AS file_hash FROM documents"),
    "corpus_fingerprint": (corpus_fingerprint, f"""WITH {D.FILES_SQL}, d AS (SELECT bidder_id,
      sha256(filename || '|' || sha256(text) || '|' || length(text)) AS d FROM files)
      SELECT bidder_id, concat_ws('-', count(*), {', '.join(
        f"sum(CAST('0x' || substr(d, {15 * i + 1}, 15) AS BIGINT))" for i in range(4))}) AS fingerprint FROM d GROUP BY bidder_id"""),
    "chunk_documents": (chunk_documents, f"""WITH {D.CHUNKS_SQL} SELECT doc_id, chunk_index, length(text)::INT AS chars,
      md5(text) AS text_md5 FROM chunks"""),
    "chunk_stats": (chunk_stats, f"""WITH {D.CHUNKS_SQL} SELECT bidder_id, count(*) AS chunks,
      sum(length(text))::BIGINT AS chars, max(chunk_index) AS last_index FROM chunks GROUP BY bidder_id"""),
    "keywords": (keywords, f"""WITH w AS (SELECT doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(lower(text),
      '[a-z]+[0-9]*|[0-9]+')), lambda t: NOT list_contains([{_STOP}], t) AND (length(t) >= 3 OR
        regexp_matches(t, '^[0-9]+$')))) AS w FROM documents)
      SELECT doc_id, len(w)::INT AS n_keywords, md5(array_to_string(w, ' ')) AS keywords_md5 FROM w"""),
    "chunk_scores": (chunk_scores, f"""WITH {D.SCORED_SQL} SELECT tender_id, criterion_id, score, count(*) AS chunks
      FROM scored GROUP BY ALL"""),
    "keyword_topk": (keyword_topk, f"{_TOPK} SELECT * FROM best"),
    "topk_with_text": (topk_with_text, f"""{_TOPK} SELECT b.bidder_id, b.criterion_id, rank, doc_id, chunk_index,
      md5(c.text) AS text_md5 FROM best b JOIN chunks c USING (doc_id, chunk_index)"""),
    "doc_order": (doc_order, f"""{_ORDER} SELECT bidder_id, criterion_id, filename, best_score, doc_rank FROM o"""),
    "chunk_batches": (chunk_batches, f"""WITH {D.CHUNKS_SQL} SELECT doc_id, (chunk_index // 12)::INT AS batch,
      count(*) AS chunks, md5(string_agg('[CHUNK ' || (chunk_index % 12 + 1) || ' from ' || filename || ']' || chr(10)
        || text, chr(10) || chr(10) ORDER BY chunk_index)) AS context_md5 FROM chunks GROUP BY ALL"""),
    "first_hit_batch": (first_hit_batch, f"""{_BATCH}, h AS (SELECT b.bidder_id, b.criterion_id, doc_rank, batch FROM b
      JOIN o USING (bidder_id, criterion_id, filename) WHERE batch_score >= 2)
      SELECT bidder_id, criterion_id, min(doc_rank) AS doc_rank, arg_min(batch, (doc_rank, batch))::INT AS batch
      FROM h GROUP BY ALL"""),
    "reserve_fold": (reserve_fold, _reserve_sql()),
    "evidence_dedupe": (evidence_dedupe, """SELECT l_suppkey AS bidder_id, l_linenumber::BIGINT AS criterion_id,
      l_orderkey % 50 AS source_document, l_returnflag || l_linestatus AS value, min(l_orderkey * 10 + l_linenumber) AS ordinal
      FROM lineitem GROUP BY l_suppkey, l_linenumber, l_orderkey % 50, l_returnflag, l_linestatus, l_partkey"""),
    "json_tolerant": (json_tolerant, """SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2
      WHEN 'purchase' THEN 1 ELSE 0 END AS items, CASE WHEN event_type = 'view' THEN 'v' WHEN event_type IN
        ('signup', 'purchase') THEN format('{:,.2f}', value) END AS first_value,
      CASE WHEN event_type = 'view' THEN event_id END::DOUBLE AS first_number FROM events"""),
    "safe_text": (safe_text, f"""SELECT doc_id, md5(regexp_replace({_SAFE}, '[^\\x{{00}}-\\x{{FF}}]', '?', 'g')) AS safe_md5
      FROM documents"""),
    "html_escape": (html_escape, f"SELECT page_id, md5({_ESCAPED}) AS escaped_md5 FROM pages"),
    "type_detect": (type_detect, """SELECT page_id, CASE
      WHEN regexp_replace(url, '[?#].*$', '') LIKE '%/' THEN 'unknown' ELSE CASE page_id % 10 WHEN 1 THEN 'pdf' WHEN 2 THEN 'text'
      WHEN 3 THEN 'docx' WHEN 4 THEN 'docx' WHEN 5 THEN 'image' WHEN 6 THEN 'image' WHEN 7 THEN 'image'
      ELSE 'unknown' END END AS file_type FROM pages"""),
    "doc_assembly": (doc_assembly, """SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)
        FILTER (WHERE text <> '')) AS text_md5,
      length(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE text <> ''))::INT AS chars,
      count(*) AS page_count, min(CASE WHEN role = 'assistant' THEN 50.0 + (turn * 7) % 50 END)::DOUBLE
        AS min_ocr_confidence FROM conversations GROUP BY conv_id"""),
    "ocr_words": (ocr_words, r"""WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations),
      k AS (SELECT conv_id, turn, i, ws[i + 1] AS word, (i * 37 + turn * 11) % 120 - 10 AS conf
        FROM w, UNNEST(range(0, len(ws))) AS u(i)),
      g AS (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY i) AS t, round(avg(conf), 2) AS c, count(*)::INT AS n FROM k
        WHERE conf > 0 AND regexp_matches(word, '\S') GROUP BY ALL)
      SELECT conv_id, turn, md5(coalesce(t, '')) AS text_md5, coalesce(c, 0.0)::DOUBLE AS confidence,
        coalesce(n, 0)::INT AS word_count FROM w LEFT JOIN g USING (conv_id, turn)"""),
    "criterion_query_text": (criterion_query_text, """SELECT p_partkey, concat_ws(chr(10), p_name,
      CASE WHEN p_size <= 25 THEN '>= ' || p_size END, p_type, p_brand) AS query_text FROM part"""),
    "display_forms": (display_forms, r"""SELECT o_orderkey, strftime(o_orderdate, '%d %B %Y, %H:%M') AS shown_at,
      replace(o_orderpriority, ' ', '_') || '_a_b' AS path_name,
      CASE WHEN length(repeat(o_orderpriority, 4) || ' Ltd.') > 42 THEN left(repeat(o_orderpriority, 4) || ' Ltd.', 42) || '...'
        ELSE repeat(o_orderpriority, 4) || ' Ltd.' END AS short_name FROM orders"""),
    "env_flags": (env_flags, """SELECT event_id, event_type NOT IN ('click', 'signup') AS on_by_default,
      event_type IN ('view', 'purchase') AS off_by_default FROM events"""),
    "section_union": (section_union, """WITH f AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer
      GROUP BY ALL) SELECT c_nationkey, left(string_agg(c_mktsegment, '; ' ORDER BY k), 500) AS sections FROM f
      GROUP BY c_nationkey"""),
    "greedy_dedupe": (greedy_dedupe, None),
}
