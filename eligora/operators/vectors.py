"""Vector search over document chunks, and its fusion with keyword search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.operators.ranking import top_k
from eligora.session import cut


def _sum(terms: list[Column]) -> Column:
    """Balanced sum, so that long vectors do not make a deep expression."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def dot(a: Column | str, b: Column | str, dims: int | None = None) -> Column:
    """Dot product.  With ``dims`` it is plain arithmetic inside generated code."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    if dims:
        return _sum([F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double") for i in range(dims)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def with_norm(vectors: DataFrame, dims: int | None = None, column: str = "embedding") -> DataFrame:
    return vectors.withColumn("norm", F.sqrt(dot(column, column, dims)))


def similarities(vectors: DataFrame, queries: DataFrame, on: list[str], keep: list[str],
                 dims: int | None = None, digits: int | None = None) -> DataFrame:
    """Cosine of each vector with each query that shares its ``on`` keys.

    Exact.  Queries are criteria, a few per tender, so this is a scan of the
    vectors with an equi-join to a small side; vectors are dropped at once.
    """
    v = with_norm(vectors.select(*on, *keep, "embedding"), dims)
    q = with_norm(queries.select(*on, "criterion_id", F.col("embedding").alias("query")), dims, "query")
    joined = v.join(q.withColumnRenamed("norm", "query_norm"), on)
    cosine = dot("embedding", "query", dims) / (F.col("norm") * F.col("query_norm"))
    return joined.select(*on, *keep, "criterion_id", (F.round(cosine, digits) if digits else cosine).alias("cosine"))


def nearest(scored: DataFrame, group: list[str], tie: list[str], k: int) -> DataFrame:
    return top_k(scored, group, [F.col("cosine").desc(), *[F.col(c) for c in tie]], k)


def fuse(vector_hits: DataFrame, summary_hits: DataFrame, corpus: DataFrame, keyword_hits: DataFrame,
         group: list[str], k: int = K.TOP_K, pool: int = K.VECTOR_POOL) -> DataFrame:
    """Ordered union of three lists per group, first appearance wins, ``k`` rows.

    Vector hits come by rank; then up to two more chunks of each document whose
    summary matched, by summary rank and corpus order; then keyword hits.  Hits
    carry source_document and chunk_index; corpus has the document keys of
    ``group`` it shares, source_document, chunk_index and ordinal.  ``pool`` is
    the number of vector hits: of a document, no more than its first ``pool``
    chunks plus two can be needed, so only these are joined per criterion.
    """
    key = group + ["source_document", "chunk_index"]
    first = vector_hits.select(*key, F.lit(1).alias("tier"), F.col("rank").cast("bigint").alias("pos"))
    shared = [c for c in group if c in corpus.columns]
    docs = summary_hits.groupBy(*group, "source_document").agg(F.min("rank").alias("doc_pos"))
    heads = top_k(corpus, shared + ["source_document"], [F.col("ordinal")], pool + K.CHUNKS_PER_BOOSTED_DOC, "_r")
    more = (heads.drop("_r").join(docs, shared + ["source_document"])
            .join(first.select(*key), key, "left_anti"))
    more = top_k(more, group + ["source_document"], [F.col("ordinal")], K.CHUNKS_PER_BOOSTED_DOC, "_r")
    second = more.select(*key, F.lit(2).alias("tier"),
                         (F.col("doc_pos") * K.CHUNKS_PER_BOOSTED_DOC + F.col("_r")).cast("bigint").alias("pos"))
    third = keyword_hits.select(*key, F.lit(3).alias("tier"), F.col("rank").cast("bigint").alias("pos"))
    once = (first.unionByName(second).unionByName(third)
            .groupBy(*key).agg(F.min(F.struct("tier", "pos")).alias("_p")))
    return (top_k(once, group, [F.col("_p")], k)
            .select(*key, F.col("_p.tier").alias("tier"), F.col("rank")))


def corpus_fingerprint(documents: DataFrame, key: str = "bidder_id") -> DataFrame:
    """Digest of each bidder's files, in no order and of one form for every size.

    A file's filename|hash|length line has a SHA-256, whose first 60 hex digits
    are four numbers; the fingerprint is the count of files and the four sums.
    The sums are partial aggregates, so no list of files is ever gathered.
    """
    line = F.concat_ws("|", F.coalesce("filename", F.lit("")), F.coalesce("file_hash", F.lit("")),
                       F.coalesce(F.length("full_text"), F.lit(0)).cast("string"))
    digest = documents.select(key, F.sha2(line, 256).alias("_d"))
    words = [F.conv(F.substring("_d", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)").alias(f"_w{i}") for i in range(4)]
    sums = digest.select(key, *words).groupBy(key).agg(F.count("*").alias("_n"), *[F.sum(f"_w{i}").alias(f"_s{i}") for i in range(4)])
    return sums.select(key, F.concat_ws("-", "_n", *[F.col(f"_s{i}").cast("string") for i in range(4)]).alias("fingerprint"))


def stale_bidders(fingerprints: DataFrame, index_meta: DataFrame, embed_model: str,
                  key: str = "bidder_id") -> DataFrame:
    """Bidders whose index is missing, outdated, or made by another model."""
    current = index_meta.where(F.col("embed_model") == embed_model).select(key, "fingerprint")
    return fingerprints.join(current, [key, "fingerprint"], "left_anti")


def index_rows(documents: DataFrame, chunks: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Rows to embed: chunk texts, and a summary per document where given.

    ``documents`` has bidder_id, doc_pos, filename, min_ocr_confidence; chunks
    and summaries refer to (bidder_id, doc_pos).
    """
    base = documents.select("bidder_id", "doc_pos", F.col("filename").alias("source_document"),
                            F.col("min_ocr_confidence").try_cast("double").alias("ocr_confidence"))
    head = F.concat(F.lit("b"), F.col("bidder_id").cast("string"), F.lit("_d"), F.col("doc_pos").cast("string"))
    rows = base.join(chunks.select("bidder_id", "doc_pos", "chunk_index", "text"), ["bidder_id", "doc_pos"]).select(
        F.concat(head, F.lit("_c"), F.col("chunk_index").cast("string")).alias("id"), "bidder_id",
        F.lit("chunk").alias("kind"), "source_document", "chunk_index", F.col("text").alias("document"),
        "ocr_confidence")
    if summaries is None:
        return rows
    told = base.join(summaries.select("bidder_id", "doc_pos", "summary"), ["bidder_id", "doc_pos"])
    return rows.unionByName(told.where(F.length(F.trim("summary")) > 0).select(
        F.concat(head, F.lit("_summary")).alias("id"), "bidder_id", F.lit("doc_summary").alias("kind"),
        "source_document", F.lit(-1).alias("chunk_index"), F.col("summary").alias("document"), "ocr_confidence"))


def complete_indexes(embedded: DataFrame) -> DataFrame:
    """Leave out every bidder for whom some embedding failed."""
    failed = embedded.where(F.col("embedding").isNull()).select("bidder_id").distinct()
    return embedded.join(failed, "bidder_id", "left_anti")


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("bidder_id"), F.lit(buckets)).cast("int"))


def write_index(rows: DataFrame, path: str, old: DataFrame | None = None, buckets: int = 64, salt: int = 4) -> None:
    """Write the rows of their bidders into the buckets these fall into.

    A bucket holds the bidders of one hash value; ``salt`` files at most are
    written for it by as many tasks.  ``old`` is the index so far
    (``read_index``): the other bidders of the buckets touched are written again,
    so that a bidder's rows are replaced whole.  The new state is stored before
    buckets are overwritten.
    """
    new = _bucketed(rows, buckets)
    if old is not None:
        touched = new.select("bucket").distinct()
        others = _bucketed(old, buckets).join(touched, "bucket", "left_semi").join(rows.select("bidder_id").distinct(), "bidder_id", "left_anti")
        new = new.unionByName(others.select(*new.columns))
    _overwrite(cut(new), path, buckets, salt)


def _overwrite(stored: DataFrame, path: str, buckets: int, salt: int) -> None:
    # a fixed number of tasks: buckets * salt folders' files whatever the number of bidders
    dealt = stored.repartition(buckets * salt, F.col("bucket"), F.pmod(F.xxhash64(*[c for c in stored.columns if c != "embedding"]), F.lit(salt)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the index; the blank rows of emptied buckets are left out."""
    return spark.read.parquet(path).where(F.col("bidder_id").isNotNull()).drop("bucket")


def delete_index(spark: SparkSession, path: str, bidders: DataFrame, buckets: int = 64, salt: int = 4) -> None:
    """Take the bidders (bidder_id) out of the index: their buckets are written anew without them.

    A bucket that keeps no other bidder gets a blank row, which ``read_index``
    leaves out; no folder is deleted from the driver.
    """
    gone = _bucketed(bidders.select("bidder_id").distinct(), buckets)
    held = spark.read.parquet(path).join(gone.select("bucket").distinct(), "bucket", "left_semi")
    left = held.join(gone.select("bidder_id"), "bidder_id", "left_anti")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema if f.name != "bucket"]
    empty = gone.select("bucket").distinct().join(left.select("bucket").distinct(), "bucket", "left_anti").select("bucket", *blank)
    _overwrite(cut(left.select(*held.columns).unionByName(empty.select(*held.columns))), path, buckets, salt)


def retrieve(fused: DataFrame, keyword: DataFrame, indexed: DataFrame, key: str = "bidder_id") -> DataFrame:
    """Fused hits of bidders that have an index, keyword hits of the others."""
    have = indexed.select(key).distinct()
    columns = [c for c in fused.columns if c in keyword.columns]
    return fused.join(have, key, "left_semi").select(*columns).unionByName(
        keyword.join(have, key, "left_anti").select(*columns))
