"""The stored vector index of all bidders: parts of rows that never change, and a manifest.

A refresh writes the rows of stale bidders as one new part and then adds a line per
bidder to the manifest: fingerprint of its files, embedding model, version, part.
The latest line of a bidder decides which part its rows are read from, so a refresh
that ends early leaves rows that nobody sees, and readers never meet half an index.
One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora.operators import retrieval as R
from eligora.operators import vectors as V
from eligora.session import cut
from eligora.sources import models as MO

_MANIFEST = "bidder_id BIGINT, fingerprint STRING, embed_model STRING, version BIGINT, part STRING, n_rows BIGINT"
_ROWS = ("id STRING, bidder_id BIGINT, doc_pos BIGINT, kind STRING, source_document STRING, chunk_index INT, "
         "document STRING, ocr_confidence DOUBLE, embedding ARRAY<FLOAT>, part STRING")


def rows_to_embed(documents: DataFrame, client: MO.ClientFactory | None) -> DataFrame:
    """Chunks of all documents, and with a ``client`` a summary of each; blank texts give none.

    documents: bidder_id, doc_pos, filename, full_text, min_ocr_confidence.  Chunks
    carry what an index row needs, so their texts are not joined to anything.
    """
    head = F.concat(F.lit("b"), F.col("bidder_id").cast("string"), F.lit("_d"), F.col("doc_pos").cast("string"))
    ocr = F.col("min_ocr_confidence").try_cast("double").alias("ocr_confidence")
    chunks = R.chunk_documents(documents, ["bidder_id", "doc_pos", "filename", "min_ocr_confidence"])
    rows = chunks.select(F.concat(head, F.lit("_c"), F.col("chunk_index").cast("string")).alias("id"), "bidder_id", "doc_pos",
                         F.lit("chunk").alias("kind"), F.col("filename").alias("source_document"), "chunk_index", F.col("text").alias("document"), ocr)
    if client is None:
        return rows
    named = documents.select("bidder_id", "doc_pos", "min_ocr_confidence", F.col("filename").alias("_name"),
                             F.coalesce("filename", F.lit("")).alias("filename"), "full_text")
    told = MO.summarise(named, ["bidder_id", "doc_pos", "min_ocr_confidence", "_name"], client)
    return rows.unionByName(told.where(F.length(F.trim("summary")) > 0).select(
        F.concat(head, F.lit("_summary")).alias("id"), "bidder_id", "doc_pos", F.lit("doc_summary").alias("kind"),
        F.col("_name").alias("source_document"), F.lit(-1).alias("chunk_index"), F.col("summary").alias("document"), ocr))


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self) -> None:
        """An empty index where there is none yet."""
        self.spark.createDataFrame([], _MANIFEST).write.mode("ignore").parquet(f"{self.path}/manifest")
        self.spark.createDataFrame([], _ROWS).write.mode("ignore").partitionBy("part").parquet(f"{self.path}/rows")

    def _latest(self) -> DataFrame:
        log = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        last = log.groupBy("bidder_id").agg(F.max(F.struct("version", "part", "fingerprint", "embed_model", "n_rows")).alias("_m"))
        return last.select("bidder_id", "_m.*")

    def manifest(self) -> DataFrame:
        """Bidders that have an index: bidder_id, version, part, fingerprint, embed_model, n_rows."""
        return self._latest().where("part is not null")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows")

    def rows(self, bidders: DataFrame | None = None) -> DataFrame:
        """Current rows, of ``bidders`` (bidder_id) only where given.

        Parts are folders, so that those in which no current row is left are pruned.
        """
        live = self.manifest().select("bidder_id", "part", "version")
        if bidders is not None:
            live = live.join(bidders.select("bidder_id").distinct(), "bidder_id", "left_semi")
        return self._stored().join(live, ["bidder_id", "part"]).drop("part")

    def _next(self) -> tuple[int, str]:
        last = self._latest().agg(F.max("version")).first()[0] or 0
        return last + 1, f"v{last + 1}-{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame, part: str) -> DataFrame:
        columns = [f.split()[0] for f in _ROWS.split(", ")[:-1]]
        rows.select(*columns).write.parquet(f"{self.path}/rows/part={part}")
        return self._stored().where(F.col("part") == part)

    def _commit(self, lines: DataFrame) -> None:
        # the lines are stored first: the manifest is both read and written here
        cut(lines.select(*[f.split()[0] for f in _MANIFEST.split(", ")])).write.mode("append").parquet(f"{self.path}/manifest")

    def refresh(self, documents: DataFrame, client: MO.ClientFactory, embed_model: str, summaries: bool = True) -> int:
        """Bring the index of every bidder in ``documents`` up to date; returns the new version.

        documents: bidder_id, doc_pos, filename, file_hash, full_text,
        min_ocr_confidence, with all files of the bidders named.  Only bidders whose
        files or model changed are chunked, summarised and embedded.  Where an
        embedding fails, or all texts are blank, the bidder has no index: searches
        fall back to keywords, and the next refresh tries again.
        """
        version, part = self._next()
        current = self.manifest()
        stale = cut(V.stale_bidders(V.corpus_fingerprint(documents), current, embed_model))
        docs = documents.join(stale.select("bidder_id"), "bidder_id", "left_semi")
        # dealt out by chunk, since model calls cost far more than moving a chunk
        rows = rows_to_embed(docs, client if summaries else None).repartition("bidder_id", "doc_pos", "chunk_index")
        made = self._write(MO.embed(rows, "document", client), part)
        whole = V.complete_indexes(made).groupBy("bidder_id").agg(F.count("*").alias("n_rows"))
        told = stale.join(whole, "bidder_id").select(
            "bidder_id", "fingerprint", F.lit(embed_model).alias("embed_model"), F.lit(version).cast("bigint").alias("version"),
            F.lit(part).alias("part"), "n_rows")
        lost = stale.join(current.select("bidder_id"), "bidder_id", "left_semi").join(whole, "bidder_id", "left_anti")
        self._commit(told.unionByName(self._gone(lost, version)))
        return version

    @staticmethod
    def _gone(bidders: DataFrame, version: int) -> DataFrame:
        none = F.lit(None).cast("string")
        return bidders.select("bidder_id", none.alias("fingerprint"), none.alias("embed_model"), F.lit(version).cast("bigint").alias("version"),
                              none.alias("part"), F.lit(0).cast("bigint").alias("n_rows"))

    def remove(self, bidders: DataFrame) -> None:
        """Take bidders (bidder_id) out of the index: a line each, no row is rewritten."""
        held = self.manifest().join(bidders.select("bidder_id").distinct(), "bidder_id", "left_semi")
        self._commit(self._gone(held, self._next()[0]))

    def compact(self) -> None:
        """Write all current rows as one part, after many small refreshes; fingerprints stay."""
        version, part = self._next()
        live = self.manifest()
        self._write(self.rows().repartition("bidder_id", "doc_pos"), part)
        self._commit(live.withColumns({"version": F.lit(version).cast("bigint"), "part": F.lit(part)}))
