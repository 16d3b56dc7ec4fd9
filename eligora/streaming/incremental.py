"""Assessment that resumes: newly landed files are picked up where it stopped.

The file stream remembers which files it has seen in its checkpoint; each
micro-batch is the ordinary batch plan over the new files, and pairs that have
a verdict already are left out by the same anti-join as in batch mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from eligora.operators.worklist import pending_pairs
from eligora.sources.files import assemble, describe_files, with_pages

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def landed_documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of documents from a landing folder tender/bidder/file."""
    raw = (spark.readStream.format("binaryFile").schema(BINARY_FILE)
           .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path))
    return assemble(with_pages(describe_files(raw)))


def assess_landed(documents: DataFrame, pairs: Callable[[DataFrame], DataFrame],
                  verdicts_so_far: Callable[[], DataFrame], assess: Callable[[DataFrame, DataFrame], DataFrame],
                  store: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Assess all files that have landed, then stop.

    Per micro-batch: ``pairs(new documents)`` is the work list, pairs with a
    verdict are dropped, ``assess(pending, documents)`` gives verdict rows and
    ``store(rows, batch_id)`` writes them; a repeated batch id must replace.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        pending = pending_pairs(pairs(batch), verdicts_so_far())
        store(assess(pending, batch), batch_id)
    return (documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
