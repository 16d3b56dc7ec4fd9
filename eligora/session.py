"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins from measured sizes, splits skewed partitions and merges
# small ones; nothing below depends on the number of cores or of rows.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "eligora", extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; a temporary one only in local mode."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = os.path.join(tempfile.mkdtemp(prefix="eligora-"), "checkpoints")
    spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result outlives executors and has no lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame) -> DataFrame:
    """Keep a derived table (spilling to disk) and measure it.

    For the side of a join that is usually small, such as criteria: Spark then
    plans with its exact size, a broadcast below its threshold and a shuffled,
    skew-split join beyond it, instead of shuffling the big side on a guess.
    Lost blocks are computed again from lineage.
    """
    kept = df.persist()
    kept.count()
    return kept


def spread(scan: DataFrame, *keys: str, shares: int | None = None) -> DataFrame:
    """Share out a scan that comes in far fewer pieces than there are cores.

    For work that is heavy per row.  A table of ordinary size passes unchanged;
    only a small or unsplittable file (one row group) is hashed by ``keys``.
    ``scan`` must be a plain scan, so that counting its pieces runs nothing.

    A piece of narrow rows holds millions of them.  With ``shares`` each piece is cut
    into that many, whatever the size of the table, so that a task stays the same
    when the table grows.
    """
    cores, pieces = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    if shares:
        return scan.repartition(max(cores, pieces * shares), *keys)
    return scan.repartition(cores, *keys) if pieces * 2 <= cores else scan
