"""Tables written into the folder that all executors share, to cut lineage where a checkpoint would be larger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from eligora.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as compressed Parquet into the checkpoint folder and read again; it goes when that folder is emptied."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
