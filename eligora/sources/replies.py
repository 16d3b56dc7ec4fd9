"""Model calls of which equal ones are made once, and replies that outlive a job.

A request is named by the digest of everything the reply depends on: model, system
text, form, length bound and prompt.  Rows with one digest share one call, and a
``ReplyStore`` answers digests of earlier jobs, so a repeated or resumed assessment
asks only for what is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.session import cut
from eligora.sources.models import ClientFactory, ask

STORE_SCHEMA = "digest string, reply string"


def request_digest(prompt: str, model: str, system: str, json_mode: bool, max_tokens: int) -> Column:
    head = "\x1f".join([model, system, str(json_mode), str(max_tokens), ""])
    return F.sha2(F.concat(F.lit(head), F.coalesce(prompt, F.lit(""))), 256)


class ReplyStore:
    """Append-only table digest -> reply in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self) -> None:
        self.spark.createDataFrame([], STORE_SCHEMA).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        """One reply per digest; of two jobs that asked at the same time the smaller text."""
        stored = self.spark.read.schema(STORE_SCHEMA).parquet(self.path)
        return stored.groupBy("digest").agg(F.min("reply").alias("reply"))

    def add(self, answered: DataFrame) -> None:
        answered.select("digest", "reply").write.mode("append").parquet(self.path)


def ask_once(df: DataFrame, prompt: str, client: ClientFactory, system: str = "", json_mode: bool = True,
             max_tokens: int = K.MODEL_TOKENS, retries: int = K.MODEL_RETRIES, wait: float = K.MODEL_RETRY_SECONDS,
             at_once: int | None = None, store: ReplyStore | None = None, model: str = "") -> DataFrame:
    """``ask`` with one call per distinct request; all rows of ``df`` come back, with ``reply`` and ``error``.

    At most ``at_once`` calls are in flight, whatever the number of workers: distinct
    requests are dealt into that many tasks.  ``store`` is asked first and keeps what
    is new under ``model``; failed calls are not kept, so the next job tries them
    again.  A prompt that a third of all rows share is reduced to one row before the
    shuffle.  Replies are checkpointed, so a lost executor does not repeat calls.
    """
    keyed = cut(df.withColumn("_digest", request_digest(prompt, model, system, json_mode, max_tokens)))
    # the prompt is a key, not a state: states that are texts make the aggregation sort
    requests = keyed.select("_digest", F.coalesce(F.col(prompt), F.lit("")).alias("_request")).distinct()
    told = None
    if store is not None:
        held = store.rows().withColumnRenamed("digest", "_digest")
        told = cut(held.join(requests.select("_digest"), "_digest", "left_semi"))
        requests = requests.join(told, "_digest", "left_anti")
    if at_once:
        requests = requests.repartition(at_once, "_digest")
    asked = cut(ask(requests, "_request", client, system, json_mode, max_tokens, retries, wait).drop("_request"))
    if store is not None:
        store.add(asked.where("error is null").withColumnRenamed("_digest", "digest"))
        asked = asked.unionByName(told.withColumn("error", F.lit(None).cast("string")))
    return keyed.join(asked, "_digest").drop("_digest")


def available(spark: SparkSession, client: ClientFactory) -> bool:
    """Whether a worker reaches the model: it can be made, and says so if it has ``available()``."""
    def probe(batches):
        for rows in batches:
            try:
                made = client()
                check = getattr(made, "available", None)
                yield rows.assign(ok=bool(check()) if check else True)[["ok"]]
            except Exception:
                yield rows.assign(ok=False)[["ok"]]
    return spark.range(0, 1, 1, 1).mapInPandas(probe, "ok boolean").first()["ok"]
