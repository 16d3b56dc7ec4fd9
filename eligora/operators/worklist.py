"""Which (bidder, criterion) pairs there are, and which are still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def work_list(bidders: DataFrame, criteria: DataFrame) -> DataFrame:
    """Every criterion of a tender for every bidder of that tender.

    An equi-join on the tender, so it is planned by measured size: a hash join
    without shuffle while criteria are small, a skew-split sort-merge join
    beyond that.
    """
    b = bidders.select("tender_id", F.col("id").alias("bidder_id"), F.col("name").alias("bidder_name"))
    c = criteria.select("tender_id", F.col("id").alias("criterion_id"), "crit_code", "mandatory")
    return b.join(c, "tender_id").select(
        "tender_id", "bidder_id", "bidder_name", "criterion_id", "crit_code", "mandatory")


def pending_pairs(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs without a verdict yet, by id (equal names stay apart)."""
    return pairs.join(verdicts.select("bidder_id", "criterion_id").distinct(),
                      ["bidder_id", "criterion_id"], "left_anti")


def remaining_by_tender(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per tender: all pairs, those evaluated, those left, per cent done."""
    done = verdicts.select("bidder_id", "criterion_id").distinct().withColumn("done", F.lit(1))
    counts = (pairs.join(done, ["bidder_id", "criterion_id"], "left").groupBy("tender_id")
              .agg(F.count("*").alias("total_pairs"), F.count("done").alias("evaluated")))
    return counts.select("tender_id", "total_pairs", "evaluated",
                         (F.col("total_pairs") - F.col("evaluated")).alias("remaining"))


def progress(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Share of finished pairs in whole per cent, 99 at most while running."""
    done = remaining_by_tender(pairs, verdicts)
    percent = F.floor(F.col("evaluated") * 100 / F.greatest(F.col("total_pairs"), F.lit(1)))
    return done.withColumn("percent", F.least(percent, F.lit(99)).cast("bigint"))


def valid_bidders(bidders: DataFrame, documents: DataFrame) -> DataFrame:
    """Bidders with a name and at least one document."""
    named = bidders.where(F.trim(F.coalesce("name", F.lit(""))) != "")
    return named.join(documents.select(F.col("bidder_id").alias("id")), "id", "left_semi")
