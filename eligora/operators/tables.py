"""Relational operations on the workspace tables, as pure plans.

Updates are expressed as "latest row wins" over append-only logs, deletes as
anti-joins, so every statement is a plan that can be re-run after a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligora import constants as K

PAIR = ["bidder_id", "criterion_id"]


def row_id(*parts: Column | str) -> Column:
    """Surrogate key from the natural key: stable when a job is retried."""
    return F.xxhash64(*parts)


def latest(log: DataFrame, keys: list[str], seq: str, values: list[str], stable: list[str] = ()) -> DataFrame:
    """Upsert: newest ``values`` per key, ``stable`` columns from the first row.

    ``seq`` must be unique within a key.  One aggregation with partial states.
    """
    return log.groupBy(*keys).agg(*[F.max_by(v, seq).alias(v) for v in values],
                                  *[F.min_by(s, seq).alias(s) for s in stable])


def current_verdicts(log: DataFrame) -> DataFrame:
    """Verdict table from its log: an update keeps id and creation time."""
    return latest(log, PAIR, "seq", ["verdict", "explanation", "confidence"], ["id", "created_at"])


def apply_overrides(verdicts: DataFrame, overrides: DataFrame, order: list[str]) -> DataFrame:
    """Verdicts with the last accepted override of each put in place.

    Accepted are those with a reason; the rows changed are marked.
    """
    valid = overrides.where(F.trim(F.coalesce("reason", F.lit(""))) != "")
    last = valid.groupBy("verdict_id").agg(F.max(F.struct(*order, "new_verdict")).alias("_o"))
    joined = verdicts.join(last.select(F.col("verdict_id").alias("id"), F.col("_o.new_verdict").alias("_new")),
                           "id", "left")
    return joined.withColumns({"overridden": F.col("_new").isNotNull(),
                               "verdict": F.coalesce("_new", "verdict")}).drop("_new")


def resolved_verdicts(log: DataFrame, overrides: DataFrame) -> DataFrame:
    """Verdict table from the logs of saves and overrides: whichever came last decides.

    Both logs have ``seq``; an override counts only against saves before it, so a
    later evaluation replaces it.  Only overrides with a reason are accepted.
    """
    current = log.groupBy(*PAIR).agg(
        *[F.max_by(v, "seq").alias(v) for v in ("verdict", "explanation", "confidence")],
        *[F.min_by(s, "seq").alias(s) for s in ("id", "created_at")], F.max("seq").alias("_at"))
    valid = overrides.where(F.trim(F.coalesce("reason", F.lit(""))) != "")
    last = valid.groupBy(F.col("verdict_id").alias("id")).agg(F.max(F.struct("seq", "created_at", "new_verdict")).alias("_o"))
    wins = F.coalesce(F.col("_o.seq") > F.col("_at"), F.lit(False))
    return current.join(last, "id", "left").withColumns({
        "overridden": wins, "verdict": F.when(wins, F.col("_o.new_verdict")).otherwise(F.col("verdict"))}).drop("_at", "_o")


def latest_rows(log: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key; the creation time is that of the first one."""
    rest = [c for c in log.columns if c not in (*keys, "created_at")]
    newest = log.groupBy(*keys).agg(F.max(F.struct("seq", *[c for c in rest if c != "seq"])).alias("_n"), F.min("created_at").alias("created_at"))
    return newest.select(*keys, "_n.*", "created_at").select(*log.columns)


def since_deletion(log: DataFrame, tender: str, deleted: DataFrame) -> DataFrame:
    """Rows saved after their tender was last deleted (or whose tender never was)."""
    last = deleted.groupBy(F.col("tender_id").alias("_gone")).agg(F.max("seq").alias("_gone_at"))
    kept = log.join(last, F.col(tender) == F.col("_gone"), "left").where(F.col("_gone_at").isNull() | (F.col("seq") > F.col("_gone_at")))
    return kept.drop("_gone", "_gone_at")


def override_candidates(verdicts: DataFrame) -> DataFrame:
    """Only verdicts under review are offered for an override."""
    return verdicts.where(F.col("verdict") == K.NEEDS_REVIEW)


def merge_criteria(existing: DataFrame, new: DataFrame, evidence: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Save an edited criteria list over the stored one.

    Per tender in ``new``: known codes are updated (last one of the list wins;
    id, confirmation and creation time stay), unknown codes are inserted, codes
    no longer listed go unless evidence or a verdict refers to them.  ``new``
    has tender_id, crit_code, ord and the editable fields.
    """
    key = ["tender_id", "crit_code"]
    fields = ["description", "category", "mandatory", "threshold", "expected_evidence", "source_section"]
    defaults = {"mandatory": F.lit(True)}
    new = new.withColumns({f: F.coalesce(F.col(f), defaults.get(f, F.lit(""))) for f in fields})
    kept = ["id", "confirmed", "created_at"]
    last = new.groupBy(*key).agg(F.max_by(F.struct(*fields), "ord").alias("_n"))
    touched = new.select("tender_id").distinct().withColumn("_touched", F.lit(True))
    used = evidence.select("criterion_id").unionByName(verdicts.select("criterion_id")).distinct()
    used = used.select(F.col("criterion_id").alias("id"), F.lit(True).alias("_used"))
    old = existing.join(last, key, "left").join(touched, "tender_id", "left").join(used, "id", "left")
    stays = F.col("_n").isNotNull() | F.col("_touched").isNull() | F.col("_used").isNotNull()
    updated = old.where(stays).select(
        *key, *kept, *[F.when(F.col("_n").isNotNull(), F.col(f"_n.{f}")).otherwise(F.col(f)).alias(f) for f in fields])
    added = new.join(existing.select(*key), key, "left_anti").select(
        *key, row_id(*key, "ord").alias("id"), F.lit(False).alias("confirmed"),
        F.lit(None).cast("timestamp").alias("created_at"), *fields)
    return updated.unionByName(added)


def confirm_criteria(criteria: DataFrame, tenders: DataFrame) -> DataFrame:
    """Mark all criteria of the given tenders as confirmed."""
    hit = tenders.select("tender_id").distinct().withColumn("_hit", F.lit(True))
    joined = criteria.join(hit, "tender_id", "left")
    return joined.withColumn("confirmed", F.col("confirmed") | F.col("_hit").isNotNull()).drop("_hit")


def all_confirmed(criteria: DataFrame) -> DataFrame:
    return criteria.groupBy("tender_id").agg(F.bool_and("confirmed").alias("all_confirmed"))


def cascade_delete(tables: dict[str, DataFrame], tenders: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given tenders and whatever hangs on them."""
    gone = tenders.select("tender_id").distinct()
    bidders = tables["bidders"].join(gone, "tender_id", "left_semi").select(F.col("id").alias("bidder_id"))
    verdicts = tables["verdicts"].join(bidders, "bidder_id", "left_semi").select(F.col("id").alias("verdict_id"))
    out = dict(tables)
    for name in ("criteria", "bidders", "audit_log", "documents"):
        if name in out:
            out[name] = out[name].join(gone, "tender_id", "left_anti")
    if "tenders" in out:
        out["tenders"] = out["tenders"].join(gone.withColumnRenamed("tender_id", "id"), "id", "left_anti")
    for name in ("documents", "evidence", "verdicts", "vectors"):
        if name in out:
            out[name] = out[name].join(bidders, "bidder_id", "left_anti")
    if "officer_overrides" in out:
        out["officer_overrides"] = out["officer_overrides"].join(verdicts, "verdict_id", "left_anti")
    return out


def verdicts_joined(verdicts: DataFrame, bidders: DataFrame, criteria: DataFrame) -> DataFrame:
    """Verdicts with bidder name and criterion text.  ``mandatory`` is included
    so that optional criteria can be told apart in the rollup."""
    b = bidders.select(F.col("id").alias("bidder_id"), F.col("name").alias("bidder_name"), "tender_id")
    c = criteria.select(F.col("id").alias("criterion_id"), "crit_code",
                        F.col("description").alias("crit_desc"), "category", "mandatory")
    return verdicts.join(b, "bidder_id").join(c, "criterion_id")


def overrides_joined(overrides: DataFrame, verdicts: DataFrame, bidders: DataFrame, criteria: DataFrame) -> DataFrame:
    v = verdicts.select(F.col("id").alias("verdict_id"), "bidder_id", "criterion_id")
    named = verdicts_joined(overrides.join(v, "verdict_id"), bidders, criteria)
    return named.drop("category", "mandatory")


def audit(tender_id: Column, action: str, details: Column) -> list[Column]:
    if action not in K.AUDIT_ACTIONS:
        raise ValueError(f"unknown audit action {action!r}")
    return [tender_id.alias("tender_id"), F.lit(action).alias("action"), details.alias("details")]
