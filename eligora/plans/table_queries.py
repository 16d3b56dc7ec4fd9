"""Workspace tables: upserts, merges, overrides, deletes, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.operators import extraction as EX
from eligora.operators import tables as T
from eligora.operators import vectors as V
from eligora.operators import worklist as W
from eligora.plans import domain as D
from eligora.sources.models import evidence_summary as evidence_texts

_VERDICT = {"click": K.ELIGIBLE, "view": K.NEEDS_REVIEW, "error": K.NEEDS_REVIEW, "signup": K.NOT_ELIGIBLE,
            "purchase": K.ELIGIBLE}
_ACTION = {"click": "bidder_evaluated", "view": "bidder_added", "error": "criteria_saved",
           "signup": "officer_override", "purchase": "tender_uploaded"}


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a verdict log: users are bidders, props name the criterion."""
    criterion = F.pmod(F.get_json_object("props", "$.k").cast("bigint"), F.lit(7)) + 1
    kind = D.X.lookup(F.col("event_type"), _VERDICT)
    return D.table(spark, sf, "events").select(
        F.col("user_id").alias("bidder_id"), criterion.alias("criterion_id"), F.col("event_id").alias("seq"),
        F.col("event_id").alias("id"), kind.alias("verdict"), F.col("props").alias("explanation"),
        F.col("value").alias("confidence"), F.col("ts").alias("created_at"))


def _overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-up events override the verdict of their own pair."""
    current = T.current_verdicts(_log(spark, sf)).select("bidder_id", "criterion_id", F.col("id").alias("verdict_id"),
                                                         F.col("verdict").alias("original_verdict"))
    criterion = F.pmod(F.get_json_object("props", "$.k").cast("bigint"), F.lit(7)) + 1
    rows = D.table(spark, sf, "events").where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("bidder_id"), criterion.alias("criterion_id"),
        F.when(F.col("value") > 10, K.ELIGIBLE).otherwise(K.NOT_ELIGIBLE).alias("new_verdict"),
        F.when(F.col("event_id") % 4 == 0, " ").otherwise("checked").alias("reason"), F.col("ts").alias("created_at"))
    return rows.join(current, ["bidder_id", "criterion_id"]).drop("bidder_id", "criterion_id")


def verdict_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return T.current_verdicts(_log(spark, sf))


def overrides_applied(spark: SparkSession, sf: str) -> DataFrame:
    out = T.apply_overrides(T.current_verdicts(_log(spark, sf)), _overrides(spark, sf), ["created_at", "id"])
    return out.select("id", "bidder_id", "criterion_id", "verdict", "overridden")


def override_then_update(spark: SparkSession, sf: str) -> DataFrame:
    """Saves and officer overrides (sign-up events) in one order of time: the last one decides."""
    log = _log(spark, sf)
    saves = log.join(_signups(spark, sf).select("seq"), "seq", "left_anti")
    ids = saves.groupBy(*T.PAIR).agg(F.min_by("id", "seq").alias("verdict_id"))
    overrides = _signups(spark, sf).join(ids, T.PAIR)
    return T.resolved_verdicts(saves, overrides).select("id", *T.PAIR, "verdict", "overridden")


def _signups(spark: SparkSession, sf: str) -> DataFrame:
    criterion = F.pmod(F.get_json_object("props", "$.k").cast("bigint"), F.lit(7)) + 1
    return D.table(spark, sf, "events").where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("bidder_id"), criterion.alias("criterion_id"),
        F.when(F.col("value") > 10, K.ELIGIBLE).otherwise(K.NOT_ELIGIBLE).alias("new_verdict"),
        F.when(F.col("event_id") % 4 == 0, " ").otherwise("checked").alias("reason"), F.col("ts").alias("created_at"))


def wipe_then_reload(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts saved after the user's last error event, which stands for a deletion of the tender."""
    log = _log(spark, sf).withColumn("tender_id", F.col("bidder_id"))
    errors = D.table(spark, sf, "events").where(F.col("event_type") == "error").select(
        F.col("user_id").alias("tender_id"), F.col("event_id").alias("seq"))
    kept = T.latest_rows(T.since_deletion(log, "tender_id", errors).drop("id", "tender_id", "explanation"), T.PAIR)
    return kept.select(*T.PAIR, "seq", "verdict", "created_at")


def repeated_save(spark: SparkSession, sf: str) -> DataFrame:
    """Every save done twice gives the same rows as once."""
    log = _log(spark, sf).drop("id", "explanation")
    return T.latest_rows(log.unionByName(log), T.PAIR).select(*T.PAIR, "seq", "verdict", "created_at")


def override_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return T.override_candidates(T.current_verdicts(_log(spark, sf))).select("id", "bidder_id", "criterion_id")


def verdicts_joined(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.verdicts_joined(T.current_verdicts(_log(spark, sf)), D.bidders(spark, sf), D.rules(spark))
    return rows.select("id", "bidder_id", "bidder_name", "tender_id", "criterion_id", "crit_code", "crit_desc",
                       "category", "mandatory", "verdict")


def overrides_joined(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.overrides_joined(_overrides(spark, sf), T.current_verdicts(_log(spark, sf)), D.bidders(spark, sf),
                              D.rules(spark))
    return rows.select("id", "verdict_id", "bidder_name", "crit_code", "crit_desc", "original_verdict", "new_verdict",
                       "reason", "created_at")


def _part_criteria(spark: SparkSession, sf: str) -> DataFrame:
    tender = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("bigint")
    return D.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), tender.alias("tender_id"),
        F.concat(F.lit("C-"), F.col("p_partkey").cast("string")).alias("crit_code"),
        F.col("p_name").alias("description"), F.col("p_type").alias("category"), (F.col("p_size") % 2 == 0).alias("mandatory"),
        F.col("p_size").cast("string").alias("threshold"), F.lit("").alias("expected_evidence"),
        F.lit("").alias("source_section"), (F.col("p_retailprice") > 1500).alias("confirmed"),
        F.lit(None).cast("timestamp").alias("created_at"), "p_size")


def criteria_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Parts up to size 35 are stored, an edited list of sizes 15 up is saved."""
    parts = _part_criteria(spark, sf)
    existing = parts.where(F.col("p_size") <= 35).drop("p_size")
    new = parts.where(F.col("p_size") >= 15).select(
        "tender_id", "crit_code", F.col("id").alias("ord"), F.upper("description").alias("description"),
        F.lit(None).cast("string").alias("category"), "mandatory", "threshold", "expected_evidence", "source_section")
    lineitem = D.table(spark, sf, "lineitem")
    # line items of other quantities refer to criteria outside the list (negative ids)
    refers = lambda quantity: F.when(F.col("l_quantity") == quantity, F.col("l_partkey")).otherwise(-F.col("l_partkey"))
    evidence = lineitem.select(refers(50).alias("criterion_id"))
    verdicts = lineitem.select(refers(49).alias("criterion_id"))
    merged = T.merge_criteria(existing, new, evidence, verdicts)
    return merged.select("tender_id", "crit_code", "description", "category", "mandatory", "threshold", "confirmed")


def criteria_confirm(spark: SparkSession, sf: str) -> DataFrame:
    """Confirm the tenders that have a part over 1,900; then all-confirmed."""
    criteria = _part_criteria(spark, sf).drop("p_size")
    dear = D.table(spark, sf, "part").where(F.col("p_retailprice") > 1900).select(
        F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("bigint").alias("tender_id"))
    return T.all_confirmed(T.confirm_criteria(criteria, dear))


def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left per table once the tenders of three regions are deleted."""
    current = T.current_verdicts(_log(spark, sf))
    everything = {
        "tenders": D.tenders(spark, sf), "bidders": D.bidders(spark, sf), "criteria": D.criteria(spark, sf),
        "evidence": D.evidence(spark, sf), "verdicts": current, "officer_overrides": _overrides(spark, sf),
        "documents": D.files(spark, sf).select("doc_id", "bidder_id", "tender_id"),
        "audit_log": _audit(spark, sf)}
    gone = D.tenders(spark, sf).where(F.col("name").startswith("A")).select(F.col("id").alias("tender_id"))
    left = T.cascade_delete(everything, gone)
    counts = [df.agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left")
              for name, df in left.items()]
    return reduce(DataFrame.unionByName, counts)


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    events = D.table(spark, sf, "events")
    return events.select(F.pmod("user_id", F.lit(5)).alias("tender_id"),
                         D.X.lookup(F.col("event_type"), _ACTION).alias("action"),
                         F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("details"),
                         F.col("ts").alias("created_at"))


def audit_by_action(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).groupBy("tender_id", "action").agg(
        F.count("*").alias("entries"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def audit_trail(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows of every tender in time order."""
    return _audit(spark, sf).orderBy("tender_id", "created_at")


def evidence_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of the bidders of one tender, a semi-join on their ids."""
    tender = D.tenders(spark, sf).where(F.col("name") == "ASIA").select(F.col("id").alias("tender_id"))
    wanted = D.bidders(spark, sf).join(tender, "tender_id").select(F.col("id").alias("bidder_id"))
    return D.evidence(spark, sf).join(wanted, "bidder_id", "left_semi").groupBy("bidder_id", "criterion_id").agg(
        F.count("*").alias("rows"), F.round(F.sum("value"), 2).alias("total"))


def bidder_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts with criterion texts, in criterion order per bidder."""
    c = D.rules(spark).select(F.col("id").alias("criterion_id"), "crit_code", F.col("description").alias("crit_desc"),
                              "category")
    return T.current_verdicts(_log(spark, sf)).join(c, "criterion_id").select(
        "id", "bidder_id", "criterion_id", "crit_code", "crit_desc", "category", "verdict")


def valid_bidders(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with a document."""
    return W.valid_bidders(D.bidders(spark, sf), D.files(spark, sf).select("bidder_id"))


def evidence_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Lowest word confidence of the document each evidence row names."""
    words = F.pmod("o_custkey", F.lit(100)).cast("double")
    orders = D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("source_document"), F.when(words > 10, words).alias("ocr_confidence"))
    rows = EX.with_document_confidence(D.evidence(spark, sf).drop("value"), orders, ["source_document"])
    return rows.groupBy("bidder_id", "criterion_id").agg(
        F.count("*").alias("rows"), F.count("ocr_confidence").alias("known"), F.min("ocr_confidence").alias("lowest"))


def evidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence texts of each order, as they are put before a judge."""
    rows = D.table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("ordinal"), F.lit("order").alias("source_document"),
        F.col("l_partkey").cast("string").alias("extracted_value"), F.lit(None).cast("string").alias("source_text"),
        F.lit("").alias("notes"))
    told = evidence_texts(rows, ["l_orderkey"])
    return told.select("l_orderkey", F.md5("evidence").alias("evidence_md5"), F.length("evidence").alias("chars"))


def stale_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """Bidders whose index must be rebuilt: the stored fingerprints cover the
    files as they were before the longest ones came in."""
    def prints(docs: DataFrame) -> DataFrame:
        bidder = F.substring("source", 4, 9).cast("bigint")
        return V.corpus_fingerprint(docs.select(
            bidder.alias("bidder_id"), F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("filename"),
            F.col("text").alias("full_text"), F.sha2("text", 256).alias("file_hash")))
    docs = D.table(spark, sf, "documents")
    stored = prints(docs.where(F.col("n_chars") < 20000)).withColumn(
        "embed_model", F.when(F.col("bidder_id") % 7 == 0, "old").otherwise("current"))
    return V.stale_bidders(prints(docs), stored, "current").select("bidder_id")


_EVENT = """SELECT user_id AS bidder_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 + 1 AS criterion_id,
 event_id, event_type, props, value, ts, """
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _VERDICT.items()) + " END"
_ACT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ACTION.items()) + " END"
_CURRENT = f"""log AS ({_EVENT} {_CASE} AS verdict FROM events),
cur AS (SELECT bidder_id, criterion_id, arg_max(verdict, event_id) AS verdict, arg_max(props, event_id) AS explanation,
  arg_max(value, event_id) AS confidence, min(event_id) AS id, arg_min(ts, event_id) AS created_at FROM log GROUP BY ALL),
ov AS (SELECT l.event_id AS id, c.id AS verdict_id, c.bidder_id, c.criterion_id, c.verdict AS original_verdict,
  CASE WHEN l.value > 10 THEN 'ELIGIBLE' ELSE 'NOT_ELIGIBLE' END AS new_verdict,
  CASE WHEN l.event_id % 4 = 0 THEN ' ' ELSE 'checked' END AS reason, l.ts AS created_at
  FROM log l JOIN cur c USING (bidder_id, criterion_id) WHERE l.event_type = 'signup'),
crit(criterion_id, crit_code, crit_desc, category, mandatory) AS (VALUES """ + ",".join(
    f"({p}::BIGINT,'C-{p:03d}','{d}','{c}',{m})" for p, d, c, m, t, e in D.RULES) + ")"
_PART = """SELECT p_partkey AS id, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS tender_id,
  'C-' || p_partkey AS crit_code, p_name AS description, p_type AS category, p_size % 2 = 0 AS mandatory,
  p_size::VARCHAR AS threshold, p_retailprice > 1500 AS confirmed, p_size, p_retailprice FROM part"""

QUERIES = {
    "verdict_upsert_latest": (verdict_upsert_latest, f"WITH {_CURRENT} SELECT * FROM cur"),
    "overrides_applied": (overrides_applied, f"""WITH {_CURRENT}, last AS (SELECT verdict_id,
      arg_max(new_verdict, (created_at, id)) AS v FROM ov WHERE trim(reason) <> '' GROUP BY verdict_id)
      SELECT cur.id, bidder_id, criterion_id, coalesce(v, verdict) AS verdict, v IS NOT NULL AS overridden
      FROM cur LEFT JOIN last ON verdict_id = cur.id"""),
    "override_then_update": (override_then_update, f"""WITH {_CURRENT}, s AS (SELECT bidder_id, criterion_id,
      arg_max(verdict, event_id) AS verdict, min(event_id) AS id, max(event_id) AS at FROM log WHERE event_type <> 'signup' GROUP BY ALL),
      o AS (SELECT bidder_id, criterion_id, max(event_id) AS seq,
        arg_max(CASE WHEN value > 10 THEN 'ELIGIBLE' ELSE 'NOT_ELIGIBLE' END, event_id) AS v
        FROM log WHERE event_type = 'signup' AND event_id % 4 <> 0 GROUP BY ALL)
      SELECT s.id, s.bidder_id, s.criterion_id, CASE WHEN o.seq > s.at THEN o.v ELSE s.verdict END AS verdict,
        coalesce(o.seq > s.at, FALSE) AS overridden FROM s LEFT JOIN o USING (bidder_id, criterion_id)"""),
    "wipe_then_reload": (wipe_then_reload, f"""WITH {_CURRENT}, e AS (SELECT user_id, max(event_id) AS deleted FROM events
        WHERE event_type = 'error' GROUP BY user_id),
      k AS (SELECT log.* FROM log LEFT JOIN e ON user_id = bidder_id WHERE deleted IS NULL OR event_id > deleted)
      SELECT bidder_id, criterion_id, max(event_id) AS seq, arg_max(verdict, event_id) AS verdict, min(ts) AS created_at
      FROM k GROUP BY ALL"""),
    "repeated_save": (repeated_save, f"""WITH {_CURRENT} SELECT bidder_id, criterion_id, max(event_id) AS seq,
      arg_max(verdict, event_id) AS verdict, min(ts) AS created_at FROM log GROUP BY ALL"""),
    "override_candidates": (override_candidates, f"""WITH {_CURRENT} SELECT id, bidder_id, criterion_id FROM cur
      WHERE verdict = 'NEEDS_REVIEW'"""),
    "verdicts_joined": (verdicts_joined, f"""WITH {_CURRENT}, {D.BIDDERS_SQL} SELECT cur.id, bidder_id, name AS bidder_name,
      tender_id, criterion_id, crit_code, crit_desc, category, mandatory, verdict FROM cur
      JOIN bidders b ON b.id = bidder_id JOIN crit USING (criterion_id)"""),
    "overrides_joined": (overrides_joined, f"""WITH {_CURRENT}, {D.BIDDERS_SQL} SELECT ov.id, verdict_id, name AS bidder_name,
      crit_code, crit_desc, original_verdict, new_verdict, reason, ov.created_at FROM ov
      JOIN bidders b ON b.id = bidder_id JOIN crit USING (criterion_id)"""),
    "criteria_merge": (criteria_merge, f"""WITH p AS ({_PART}), used AS (SELECT DISTINCT l_partkey AS id FROM lineitem
        WHERE l_quantity IN (49, 50)), touched AS (SELECT DISTINCT tender_id FROM p WHERE p_size >= 15)
      SELECT tender_id, crit_code, CASE WHEN p_size >= 15 THEN upper(description) ELSE description END AS description,
        CASE WHEN p_size >= 15 THEN '' ELSE category END AS category, mandatory, threshold,
        CASE WHEN p_size > 35 THEN FALSE ELSE confirmed END AS confirmed FROM p
      WHERE p_size >= 15 OR id IN (SELECT id FROM used) OR tender_id NOT IN (SELECT tender_id FROM touched)"""),
    "criteria_confirm": (criteria_confirm, f"""WITH p AS ({_PART}) SELECT tender_id,
      bool_and(confirmed OR tender_id IN (SELECT tender_id FROM p WHERE p_retailprice > 1900)) AS all_confirmed
      FROM p GROUP BY tender_id"""),
    "cascade_delete": (cascade_delete, f"""WITH {_CURRENT}, {D.BIDDERS_SQL}, {D.FILES_SQL},
      gone AS (SELECT r_regionkey::BIGINT AS t FROM region WHERE r_name LIKE 'A%'),
      gb AS (SELECT id FROM bidders WHERE tender_id IN (SELECT t FROM gone))
      SELECT 'tenders' AS table_name, count(*) AS rows_left FROM region WHERE r_name NOT LIKE 'A%'
      UNION ALL SELECT 'bidders', count(*) FROM bidders WHERE id NOT IN (SELECT id FROM gb)
      UNION ALL SELECT 'criteria', count(*) * 7 FROM region WHERE r_name NOT LIKE 'A%'
      UNION ALL SELECT 'evidence', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT id FROM gb)
      UNION ALL SELECT 'verdicts', count(*) FROM cur WHERE bidder_id NOT IN (SELECT id FROM gb)
      UNION ALL SELECT 'officer_overrides', count(*) FROM ov WHERE bidder_id NOT IN (SELECT id FROM gb)
      UNION ALL SELECT 'documents', count(*) FROM files WHERE tender_id NOT IN (SELECT t FROM gone)
        AND bidder_id NOT IN (SELECT id FROM gb)
      UNION ALL SELECT 'audit_log', count(*) FROM events WHERE user_id % 5 NOT IN (SELECT t FROM gone)"""),
    "audit_by_action": (audit_by_action, f"""SELECT user_id % 5 AS tender_id, {_ACT} AS action, count(*) AS entries,
      min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL"""),
    "audit_trail": (audit_trail, f"""SELECT user_id % 5 AS tender_id, {_ACT} AS action, 'User ' || user_id AS details,
      ts AS created_at FROM events"""),
    "evidence_lookup": (evidence_lookup, f"""WITH {D.BIDDERS_SQL} SELECT l_suppkey AS bidder_id,
      l_linenumber::BIGINT AS criterion_id, count(*) AS rows, round(sum(l_extendedprice), 2) AS total FROM lineitem
      WHERE l_suppkey IN (SELECT id FROM bidders JOIN region ON r_regionkey = tender_id WHERE r_name = 'ASIA') GROUP BY ALL"""),
    "bidder_verdicts": (bidder_verdicts, f"""WITH {_CURRENT} SELECT id, bidder_id, criterion_id, crit_code, crit_desc,
      category, verdict FROM cur JOIN crit USING (criterion_id)"""),
    "valid_bidders": (valid_bidders, f"""WITH {D.BIDDERS_SQL} SELECT * FROM bidders WHERE trim(name) <> '' AND id IN
      (SELECT CAST(substr(source, 4) AS BIGINT) FROM documents)"""),
    "evidence_confidence": (evidence_confidence, """SELECT l_suppkey AS bidder_id, l_linenumber::BIGINT AS criterion_id,
      count(*) AS rows, count(c) AS known, min(c)::DOUBLE AS lowest FROM lineitem LEFT JOIN (SELECT o_orderkey,
        o_custkey % 100 AS c FROM orders WHERE o_custkey % 100 > 10) ON o_orderkey = l_orderkey GROUP BY ALL"""),
    "evidence_summary": (evidence_summary, """WITH r AS (SELECT l_orderkey, chr(10) || row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_partkey) || '. in order: ' || l_partkey || chr(10) || '   wording ?'
        || chr(10) || '   remark ' || chr(10) AS t, l_partkey FROM lineitem),
      e AS (SELECT l_orderkey, string_agg(t, '' ORDER BY l_partkey) AS e FROM r GROUP BY l_orderkey)
      SELECT l_orderkey, md5(e) AS evidence_md5, length(e)::INT AS chars FROM e"""),
    "stale_indexes": (stale_indexes, """SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS bidder_id FROM documents d
      WHERE n_chars >= 20000 OR CAST(substr(source, 4) AS BIGINT) % 7 = 0"""),
}
