"""Operators that ask a model, with a stand-in whose replies follow from the prompt alone.

So prompts, blocks, parsing, errors and defaults are compared with SQL over whole
tables, without a model.
"""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.operators import evaluate as E
from eligora.plans import domain as D
from eligora.plans import money_queries as MQ
from eligora.sources import models as M
from eligora.sources.replies import ask_once


class DigestModel:
    """Replies with the MD5 of the prompt, as a judge with a verdict chosen by its first digit."""

    def chat(self, messages: list[dict], json_mode: bool, max_tokens: int) -> str:
        digest = hashlib.md5(messages[-1]["content"].encode()).hexdigest()
        if not json_mode:
            return digest
        if digest[0] == "0":
            return "no verdict"
        verdict = "ELIGIBLE" if digest[0] < "6" else "NOT_ELIGIBLE" if digest[0] < "b" else "UNSURE"
        return f'{{"verdict": "{verdict}", "explanation": "{digest}"}}'


def document_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of all documents, long ones block by block."""
    files = D.files(spark, sf)
    return M.summarise(files, ["doc_id"], DigestModel)


def label_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A judge's verdicts of all labelled documents: quality is the criterion, toxic the evidence."""
    labels = D.table(spark, sf, "labels")
    pairs = labels.select(F.col("doc_id").alias("bidder_id"), (F.col("quality") + 1).cast("bigint").alias("criterion_id"))
    criteria = D.rules(spark).where("id <= 2").select(F.col("id").alias("criterion_id"), "description", "category", "mandatory", "threshold")
    found = labels.select(
        F.col("doc_id").alias("bidder_id"), (F.col("quality") + 1).cast("bigint").alias("criterion_id"), F.lit(1).cast("bigint").alias("ordinal"),
        F.col("doc_id").cast("string").alias("source_document"), F.when(F.col("toxic") == 1, "toxic").alias("extracted_value"),
        F.lit(None).cast("string").alias("source_text"), F.lit("").alias("notes"), "toxic")
    evidence = found.where((F.col("toxic") == 1) | (F.col("bidder_id") > 100)).drop("toxic")
    return M.qualitative_verdicts(pairs, criteria, evidence, DigestModel).select(*E.PAIR, "verdict", "explanation", "confidence")


PART_CHARS = 500


def evidence_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered evidence texts of all pairs in parts, numbers and lengths running on."""
    items = D.evidence(spark, sf).select(
        *E.PAIR, "ordinal", F.col("source_document").cast("string").alias("source_document"),
        F.round(F.col("value") * 100).cast("bigint").cast("string").alias("extracted_value"),
        F.lit(None).cast("string").alias("source_text"), F.lit(None).cast("string").alias("notes"))
    parts = M.evidence_parts(items, E.PAIR, PART_CHARS)
    return parts.select(*E.PAIR, "part", F.length("evidence").cast("bigint").alias("chars"), F.md5("evidence").alias("evidence_md5"))


class LengthModel:
    """Reads an amount off the length of the prompt; every seventh length has no answer."""

    def chat(self, messages: list[dict], json_mode: bool, max_tokens: int) -> str:
        n = len(messages[-1]["content"])
        if n % 7 == 0:
            return "no amount"
        return f'{{"amount": {n * 1000}, "currency": "{"inr" if n % 2 else "usd"}", "confidence": 0.{3 + n % 7}}}'


def money_routed(spark: SparkSession, sf: str) -> DataFrame:
    """Best amount of every order's text, with a model for unsure ones and each distinct request made once."""
    best = M.money_with_model(MQ.order_texts(spark, sf), "o_orderkey", "t", LengthModel, partial(ask_once, at_once=4))
    return best.select("o_orderkey", F.round("money.amount", 4).alias("amount"), F.col("money.currency").alias("currency"),
                       F.round("money.confidence", 4).alias("confidence"), F.col("money.method").alias("method"))


SHARED_RULE = "Registered office in the region of the works"
BLOCK, OVERLAP = 2000, 200


class ListModel:
    """Two criteria a block: one that all blocks share, with a threshold of any length, and the digest of the prompt."""

    def chat(self, messages: list[dict], json_mode: bool, max_tokens: int) -> str:
        digest = hashlib.md5(messages[-1]["content"].encode()).hexdigest()
        if digest[0] == "0":
            return "no list"
        shared = f'{{"description": "{SHARED_RULE}", "threshold": "{digest[:int(digest[1], 16)]}", "mandatory": {str(digest[2] < "8").lower()}}}'
        return f'{{"criteria": [{shared}, {{"description": "{digest}", "category": "technical"}}]}}'


def criteria_from_model(spark: SparkSession, sf: str) -> DataFrame:
    """Criteria of every document read as a tender, block by block, and a row for each block that failed."""
    tenders = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("full_text"))
    found, failed = M.read_criteria(tenders, ListModel, BLOCK, OVERLAP, partial(ask_once, at_once=4))
    columns = ["tender_id", "crit_code", "description", "category", "mandatory", "threshold", "merged"]
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(columns[1:], ("string", "string", "string", "boolean", "string", "bigint"))]
    return (found.select(*columns, F.lit(None).cast("int").alias("failed_block"), F.lit(None).cast("string").alias("error"))
            .unionByName(failed.select("tender_id", *none, F.col("block").alias("failed_block"), "error")))


def _filled(template: str, **slots: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, value in slots.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


_SUMMARY = _filled(M.SUMMARY_PROMPT, name="filename", text="t")
_JUDGE = _filled(M.VERDICT_PROMPT, description="description", category="category", mandatory="'True'", threshold="threshold", evidence="evidence")
_ASKED = _filled(M.MONEY_PROMPT, text="regexp_replace(t, '^\\s+|\\s+$', '', 'g')")
_LISTED = _filled(M.CRITERIA_PROMPT, text="b")
_TEXTS = ",".join(f"({p}::BIGINT,'{d}','{c}','{t}')" for p, d, c, m, t, e in D.RULES if p <= 2)

QUERIES = {
    "document_summaries": (document_summaries, f"""WITH {D.FILES_SQL.replace(' AS t FROM documents', ' AS stripped FROM documents')},
      b AS (SELECT doc_id, filename, i, substr(text, i * {K.SUMMARY_INPUT_CHARS} + 1, {K.SUMMARY_INPUT_CHARS}) AS t
        FROM files, UNNEST(range(0, CAST(ceil(length(text) / {K.SUMMARY_INPUT_CHARS}.0) AS BIGINT))) AS u(i) WHERE length(stripped) > 0),
      s AS (SELECT doc_id, filename, i, md5({_SUMMARY}) AS m FROM b),
      w AS (SELECT doc_id, filename, count(*) AS n, string_agg(m, chr(10) ORDER BY i) AS t FROM s GROUP BY ALL)
      SELECT doc_id, CASE WHEN n = 1 THEN t ELSE md5({_SUMMARY}) END AS summary FROM w"""),
    "label_verdicts": (label_verdicts, f"""WITH r(criterion_id, description, category, threshold) AS (VALUES {_TEXTS}),
      p AS (SELECT doc_id AS bidder_id, quality::BIGINT + 1 AS criterion_id, CASE WHEN toxic = 1 OR doc_id > 100 THEN
          chr(10) || '1. in ' || doc_id || ': ' || CASE WHEN toxic = 1 THEN 'toxic' ELSE '?' END
          || chr(10) || '   wording ?' || chr(10) || '   remark ' || chr(10) END AS evidence FROM labels),
      q AS (SELECT *, md5({_JUDGE}) AS m FROM p JOIN r USING (criterion_id))
      SELECT bidder_id, criterion_id, CASE WHEN evidence IS NULL THEN 'NEEDS_REVIEW' WHEN m[1] = '0' THEN 'NEEDS_REVIEW'
          WHEN m[1] < '6' THEN 'ELIGIBLE' WHEN m[1] < 'b' THEN 'NOT_ELIGIBLE' ELSE 'NEEDS_REVIEW' END AS verdict,
        CASE WHEN evidence IS NULL THEN 'No evidence found for: ' || description || '. The required documents may not have been submitted.'
          WHEN m[1] = '0' THEN 'Evaluation error: invalid JSON. Manual review required.' ELSE m END AS explanation,
        CASE WHEN evidence IS NULL THEN 0.5 WHEN m[1] = '0' THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence FROM q"""),
    "money_routed": (money_routed, f"""{MQ.MONEY_SQL}, {MQ.GATE_SQL}, n AS (SELECT t.id, length({_ASKED}) AS n FROM texts t LEFT JOIN a USING (id)
        WHERE length(trim(t)) > 0 AND (coalesce(c, 0) < {K.MONEY_MODEL_CONFIDENCE} OR coalesce(x, FALSE))),
      both_ways AS (SELECT * FROM named UNION ALL SELECT id, n * 1000.0, CASE n % 2 WHEN 1 THEN 'INR' ELSE 'USD' END,
        greatest(0.4, least(0.9, (3 + n % 7) / 10.0)), 'llm_disambiguate', 999999999 FROM n WHERE n % 7 <> 0),
      chosen AS ({MQ.BEST_SQL.format('both_ways')})
      SELECT t.id AS o_orderkey, round(amount, 4) AS amount, currency, round(confidence, 4) AS confidence, method
      FROM texts t LEFT JOIN chosen USING (id)"""),
    "criteria_from_model": (criteria_from_model, f"""WITH d AS (SELECT doc_id AS tender_id, coalesce(text, '') AS t FROM documents),
      s AS (SELECT tender_id, i::INT AS i, substr(t, i * {BLOCK - OVERLAP} + 1, {BLOCK}) AS b FROM d, UNNEST(range(0,
        greatest(1, CAST(ceil((length(t) - {OVERLAP}) / {BLOCK - OVERLAP}.0) AS BIGINT)))) AS u(i)),
      r AS (SELECT tender_id, i, md5({_LISTED}) AS m FROM s),
      l AS (SELECT tender_id, i * 2 AS ord, '{SHARED_RULE}' AS description, 'other' AS category, m[3] < '8' AS mandatory,
          left(m, CASE WHEN m[2] <= '9' THEN m[2]::INT ELSE ascii(m[2]) - 87 END) AS threshold FROM r WHERE m[1] <> '0'
        UNION ALL SELECT tender_id, i * 2 + 1, m, 'technical', TRUE, '' FROM r WHERE m[1] <> '0'),
      g AS (SELECT tender_id, description, min(ord) AS first, arg_min(category, ord) AS category, arg_min(mandatory, ord) AS mandatory,
        arg_min(threshold, (-length(threshold), ord)) AS threshold, count(*) AS merged FROM l GROUP BY ALL)
      SELECT tender_id, 'C-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS crit_code, description, category,
        mandatory, threshold, merged, NULL::INT AS failed_block, NULL::VARCHAR AS error
        FROM (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY first) AS n FROM g)
      UNION ALL SELECT tender_id, NULL, NULL, NULL, NULL, NULL, NULL, i, 'invalid JSON' FROM r WHERE m[1] = '0'"""),
    "evidence_parts": (evidence_parts, f"""WITH {D.EVIDENCE_SQL}, l AS (SELECT bidder_id, criterion_id, ordinal, '. in ' || source_document
          || ': ' || CAST(round(value * 100) AS BIGINT) || chr(10) || '   wording ?' || chr(10) || '   remark ?'
          || chr(10) AS line FROM evidence),
      w AS (SELECT *, row_number() OVER (PARTITION BY bidder_id, criterion_id ORDER BY ordinal, line) AS n, coalesce(sum(length(line) + 8) OVER
          (PARTITION BY bidder_id, criterion_id ORDER BY ordinal, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
      p AS (SELECT bidder_id, criterion_id, CAST(floor(before / {PART_CHARS}) AS INT) AS part,
          string_agg(chr(10) || n || line, '' ORDER BY n) AS evidence FROM w GROUP BY ALL)
      SELECT bidder_id, criterion_id, part, length(evidence) AS chars, md5(evidence) AS evidence_md5 FROM p"""),
}
