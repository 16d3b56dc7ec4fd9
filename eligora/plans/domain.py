"""The given tables read as the assessment domain.

regions are tenders, suppliers are bidders (through their nation), line items
are evidence rows, documents are submitted files of a bidder (their source).
The same readings are given as SQL text for the oracle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora.functions import text as X

# pos, description, category, mandatory, threshold, expected evidence
RULES = [
    (1, "The bidder must show one order of value not less than Rs. 60,000/- in the period.",
     "financial", True, ">= 60000", "Order copy"),
    (2, "The bidder must have completed at least three (3) similar works, each of value not less than Rs. 70,000/-.",
     "experience", True, "", "Completion certificates"),
    (3, "The quoted part price must stay small.", "technical", True, "<= 5000", "Price list"),
    (4, "Possession of ISO 14001:2015 certification is desirable and will carry additional weightage.",
     "experience", False, ">= 10000000", "Certificate"),
    (5, "A further order of value not less than Rs. 103,000/- will be noted.",
     "experience", False, ">= 103000", "Order copy"),
    (6, "The bidder must have an average annual turnover of not less than Rs. 0.9 lakh during the last years.",
     "financial", True, ">= 90000", "Accountant certificate"),
    (7, "A GST registration must be active.", "compliance", True, "", "Registration copy"),
]

# What the parser must make of RULES: pos, code, mandatory, operator, threshold, count.
RULES_SQL = """rules(criterion_id, crit_code, mandatory, operator, threshold_value, required_count) AS (VALUES
 (1::BIGINT,'C-001',TRUE,'>=',60000.0::DOUBLE,1::BIGINT),(2,'C-002',TRUE,'>=',70000.0,3),(3,'C-003',TRUE,'<=',5000.0,1),
 (4,'C-004',FALSE,NULL,NULL,1),
 (5,'C-005',FALSE,'>=',103000.0,1),(6,'C-006',TRUE,'>=',90000.0,1),(7,'C-007',TRUE,NULL,NULL,1))"""
BIDDERS_SQL = """bidders AS (SELECT s_suppkey AS id, s_name AS name, n_regionkey::BIGINT AS tender_id
 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
EVIDENCE_SQL = """evidence AS (SELECT l_suppkey AS bidder_id, l_linenumber::BIGINT AS criterion_id,
 l_orderkey * 10 + l_linenumber AS ordinal, l_orderkey AS source_document, l_quantity * 2 AS ocr_confidence,
 l_extendedprice AS value FROM lineitem)"""
FACTS_SQL = """joined AS (SELECT e.*, r.operator, r.threshold_value, r.required_count,
   CASE r.operator WHEN '>=' THEN e.value >= r.threshold_value WHEN '<=' THEN e.value <= r.threshold_value END AS passes
 FROM evidence e JOIN rules r USING (criterion_id)),
facts AS (SELECT bidder_id, criterion_id, count(*) AS n_evidence, count(value) AS n_values,
   bool_or(ocr_confidence < 65) AS low_ocr, count(*) FILTER (WHERE passes) AS n_qualifying,
   max(value) AS best_value FROM joined GROUP BY ALL),
verdicts AS (SELECT p.bidder_id, r.criterion_id, r.crit_code, r.mandatory, p.tender_id, p.bidder_name,
   f.n_evidence, f.n_values, f.n_qualifying, f.best_value, f.low_ocr, r.operator, r.threshold_value, r.required_count,
   CASE WHEN f.n_evidence IS NULL THEN CASE WHEN r.mandatory THEN 'NEEDS_REVIEW' ELSE 'ELIGIBLE' END
     WHEN r.operator IS NULL THEN 'NEEDS_REVIEW'
     WHEN r.required_count > 1 THEN CASE WHEN f.n_qualifying >= r.required_count THEN 'ELIGIBLE' ELSE 'NOT_ELIGIBLE' END
     WHEN f.low_ocr THEN 'NEEDS_REVIEW'
     WHEN abs(f.best_value - r.threshold_value) <= r.threshold_value * 0.1 THEN
       CASE WHEN (r.operator = '>=' AND f.best_value >= r.threshold_value)
              OR (r.operator = '<=' AND f.best_value <= r.threshold_value) THEN 'ELIGIBLE' ELSE 'NEEDS_REVIEW' END
     WHEN (r.operator = '>=' AND f.best_value >= r.threshold_value)
       OR (r.operator = '<=' AND f.best_value <= r.threshold_value) THEN 'ELIGIBLE'
     ELSE 'NOT_ELIGIBLE' END AS verdict
 FROM (SELECT id AS bidder_id, name AS bidder_name, tender_id FROM bidders) p CROSS JOIN rules r
 LEFT JOIN facts f ON f.bidder_id = p.bidder_id AND f.criterion_id = r.criterion_id)"""
VERDICTS_SQL = f"WITH {RULES_SQL}, {BIDDERS_SQL}, {EVIDENCE_SQL}, {FACTS_SQL}"
OVERALL_SQL = """CASE WHEN coalesce(bool_or(mandatory AND verdict = 'NOT_ELIGIBLE'), FALSE) THEN 'NOT_ELIGIBLE'
 WHEN coalesce(bool_or(mandatory AND verdict = 'NEEDS_REVIEW'), FALSE) THEN 'NEEDS_REVIEW' ELSE 'ELIGIBLE' END"""

# Criteria for document retrieval: pos, description.  The third matches nothing.
TEXT_RULES = [
    (1, "Thinly blended section of inner heed and worthless motion", "sheets", ">= 12"),
    (2, "Les nation entre oiseaux presentation", "certificate", ""),
    (3, "Qqxzj wvvkq jxqzz", "", ""),
]
TEXT_KEYWORDS = {
    1: ["thinly", "blended", "section", "inner", "heed", "worthless", "motion", "sheets", "12"],
    2: ["les", "nation", "entre", "oiseaux", "presentation", "certificate"],
    3: ["qqxzj", "wvvkq", "jxqzz"],
}
FILES_SQL = r"""files AS (SELECT doc_id, CAST(substr(source, 4) AS BIGINT) AS bidder_id,
   CAST(substr(source, 4) AS BIGINT) % 5 AS tender_id, 'doc_' || lpad(doc_id::VARCHAR, 9, '0') AS filename, text,
   regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)"""
CHUNKS_SQL = FILES_SQL + r""",
chunks AS (SELECT doc_id, bidder_id, tender_id, filename, i::INT AS chunk_index, substr(t, i * 600 + 1, 700) AS text
 FROM files, UNNEST(range(0, CASE WHEN length(t) <= 700 THEN 1
   ELSE CAST(ceil((length(t) - 700) / 600.0) AS BIGINT) + 1 END)) AS u(i) WHERE length(t) > 0)"""
SCORED_SQL = CHUNKS_SQL + ",\nscored AS (" + " UNION ALL ".join(
    f"SELECT doc_id, bidder_id, tender_id, filename, chunk_index, {pos}::BIGINT AS criterion_id, "
    + " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) + " AS score FROM chunks"
    for pos, words in TEXT_KEYWORDS.items()) + ")"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


RULE_SCHEMA = ("id bigint, crit_code string, description string, category string, mandatory boolean, "
               "threshold string, expected_evidence string")


def _rule_rows() -> list[tuple]:
    return [(p, f"C-{p:03d}", d, c, m, t, e) for p, d, c, m, t, e in RULES]


def rules(spark: SparkSession) -> DataFrame:
    """The criteria list every tender uses, as a plan of known (tiny) size."""
    return spark.range(0, 1, 1, 1).select(_inline(_rule_rows(), RULE_SCHEMA))


def tenders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(F.col("r_regionkey").cast("bigint").alias("id"),
                                                 F.col("r_name").alias("name"))


def per_tender(spark: SparkSession, folder: str, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed list of rows for every tender: a narrow explode of the regions."""
    return tenders(spark, folder).select(F.col("id").alias("tender_id"), _inline(rows, schema))


def _inline(rows: list[tuple], schema: str) -> Column:
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    text = json.dumps([dict(zip((n for n, _ in fields), r)) for r in rows])
    return F.inline(F.from_json(F.lit(text), F.lit(f"array<struct<{','.join(':'.join(f) for f in fields)}>>")))


def criteria(spark: SparkSession, folder: str) -> DataFrame:
    """tender x rule with the rule's position as its id within the tender."""
    return per_tender(spark, folder, _rule_rows(), RULE_SCHEMA)


def bidders(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("tender_id"))
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "tender_id")


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("bidder_id"), F.col("l_linenumber").cast("bigint").alias("criterion_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
        F.col("l_orderkey").alias("source_document"), (F.col("l_quantity") * 2).alias("ocr_confidence"),
        F.col("l_extendedprice").alias("value"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    bidder: Column = F.substring("source", 4, 9).cast("bigint")
    return table(spark, folder, "documents").select(
        "doc_id", bidder.alias("bidder_id"), F.pmod(bidder, F.lit(5)).alias("tender_id"),
        F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("filename"),
        F.col("text").alias("full_text"))


def text_criteria(spark: SparkSession, folder: str) -> DataFrame:
    return per_tender(spark, folder, TEXT_RULES, "criterion_id bigint, description string, "
                                                 "expected_evidence string, threshold string")
