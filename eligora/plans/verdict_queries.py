"""Verdicts, rollups and report tables over suppliers and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora.functions import text as X
from eligora.operators import evaluate as E
from eligora.operators import rollup as R
from eligora.operators import worklist as W
from eligora.plans import domain as D
from eligora.session import spread

# Tasks per piece of the scan of line items; each costs some tenths of a second before its first row.
SHARES = 4
BIDDER = ["tender_id", "bidder_id", "bidder_name"]


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return W.work_list(D.bidders(spark, sf), D.criteria(spark, sf))


def _verdicts(spark: SparkSession, sf: str, explain: bool = False) -> DataFrame:
    """Verdicts of all pairs; criteria that need a model are put up for review."""
    prepared, evidence = E.prepare_criteria(D.rules(spark)), D.evidence(spark, sf)
    ruled = E.quantitative_verdicts(_pairs(spark, sf), prepared, E.evidence_numbers(evidence, prepared), explain)
    return ruled.unionByName(E.unjudged_verdicts(_pairs(spark, sf), prepared, evidence).select(*ruled.columns))


def eligibility_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.summary(_verdicts(spark, sf), BIDDER)


def eligibility_summary_all_mandatory(spark: SparkSession, sf: str) -> DataFrame:
    return R.summary(_verdicts(spark, sf), BIDDER, all_mandatory=True)


def verdict_detail(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf, explain=True).select(
        *BIDDER, "criterion_id", "crit_code", "verdict", "explanation", "confidence")


def verdict_matrix(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = _verdicts(spark, sf).withColumn("seq", F.col("criterion_id"))
    return R.matrix(verdicts, BIDDER, [f"C-{k:03d}" for k in range(1, 8)])


def outcome_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return R.outcome_histogram(eligibility_summary(spark, sf), ["tender_id"])


def outcome_filter(spark: SparkSession, sf: str) -> DataFrame:
    return R.filter_outcome(eligibility_summary(spark, sf), "Needs Review Only")


def kpi_header(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = _verdicts(spark, sf).select("tender_id")
    return R.kpis(D.tenders(spark, sf), D.criteria(spark, sf), D.bidders(spark, sf), verdicts)


def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.report_summary(eligibility_summary(spark, sf))


def report_detail(spark: SparkSession, sf: str) -> DataFrame:
    return R.report_detail(_verdicts(spark, sf, explain=True))


def report_criteria(spark: SparkSession, sf: str) -> DataFrame:
    return R.report_criteria(D.criteria(spark, sf))


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a log of evaluations: a pair is done if its last entry was returned ("R")."""
    log = D.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("bidder_id"), F.col("l_linenumber").cast("bigint").alias("criterion_id"))
    return log.agg(F.max_by("l_returnflag", "l_orderkey").alias("last")).where("last = 'R'").select("bidder_id", "criterion_id")


def pending_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return W.pending_pairs(_pairs(spark, sf), _evaluated(spark, sf)).select(*BIDDER, "criterion_id", "crit_code")


def remaining_count(spark: SparkSession, sf: str) -> DataFrame:
    return W.progress(_pairs(spark, sf), _evaluated(spark, sf))


def no_evidence_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Rule for pairs without evidence, over the pairs that are not done."""
    pairs = W.pending_pairs(_pairs(spark, sf), _evaluated(spark, sf))
    texts = D.rules(spark).select(F.col("id").alias("criterion_id"), "description")
    told = pairs.join(texts, "criterion_id").withColumn("_v", E.no_evidence(F.col("mandatory"), F.col("description")))
    return told.select("bidder_id", "criterion_id", F.col("_v.verdict").alias("verdict"),
                       F.col("_v.explanation").alias("explanation"), F.col("_v.confidence").alias("confidence"))


def low_ocr_review(spark: SparkSession, sf: str) -> DataFrame:
    prepared = E.prepare_criteria(D.rules(spark))
    facts = E.pair_facts(E.evidence_numbers(D.evidence(spark, sf), prepared))
    return facts.where(F.col("low_ocr")).select(
        "bidder_id", "criterion_id", "n_evidence", "n_qualifying", F.round("best_value", 2).alias("best_value"),
        F.col("best_source").alias("best_source"))


def evidence_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Values read back from evidence texts ("Rs. 45,983.16 as per order")."""
    prepared = E.prepare_criteria(D.rules(spark))
    price = F.format_number("value", 2)
    told = spread(D.evidence(spark, sf), "ordinal", shares=SHARES).select(
        "bidder_id", "criterion_id", "ordinal", "source_document", "ocr_confidence",
        F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("Rs. "), price)).when(F.col("ordinal") % 3 == 1, price)
        .otherwise(F.lit("")).alias("extracted_value"),
        F.when(F.col("ordinal") % 3 == 2, F.concat(F.lit("Amount INR "), price, F.lit(" as per order"))
               ).otherwise(F.lit("as ordered")).alias("source_text"), F.lit(None).cast("double").alias("normalized_value"))
    numbers = E.evidence_numbers(told, prepared)
    return numbers.select("bidder_id", "criterion_id", "ordinal", F.round("value", 2).alias("value"))


def criterion_route(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed rules of every tender and the route each takes."""
    prepared = E.prepare_criteria(D.criteria(spark, sf))
    return prepared.select("tender_id", "criterion_id", "operator", "threshold_value", "required_count", "route",
                           "rupee_first", "rupee_only")


def verdict_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every value behind a missed count, a row each; the required count is put out of reach."""
    strict = D.rules(spark).withColumn("description", F.replace(
        "description", F.lit("at least three (3)"), F.lit("at least 10000000")))
    prepared = E.prepare_criteria(strict)
    numbers = E.evidence_numbers(D.evidence(spark, sf), prepared)
    return E.missed_values(numbers, E.pair_facts(numbers, sources=False))


def empty_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of whom no pair is done stand for bidders without usable text."""
    usable = _evaluated(spark, sf).select("bidder_id")
    return E.empty_corpus_verdicts(_pairs(spark, sf), usable)


def rule_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Badge, title label, icons and report marks of every verdict."""
    v = _verdicts(spark, sf)
    mark = X.report_mark("verdict")
    return v.select("bidder_id", "criterion_id", X.badge("verdict").alias("badge"),
                    X.title_label("verdict").alias("label"), X.verdict_icon("verdict").alias("icon"),
                    mark["mark"].alias("mark"), mark["style"].alias("style"))


_V = D.VERDICTS_SQL
_SUMMARY = f"""SELECT tender_id, bidder_id, bidder_name, count(*) FILTER (WHERE verdict = 'ELIGIBLE') AS passed,
 count(*) FILTER (WHERE verdict = 'NOT_ELIGIBLE') AS not_met, count(*) FILTER (WHERE verdict = 'NEEDS_REVIEW') AS review,
 {D.OVERALL_SQL} AS overall FROM verdicts GROUP BY tender_id, bidder_id, bidder_name"""
_PAIRS = f"""WITH {D.BIDDERS_SQL}, all_rules(criterion_id, crit_code, mandatory, description) AS (VALUES """ + ",".join(
    f"({p}::BIGINT,'C-{p:03d}',{m},'{d}')" for p, d, c, m, t, e in D.RULES) + f"""),
pairs AS (SELECT tender_id, b.id AS bidder_id, b.name AS bidder_name, criterion_id, crit_code, mandatory, description
  FROM bidders b CROSS JOIN all_rules),
evaluated AS (SELECT l_suppkey AS bidder_id, l_linenumber::BIGINT AS criterion_id FROM lineitem GROUP BY ALL
  HAVING arg_max(l_returnflag, l_orderkey) = 'R')"""
_EXPLAINED = _V + """, best AS (SELECT bidder_id, criterion_id, arg_max(source_document, (value, -ordinal)) AS doc
  FROM joined GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bidder_id, criterion_id ORDER BY ordinal) AS rn
  FROM joined WHERE passes AND required_count > 1),
sources AS (SELECT bidder_id, criterion_id, string_agg(source_document::VARCHAR, ', ' ORDER BY rn) AS sources
  FROM ranked WHERE rn <= required_count GROUP BY ALL),
listed AS (SELECT bidder_id, criterion_id, string_agg(format('{:,.0f}', value), ', ' ORDER BY ordinal, value) AS vals
  FROM joined WHERE required_count > 1 GROUP BY ALL),
texts(criterion_id, description) AS (VALUES """ + ",".join(f"({p}::BIGINT,'{d}')" for p, d, *_ in D.RULES) + """),
named AS (SELECT v.*, b.doc, s.sources, l.vals, t.description,
   operator || ' ' || format('{:,.0f}', threshold_value) AS bar, format('{:,.0f}', best_value) AS best,
   CASE operator WHEN '>=' THEN best_value >= threshold_value ELSE best_value <= threshold_value END AS ok
 FROM verdicts v JOIN texts t USING (criterion_id) LEFT JOIN best b USING (bidder_id, criterion_id)
 LEFT JOIN sources s USING (bidder_id, criterion_id) LEFT JOIN listed l USING (bidder_id, criterion_id)),
explained AS (SELECT *, CASE
  WHEN n_evidence IS NULL AND mandatory THEN 'No evidence found for: ' || description || '. The required documents may not have been submitted.'
  WHEN n_evidence IS NULL THEN 'Optional criterion not claimed: ' || left(description, 120) || '. Does not affect overall eligibility.'
  WHEN operator IS NULL THEN 'Evaluation error: no model available. Manual review required.'
  WHEN required_count > 1 AND n_qualifying >= required_count THEN 'Found ' || n_qualifying || ' qualifying items meeting threshold '
    || bar || ' (required: ' || required_count || '). Sources: ' || sources || '.'
  WHEN required_count > 1 THEN 'Only ' || n_qualifying || ' out of ' || required_count || ' required items meet threshold '
    || bar || '. Values found: ' || vals || '.'
  WHEN low_ocr THEN 'Extracted value: ' || best || ' from ' || doc || '. However, OCR confidence is low. Please manually verify.'
  WHEN abs(best_value - threshold_value) <= threshold_value * 0.1 THEN 'Extracted value: ' || best || '. Threshold: ' || bar
    || '. Value is ' || CASE WHEN best_value = threshold_value THEN 'at' ELSE 'near' END
    || ' the threshold boundary. Source: ' || doc || '.'
  WHEN ok THEN 'Extracted value: ' || best || ' meets threshold ' || bar || '. Source: ' || doc || '.'
  ELSE 'Extracted value: ' || best || ' does not meet threshold ' || bar || '. Shortfall: '
    || format('{:,.0f}', threshold_value - best_value) || '. Source: ' || doc || '.' END AS explanation,
  CASE WHEN n_evidence IS NULL THEN CASE WHEN mandatory THEN 0.5 ELSE 1.0 END WHEN operator IS NULL THEN 0.0
    WHEN required_count > 1 THEN 0.95
    WHEN low_ocr THEN 0.5 WHEN abs(best_value - threshold_value) <= threshold_value * 0.1 THEN 0.7 ELSE 0.95
  END::DOUBLE AS confidence FROM named)"""
_BADGE = "replace({}, '_', ' ')"


def _icon(v: str) -> str:
    return f"CASE {v} WHEN 'ELIGIBLE' THEN '✅' WHEN 'NOT_ELIGIBLE' THEN '❌' ELSE '⚠️' END"


def _label(v: str) -> str:
    return f"CASE {v} WHEN 'ELIGIBLE' THEN 'Eligible' WHEN 'NOT_ELIGIBLE' THEN 'Not Eligible' ELSE 'Needs Review' END"


QUERIES = {
    "eligibility_summary": (eligibility_summary, f"{_V} {_SUMMARY}"),
    "eligibility_summary_all_mandatory": (
        eligibility_summary_all_mandatory, f"{_V} {_SUMMARY.replace('mandatory AND ', '')}"),
    "verdict_detail": (verdict_detail, f"""{_EXPLAINED} SELECT tender_id, bidder_id, bidder_name, criterion_id, crit_code,
      verdict, explanation, confidence FROM explained"""),
    "verdict_matrix": (verdict_matrix, f"""{_V}, o AS (SELECT tender_id, bidder_id, bidder_name, {', '.join(
        f"max(CASE WHEN crit_code = '{c}' THEN {_icon('verdict')} END) AS {c.replace('-', '_')}"
        for c in [f'C-{k:03d}' for k in range(1, 8)])}, {D.OVERALL_SQL} AS o FROM verdicts
        GROUP BY tender_id, bidder_id, bidder_name)
      SELECT * EXCLUDE (o), {_icon('o')} || ' ' || {_label('o')} AS overall FROM o"""),
    "outcome_histogram": (outcome_histogram, f"""{_V}, s AS ({_SUMMARY})
      SELECT tender_id, overall, count(*) AS bidders FROM s GROUP BY ALL"""),
    "outcome_filter": (outcome_filter, f"{_V}, s AS ({_SUMMARY}) SELECT * FROM s WHERE overall = 'NEEDS_REVIEW'"),
    "kpi_header": (kpi_header, f"""{_V} SELECT r_regionkey::BIGINT AS tender_id, r_name AS tender_name, 7::BIGINT AS criteria,
      5::BIGINT AS mandatory, (SELECT count(*) FROM bidders b WHERE b.tender_id = r_regionkey) AS bidders,
      (SELECT count(*) FROM verdicts v WHERE v.tender_id = r_regionkey) AS assessments FROM region"""),
    "report_summary": (report_summary, f"""{_V}, s AS ({_SUMMARY}) SELECT bidder_id, CASE WHEN length(bidder_name) > 42
      THEN left(bidder_name, 42) || '...' ELSE bidder_name END AS organisation, passed, not_met, review,
      {_BADGE.format('overall')} AS outcome FROM s"""),
    "report_detail": (report_detail, f"""{_EXPLAINED} SELECT bidder_id, criterion_id, crit_code,
      {_BADGE.format('verdict')} AS badge, left(description, 500) AS description, left(explanation, 2000) AS explanation
      FROM explained"""),
    "report_criteria": (report_criteria, """WITH c(id, title, description, threshold_line) AS (VALUES """ + ",".join(
        f"({p}::BIGINT,'C-{p:03d} ({c}, {'Mandatory' if m else 'Optional'})','{d}',"
        + (f"'Threshold: {t}'" if t else "NULL") + ")" for p, d, c, m, t, e in D.RULES) + """)
      SELECT r_regionkey::BIGINT AS tender_id, c.* FROM region CROSS JOIN c"""),
    "pending_pairs": (pending_pairs, f"""{_PAIRS} SELECT tender_id, bidder_id, bidder_name, criterion_id, crit_code
      FROM pairs ANTI JOIN evaluated USING (bidder_id, criterion_id)"""),
    "remaining_count": (remaining_count, f"""{_PAIRS}, n AS (SELECT tender_id, count(*) AS total_pairs,
      count(e.bidder_id) AS evaluated FROM pairs p LEFT JOIN evaluated e
        ON e.bidder_id = p.bidder_id AND e.criterion_id = p.criterion_id GROUP BY tender_id)
      SELECT *, total_pairs - evaluated AS remaining, least(floor(evaluated * 100 / total_pairs), 99)::BIGINT AS percent
      FROM n"""),
    "no_evidence_verdict": (no_evidence_verdict, f"""{_PAIRS} SELECT bidder_id, criterion_id,
      CASE WHEN mandatory THEN 'NEEDS_REVIEW' ELSE 'ELIGIBLE' END AS verdict,
      CASE WHEN mandatory THEN 'No evidence found for: ' || description || '. The required documents may not have been submitted.'
        ELSE 'Optional criterion not claimed: ' || left(description, 120) || '. Does not affect overall eligibility.' END
        AS explanation, CASE WHEN mandatory THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence
      FROM pairs ANTI JOIN evaluated USING (bidder_id, criterion_id)"""),
    "low_ocr_review": (low_ocr_review, f"""{_V} SELECT bidder_id, criterion_id, n_evidence, n_qualifying,
      round(best_value, 2) AS best_value, doc::VARCHAR AS best_source FROM facts JOIN (SELECT bidder_id, criterion_id,
        arg_max(source_document, (value, -ordinal)) AS doc FROM joined GROUP BY ALL) USING (bidder_id, criterion_id)
      WHERE low_ocr AND criterion_id NOT IN (4, 7)"""),
    "evidence_numbers": (evidence_numbers, f"""{_V} SELECT bidder_id, criterion_id, ordinal, round(value, 2) AS value
      FROM joined WHERE operator IS NOT NULL"""),
    "criterion_route": (criterion_route, f"""WITH {D.RULES_SQL},
      routes(criterion_id, rupee_first, rupee_only) AS (VALUES (1::BIGINT,TRUE,FALSE),(2,TRUE,FALSE),(3,FALSE,FALSE),
        (4,FALSE,NULL),(5,TRUE,FALSE),(6,TRUE,FALSE),(7,FALSE,FALSE))
      SELECT r_regionkey::BIGINT AS tender_id, x.criterion_id, operator, threshold_value,
        coalesce(required_count, 1) AS required_count,
        CASE WHEN operator IS NULL THEN 'qualitative' ELSE 'quantitative' END AS route, rupee_first,
        coalesce(rupee_only, FALSE) AS rupee_only
      FROM region CROSS JOIN routes x LEFT JOIN rules USING (criterion_id)"""),
    "verdict_values": (verdict_values, f"""{_V} SELECT bidder_id, criterion_id, ordinal, value,
      format('{{:,.0f}}', value) AS printed FROM joined WHERE criterion_id = 2"""),
    "empty_corpus": (empty_corpus, f"""{_PAIRS} SELECT bidder_id, criterion_id, 'NEEDS_REVIEW' AS verdict,
      'No usable text could be extracted from this bidder''s documents.' AS explanation, 0.0::DOUBLE AS confidence
      FROM pairs WHERE bidder_id NOT IN (SELECT bidder_id FROM evaluated)"""),
    "rule_labels": (rule_labels, f"""{_V} SELECT bidder_id, criterion_id, {_BADGE.format('verdict')} AS badge,
      {_label('verdict')} AS label, {_icon('verdict')} AS icon,
      CASE verdict WHEN 'ELIGIBLE' THEN '✓' WHEN 'NOT_ELIGIBLE' THEN '✗' ELSE '◆' END AS mark,
      CASE verdict WHEN 'ELIGIBLE' THEN 'pass' WHEN 'NOT_ELIGIBLE' THEN 'fail' ELSE 'review' END AS style FROM verdicts"""),
}
