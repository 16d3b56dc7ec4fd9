"""Counts, years and thresholds of criteria; verdict rules."""

import pytest
from pyspark.sql import functions as F

from eligora.functions import thresholds as T
from eligora.operators import evaluate as E
from eligora.operators import rollup as R

PERSONNEL = ("The bidder must have adequate technical personnel on their rolls, including at least one qualified "
             "civil engineer with minimum 10 years of experience.")
WORKS = ("The bidder must have completed at least three (3) similar works, each of value not less than "
         "Rs. 2,00,00,000/- (Rupees Two Crore only).")
ISO = ("Possession of ISO 14001:2015 (Environmental Management) certification is desirable and will carry "
       "additional weightage of up to 5 marks.")
AHEAD = "Track record of completing projects ahead of schedule will be viewed favourably."
CRITERIA = "id long, crit_code string, description string, category string, mandatory boolean, threshold string"


def criteria(spark, *rows):
    return spark.createDataFrame([(i, f"C-{i:03d}", *r) for i, r in enumerate(rows, 1)], CRITERIA)


@pytest.mark.parametrize("text,count,strict", [
    ("minimum 10 years", 10, 1), ("at least 5 crore", 5, 1), ("at least seventy", 7, 7), (PERSONNEL, 1, 1),
    (WORKS, 3, 3), ("4 or more similar works", 4, 4), ("6 completed projects", 6, 6), ("(2) works", 2, 2),
    ("", 1, 1), (None, 1, 1)])
def test_count(spark, text, count, strict):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(T.count_requirement("t").alias("a"), T.count_requirement(F.col("t"), True).alias("b")).first()
    assert (got.a, got.b) == (count, strict)


@pytest.mark.parametrize("description,threshold,expected", [
    (PERSONNEL, ">= 10000000", (">=", 10.0)), (PERSONNEL, "> 5", (">", 10.0)), (ISO, ">= 10000000", None),
    (AHEAD, ">= 10000000", None), (WORKS, ">= 20000000", (">=", 20_000_000.0)), ("Some rule", "<= 12.5", ("<=", 12.5)),
    ("Some rule", "about 7", (">=", 7.0)), ("Some rule", "", None), ("active at least 3 yrs", "", (">=", 3.0)),
    ("ISO 9001 certificate", "1", None), ("fee Rs. 5,000", "= 1", ("=", 5000.0))])
def test_threshold(spark, description, threshold, expected):
    df = spark.createDataFrame([(description, threshold)], "d string, t string")
    got = df.select(T.parse_threshold("d", "t").alias("x")).first().x
    assert (got and (got.operator, got.value)) == expected


EVIDENCE = ("bidder_id long, criterion_id long, ordinal long, source_document string, ocr_confidence double, "
            "extracted_value string, source_text string, normalized_value double")


def verdicts(spark, crit, rows, pairs):
    prepared = E.prepare_criteria(crit)
    numbers = E.evidence_numbers(spark.createDataFrame(rows, EVIDENCE), prepared)
    got = E.quantitative_verdicts(spark.createDataFrame(pairs, "bidder_id long, criterion_id long"), prepared, numbers)
    return {(r.bidder_id, r.criterion_id): r for r in got.collect()}


def row(bidder, criterion, n, value, ocr=95.0, text="", doc=None):
    return (bidder, criterion, n, doc or f"d{n}.txt", ocr, value, text, None)


def test_years_of_experience_pass(spark):
    crit = criteria(spark, (PERSONNEL, "technical", True, ">= 10000000"))
    got = verdicts(spark, crit, [row(1, 1, 1, "18", text="18 years in civil construction")], [(1, 1)])
    assert got[1, 1].verdict == "ELIGIBLE" and got[1, 1].confidence == 0.95


def test_merit_wording_takes_the_other_route(spark):
    prepared = E.prepare_criteria(criteria(spark, (ISO, "experience", False, ">= 10000000")))
    assert prepared.first().route == "qualitative"


def test_single_value_rules(spark):
    crit = criteria(spark, ("Score", "technical", True, ">= 100"), ("Extra", "technical", False, ">= 100"))
    values = {1: "95", 2: "105", 3: "120", 4: "80", 5: "100", 6: "none"}
    rows = [row(b, 1, 1, v) for b, v in values.items()] + [row(8, 1, 1, "150", ocr=64.0)]
    got = verdicts(spark, crit, rows, [(b, 1) for b in (*values, 7, 8)] + [(1, 2)])
    assert [(got[b, 1].verdict, got[b, 1].confidence) for b in range(1, 9)] == [
        ("NEEDS_REVIEW", 0.7), ("ELIGIBLE", 0.7), ("ELIGIBLE", 0.95), ("NOT_ELIGIBLE", 0.95), ("ELIGIBLE", 0.7),
        ("NEEDS_REVIEW", 0.4), ("NEEDS_REVIEW", 0.5), ("NEEDS_REVIEW", 0.5)]
    assert got[5, 1].explanation == ("Extracted value: 100. Threshold: >= 100. Value is at the threshold boundary. "
                                     "Source: d1.txt.")
    assert got[4, 1].explanation == ("Extracted value: 80 does not meet threshold >= 100. Shortfall: 20. "
                                     "Source: d1.txt.")
    assert (got[1, 2].verdict, got[1, 2].confidence) == ("ELIGIBLE", 1.0)


def test_counting_rule_ignores_low_ocr_and_lists_values(spark):
    crit = criteria(spark, (WORKS, "experience", True, ">= 20000000"))
    works = [row(1, 1, 3, "Rs. 3,00,00,000"), row(1, 1, 1, "Rs. 2,50,00,000"), row(1, 1, 2, "Rs. 1,00,00,000"),
             row(1, 1, 4, "Rs. 4,00,00,000"), row(1, 1, 5, "Rs. 5,00,00,000")]
    short = [row(2, 1, 1, "Rs. 2,50,00,000", ocr=10.0), row(2, 1, 2, "Rs. 3,00,00,000"), row(2, 1, 3, "12 items")]
    got = verdicts(spark, crit, works + short, [(1, 1), (2, 1)])
    assert got[1, 1].explanation == ("Found 4 qualifying items meeting threshold >= 20,000,000 (required: 3). "
                                     "Sources: d1.txt, d3.txt, d4.txt.")
    assert got[2, 1].verdict == "NOT_ELIGIBLE"
    assert got[2, 1].explanation.startswith("Only 2 out of 3 required items meet threshold >= 20,000,000. Values found: 25,000,000, 30,000,000")


def test_more_sources_than_the_planner_limit(spark):
    need = 1200
    crit = criteria(spark, (f"at least {need} similar works, value not less than Rs. 90,000", "experience", True, ""))
    one = F.lit(1).cast("long")
    rows = spark.range(need + 300).select(one.alias("bidder_id"), one.alias("criterion_id"), F.col("id").alias("ordinal"),
                                          F.concat(F.lit("d"), F.col("id").cast("string")).alias("source_document"),
                                          F.lit(None).cast("double").alias("ocr_confidence"), F.lit(1e5).alias("value"))
    prepared = E.prepare_criteria(crit)
    got = E.quantitative_verdicts(spark.createDataFrame([(1, 1)], "bidder_id long, criterion_id long"), prepared,
                                  E.evidence_numbers(rows, prepared)).first()
    assert got.explanation.endswith("Sources: " + ", ".join(f"d{i}" for i in range(need)) + ".")


def test_value_lists_of_any_length_are_whole(spark):
    crit = criteria(spark, ("at least 9 similar works, value not less than Rs. 90,000", "experience", True, ""))
    n = 1500
    rows = spark.range(n).select(F.lit(1).cast("long").alias("bidder_id"), F.lit(1).cast("long").alias("criterion_id"),
                                 F.col("id").alias("ordinal"), F.lit("d").alias("source_document"),
                                 F.lit(None).cast("double").alias("ocr_confidence"), F.col("id").cast("double").alias("value"))
    prepared = E.prepare_criteria(crit)
    numbers = E.evidence_numbers(rows, prepared)
    verdict = E.quantitative_verdicts(spark.createDataFrame([(1, 1)], "bidder_id long, criterion_id long"), prepared, numbers)
    printed = [f"{v:,.0f}" for v in range(n)]
    assert verdict.first().explanation.endswith("Values found: " + ", ".join(printed) + ".")
    assert [r.printed for r in E.missed_values(numbers, E.pair_facts(numbers)).orderBy("ordinal").collect()] == printed


@pytest.mark.parametrize("rows,respect,parity", [
    ([("NOT_ELIGIBLE", True), ("ELIGIBLE", True)], "NOT_ELIGIBLE", "NOT_ELIGIBLE"),
    ([("NEEDS_REVIEW", True), ("ELIGIBLE", True)], "NEEDS_REVIEW", "NEEDS_REVIEW"),
    ([("NOT_ELIGIBLE", False), ("ELIGIBLE", True)], "ELIGIBLE", "NOT_ELIGIBLE"),
    ([], "ELIGIBLE", "ELIGIBLE")])
def test_rollup_modes(spark, rows, respect, parity):
    df = spark.createDataFrame(rows, "verdict string, mandatory boolean")
    got = df.agg(R.overall_verdict().alias("a"), R.overall_verdict("verdict", None).alias("b")).first()
    assert (got.a, got.b) == (respect, parity)
