"""Verdicts per bidder, per outcome and per report section.

All aggregates here have fixed-width partial states (flags and counts), so a
bidder or tender with most of the rows is reduced on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.functions import text as X


def overall_verdict(verdict: Column | str = "verdict", mandatory: Column | str | None = "mandatory") -> Column:
    """Aggregate: worst verdict over mandatory criteria; ELIGIBLE for none.

    ``mandatory=None`` counts every criterion as mandatory (report parity).
    """
    v = X.col(verdict)
    counts = F.lit(True) if mandatory is None else F.coalesce(X.col(mandatory), F.lit(True))
    return (F.when(F.coalesce(F.bool_or(counts & (v == K.NOT_ELIGIBLE)), F.lit(False)), K.NOT_ELIGIBLE)
            .when(F.coalesce(F.bool_or(counts & (v == K.NEEDS_REVIEW)), F.lit(False)), K.NEEDS_REVIEW)
            .otherwise(K.ELIGIBLE))


def verdict_counts(verdict: Column | str = "verdict") -> list[Column]:
    v = X.col(verdict)
    return [F.count_if(v == K.ELIGIBLE).alias("passed"), F.count_if(v == K.NOT_ELIGIBLE).alias("not_met"),
            F.count_if(v == K.NEEDS_REVIEW).alias("review")]


def summary(verdicts: DataFrame, keys: list[str], all_mandatory: bool = False) -> DataFrame:
    """Passed / not met / review counts and the overall verdict per bidder."""
    return verdicts.groupBy(*keys).agg(
        *verdict_counts(), overall_verdict("verdict", None if all_mandatory else "mandatory").alias("overall"))


def outcome_histogram(summary_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return summary_rows.groupBy(*(keys or []), "overall").agg(F.count("*").alias("bidders"))


def filter_outcome(summary_rows: DataFrame, outcome: str = "All") -> DataFrame:
    """"All", "Eligible Only", "Not Eligible Only" or "Needs Review Only"."""
    wanted = {"Eligible Only": K.ELIGIBLE, "Not Eligible Only": K.NOT_ELIGIBLE,
              "Needs Review Only": K.NEEDS_REVIEW}.get(outcome)
    return summary_rows if wanted is None else summary_rows.where(F.col("overall") == wanted)


def matrix(verdicts: DataFrame, keys: list[str], codes: list[str], all_mandatory: bool = False) -> DataFrame:
    """One row per bidder, one icon column per criterion code, and the outcome.

    ``codes`` is the tender's list of codes.  The last verdict of a pair (by
    ``seq``) wins; a criterion without one stays NULL.
    """
    latest = (verdicts.groupBy(*keys, "crit_code")
              .agg(F.max_by("verdict", "seq").alias("verdict"), F.max_by("mandatory", "seq").alias("mandatory")))
    cells = [F.max(F.when(F.col("crit_code") == c, X.verdict_icon("verdict"))).alias(c.replace("-", "_"))
             for c in codes]
    wide = latest.groupBy(*keys).agg(
        *cells, overall_verdict("verdict", None if all_mandatory else "mandatory").alias("_o"))
    label = F.concat(X.verdict_icon("_o"), F.lit(" "), X.title_label("_o"))
    return wide.withColumn("overall", label).drop("_o")


def kpis(tenders: DataFrame, criteria: DataFrame, bidders: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Report header per tender: criteria, mandatory ones, bidders, assessments.

    Each table is reduced to one row per tender before the joins.
    """
    c = criteria.groupBy("tender_id").agg(F.count("*").alias("criteria"), F.count_if("mandatory").alias("mandatory"))
    b = bidders.groupBy("tender_id").agg(F.count("*").alias("bidders"))
    v = verdicts.groupBy("tender_id").agg(F.count("*").alias("assessments"))
    out = (tenders.select(F.col("id").alias("tender_id"), F.col("name").alias("tender_name"))
           .join(c, "tender_id", "left").join(b, "tender_id", "left").join(v, "tender_id", "left"))
    return out.na.fill(0, ["criteria", "mandatory", "bidders", "assessments"])


def report_summary(summary_rows: DataFrame) -> DataFrame:
    """Display form of the summary: short safe name and badge."""
    return summary_rows.select(
        "bidder_id", X.safe_text(X.short_name("bidder_name")).alias("organisation"),
        "passed", "not_met", "review", X.badge("overall").alias("outcome"))


def report_detail(verdicts: DataFrame) -> DataFrame:
    """Display form of each verdict: code, badge, description, explanation."""
    text = F.coalesce(X.non_empty("explanation"), F.lit("No explanation."))
    return verdicts.select(
        "bidder_id", "criterion_id", "crit_code", X.badge("verdict").alias("badge"),
        X.safe_text(X.left(F.coalesce("crit_desc", F.lit("")), K.REPORT_DESCRIPTION_CHARS)).alias("description"),
        X.safe_text(X.left(text, K.REPORT_EXPLANATION_CHARS)).alias("explanation"))


def report_criteria(criteria: DataFrame) -> DataFrame:
    """Display form of the criteria list."""
    kind = F.when(F.col("mandatory"), "Mandatory").otherwise("Optional")
    shown = F.when(F.coalesce(F.col("threshold"), F.lit("")) != "",
                   F.concat(F.lit("Threshold: "), X.safe_text("threshold")))
    return criteria.select(
        "tender_id", "id", F.concat(F.col("crit_code"), F.lit(" ("), F.col("category"), F.lit(", "), kind,
                                    F.lit(")")).alias("title"),
        X.safe_text("description").alias("description"), shown.alias("threshold_line"))
