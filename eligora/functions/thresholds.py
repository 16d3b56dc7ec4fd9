"""What a criterion asks for: counts, years, operators and amounts.

These run once per criterion, before the join with the (much larger) evidence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.functions.money import evidence_rupees, rupees
from eligora.functions.text import (
    as_double, bind, col, contains_any, extract, lookup, number, reusable, strip,
)


@reusable
def count_requirement(text: Column | str, strict: bool = False) -> Column:
    """How many items are wanted ("at least three"), 1 when nothing says so.

    By default "minimum 10 years" reads as ten items, as users are used to.
    ``strict`` refuses a count that is followed by a unit of time or money.
    """
    low = F.lower(F.coalesce(col(text), F.lit("")))
    if strict:
        low = F.regexp_replace(
            low, K.U + rf"(\d+|{K.COUNT_WORD})\s*(?=(?:years?|yrs?|months?|crores?|lakhs?|lac|%)\b)", "# ")
    found = []
    for pattern in K.COUNT_PATTERNS:
        hit = extract(low, pattern)
        words = {w: n for w, n in K.NUMBER_WORDS.items() if w in K.COUNT_WORD.split("|")}
        found.append(F.coalesce(hit.try_cast("bigint"), lookup(hit, words).cast("bigint")))
    return F.coalesce(*found, F.lit(1).cast("bigint"))


def years_threshold(description: Column | str) -> Column:
    """Years of experience asked for, when the wording is about people."""
    low = F.lower(F.coalesce(col(description), F.lit("")))
    about = (contains_any(low, ["year", "yrs"])
             & contains_any(low, ["experience", "engineer", "personnel"]))
    return F.when(about, F.coalesce(*[extract(low, p).try_cast("double") for p in K.YEAR_PATTERNS]))


def is_qualitative(description: Column | str) -> Column:
    """Merit or certificate wording, to which no number applies."""
    low = F.lower(F.coalesce(col(description), F.lit("")))
    merit = (low.rlike(K.U + K.ISO_STANDARD) | contains_any(low, K.MERIT_WORDING)
             | low.contains("ahead of schedule")
             | (low.contains("track record") & contains_any(low, ["project", "complet"])))
    return ~contains_any(low, K.MONEY_WORDING) & merit


@reusable
def parse_threshold(description: Column | str, threshold: Column | str,
                    description_rupees: Column | str | None = None,
                    threshold_rupees: Column | str | None = None) -> Column:
    """struct<operator, value>, NULL when the criterion has no number.

    The two amounts can be passed in when the caller has them as columns.
    """
    desc, field = F.coalesce(col(description), F.lit("")), F.coalesce(col(threshold), F.lit(""))
    low = F.lower(desc)
    written = extract(field, K.OPERATOR)
    operator = F.coalesce(written, F.lit(">="))
    in_desc = rupees(description) if description_rupees is None else col(description_rupees)
    in_field = rupees(threshold) if threshold_rupees is None else col(threshold_rupees)

    def made(value: Column, op: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(op.alias("operator"), value.alias("value")))

    at_least = F.lit(">=")
    compared = extract(field, K.OPERATOR_NUMBER, 2)
    last = F.when(compared.isNotNull(), made(number(compared), extract(field, K.OPERATOR_NUMBER, 1))
                  ).otherwise(made(number(extract(field, K.ANY_NUMBER)), at_least))
    return F.when(is_qualitative(desc), F.lit(None)).otherwise(F.coalesce(
        made(years_threshold(desc), operator),
        made(F.when(in_desc > 0, in_desc), operator),
        made(extract(low, K.LOOSE_YEARS).try_cast("double"), at_least),
        made(extract(low, K.PLAIN_YEARS).try_cast("double"), at_least),
        made(F.when(in_field > 0, in_field), operator),
        last))


@reusable
def has_numeric_content(description: Column | str, threshold: Column | str,
                        description_rupees: Column | str | None = None) -> Column:
    in_desc = rupees(description) if description_rupees is None else col(description_rupees)
    return (F.coalesce(col(threshold), F.lit("")).rlike(K.U + r"\d")
            | F.coalesce(in_desc != 0, F.lit(False))
            | F.lower(F.coalesce(col(description), F.lit(""))).rlike(K.U + K.ANY_YEARS))


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    return (F.when(operator == ">=", value >= threshold).when(operator == ">", value > threshold)
            .when(operator == "<=", value <= threshold).when(operator == "<", value < threshold)
            .when(operator == "=", value == threshold).otherwise(F.lit(False)))


def is_borderline(value: Column, threshold: Column, percent: float = K.BORDERLINE_PERCENT) -> Column:
    return F.abs(value - threshold) <= threshold * (percent / 100.0)


def to_numeric(text: Column | str) -> Column:
    """Rupees when the text has them, else its first number."""
    def read(s: Column) -> Column:
        first = F.regexp_extract(F.replace(s, F.lit(","), F.lit("")), K.U + K.SIGNED_NUMBER, 0)
        return F.coalesce(rupees(s), as_double(first))
    return bind(strip(text), read)


def uses_rupees(value: Column, description: Column) -> Column:
    low = F.lower(F.coalesce(description, F.lit("")))
    about_years = low.contains("year") & low.contains("experience") & (value <= 80)
    return F.coalesce((value >= K.RUPEE_FLOOR) & ~about_years, F.lit(False))


@reusable
def evidence_value(extracted_value: Column | str, source_text: Column | str, normalized_value: Column | str,
                   rupee_first: Column | str, rupee_only: Column | str) -> Column:
    """Number an evidence row stands for, under its criterion's reading rules."""
    amount = F.when(col(rupee_first), evidence_rupees(extracted_value, source_text))
    plain = F.when(~col(rupee_only), F.coalesce(to_numeric(extracted_value), to_numeric(source_text),
                                           col(normalized_value)))
    return F.coalesce(amount, plain)
