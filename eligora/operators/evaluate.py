"""Rule verdicts for (bidder, criterion) pairs.

Shape of the plan: criteria are parsed once (few rows), evidence is joined to
them and reduced to one narrow number per row, and one aggregation with partial
states turns the numbers into facts per pair.  Verdict and explanation are a
CASE over the facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.functions import thresholds as T
from eligora.functions.money import as_rupees, rupees
from eligora.functions.text import left, whole_number
from eligora.operators.ranking import top_k
from eligora.session import sized

PAIR = ["bidder_id", "criterion_id"]


# (rows, key columns, text column) -> key columns and ``money``, as ``sources.models.money_with_model``
AmountReader = Callable[[DataFrame, list[str], str], DataFrame]


def _amounts_read(criteria: DataFrame, read: AmountReader) -> DataFrame:
    """Rupee amounts of description and threshold by a reader that may ask a model; ``id`` is unique."""
    texts = criteria.select("id", F.posexplode(F.array("description", "threshold")).alias("_field", "_text"))
    found = read(texts, ["id", "_field"], "_text").select("id", "_field", as_rupees("money").alias("_a"))
    wide = found.groupBy("id").agg(*[F.max(F.when(F.col("_field") == i, F.col("_a"))).alias(name)
                                     for i, name in enumerate(("_desc_rupees", "_field_rupees"))])
    return criteria.join(wide, "id", "left")


def prepare_criteria(criteria: DataFrame, read_amounts: AmountReader | None = None) -> DataFrame:
    """Criteria with operator, threshold, required count, reading rules, route.

    Parsed once, however often a plan uses them, and joined by exact size.  Amounts
    are read by rules, or by ``read_amounts``; evidence is always read by rules.
    """
    desc = F.coalesce("description", F.lit(""))
    amounts = _amounts_read(criteria, read_amounts) if read_amounts else criteria.select(
        "*", rupees("description").alias("_desc_rupees"), rupees("threshold").alias("_field_rupees"))
    parsed = amounts.select(
        "*", T.parse_threshold("description", "threshold", "_desc_rupees", "_field_rupees").alias("_t"),
        T.count_requirement("description").alias("required_count"),
        T.has_numeric_content("description", "threshold", "_desc_rupees").alias("_numeric"))
    flat = parsed.select(
        *[c for c in criteria.columns if c != "id"], F.col("id").alias("criterion_id"),
        F.col("_t.operator").alias("operator"), F.col("_t.value").alias("threshold_value"), "required_count",
        T.uses_rupees(F.col("_t.value"), desc).alias("rupee_first"), "_numeric")
    quantitative = (F.col("_numeric") & F.col("category").isin(K.QUANTITATIVE_CATEGORIES)
                    & F.col("threshold_value").isNotNull())
    return sized(flat.select(
        *[c for c in flat.columns if c != "_numeric"],
        (F.col("rupee_first") & (F.col("required_count") > 1)
         & (F.col("threshold_value") >= K.RUPEE_ONLY_FLOOR)).alias("rupee_only"),
        F.when(quantitative, "quantitative").otherwise("qualitative").alias("route")))


def evidence_numbers(evidence: DataFrame, prepared: DataFrame) -> DataFrame:
    """One narrow row per evidence row of a quantitative criterion.

    Evidence has bidder_id, criterion_id, ordinal, source_document,
    ocr_confidence and either a ready ``value`` or the texts to read it from.
    """
    rules = prepared.where(F.col("route") == "quantitative").select(
        "criterion_id", "operator", "threshold_value", "required_count", "rupee_first", "rupee_only")
    joined = evidence.join(rules, "criterion_id")
    value = F.col("value") if "value" in evidence.columns else T.evidence_value(
        "extracted_value", "source_text", "normalized_value", "rupee_first", "rupee_only")
    return joined.select(*PAIR, "ordinal", "source_document", "ocr_confidence", value.alias("value"),
                         "operator", "threshold_value", "required_count")


def _passes() -> Column:
    return T.compare(F.col("value"), F.col("operator"), F.col("threshold_value"))


def pair_facts(numbers: DataFrame, sources: bool = True) -> DataFrame:
    """Counts, worst OCR and best value per pair.

    Without ``sources`` all states are numbers and the aggregation hashes; the
    document of the best value makes it sort.  Both reduce before the shuffle.
    """
    low = F.col("ocr_confidence") < K.OCR_LOW
    states = [F.count("*").alias("n_evidence"), F.count("value").alias("n_values"),
              F.coalesce(F.bool_or(low), F.lit(False)).alias("low_ocr"),
              F.count_if(F.col("value").isNotNull() & _passes()).alias("n_qualifying")]
    if not sources:
        return numbers.groupBy(*PAIR).agg(*states, F.max("value").alias("best_value")).withColumn(
            "best_source", F.lit(None).cast("string"))
    best = F.struct(F.col("value"), (-F.col("ordinal")).alias("earliest"), F.col("source_document"))
    facts = numbers.groupBy(*PAIR).agg(*states, F.max(F.when(F.col("value").isNotNull(), best)).alias("_best"))
    return facts.select(*PAIR, "n_evidence", "n_values", "low_ocr", "n_qualifying",
                        F.col("_best.value").alias("best_value"),
                        F.coalesce(F.col("_best.source_document").cast("string"), F.lit("unknown"))
                        .alias("best_source"))


def qualifying_sources(numbers: DataFrame, limit: int) -> DataFrame:
    """Documents of the first ``required_count`` qualifying rows, per pair.

    ``limit`` is the largest required count in use; each task then keeps only
    that many rows per pair before the shuffle.
    """
    rows = numbers.where((F.col("required_count") > 1) & F.col("value").isNotNull() & _passes())
    firsts = top_k(rows, PAIR, [F.col("ordinal")], limit).where(F.col("rank") <= F.col("required_count"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("source_document").cast("string")
                                                             .alias("doc")))), lambda s: s["doc"])
    return firsts.groupBy(*PAIR).agg(F.array_join(names, ", ").alias("sources"))


def missed_values(numbers: DataFrame, facts: DataFrame) -> DataFrame:
    """Every value of the pairs that miss their required count, a row each.

    The child table to be stored with the verdicts: pair, ordinal, value and its
    printed form.
    """
    rows = numbers.where((F.col("required_count") > 1) & F.col("value").isNotNull())
    wanted = rows.join(facts.select(*PAIR, "n_qualifying"), PAIR).where(F.col("n_qualifying") < F.col("required_count"))
    return wanted.select(*PAIR, "ordinal", "value", whole_number("value").alias("printed"))


def listed_values(values: DataFrame) -> DataFrame:
    """The printed values of each pair in one text, for showing."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "value", "printed")))
    return values.groupBy(*PAIR).agg(F.array_join(F.transform(rows, lambda r: r["printed"]), ", ").alias("values_text"))


def no_evidence(mandatory: Column, description: Column) -> Column:
    """struct<verdict, explanation, confidence> for a pair nobody documented."""
    return F.when(F.coalesce(mandatory, F.lit(True)), F.struct(
        F.lit(K.NEEDS_REVIEW).alias("verdict"),
        F.concat(F.lit("No evidence found for: "), description,
                 F.lit(". The required documents may not have been submitted.")).alias("explanation"),
        F.lit(0.5).alias("confidence"))).otherwise(F.struct(
            F.lit(K.ELIGIBLE).alias("verdict"),
            F.concat(F.lit("Optional criterion not claimed: "), left(description, 120),
                     F.lit(". Does not affect overall eligibility.")).alias("explanation"),
            F.lit(1.0).alias("confidence")))


def _verdict(explain: bool) -> Column:
    """CASE over the facts, the criterion and the two optional texts."""
    c = F.col
    bar = F.concat(c("operator"), F.lit(" "), whole_number(c("threshold_value")))
    best = whole_number(c("best_value"))
    passes = T.compare(c("best_value"), c("operator"), c("threshold_value"))
    desc = F.coalesce("description", F.lit(""))

    def made(verdict, confidence: float, *parts) -> Column:
        text = F.lit(None).cast("string")
        if explain:
            text = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        v = verdict if isinstance(verdict, Column) else F.lit(verdict)
        return F.struct(v.alias("verdict"), text.alias("explanation"), F.lit(confidence).alias("confidence"))

    values = F.coalesce("values_text", F.lit(""))
    enough = c("n_qualifying") >= c("required_count")
    wanted, met = c("required_count").cast("string"), c("n_qualifying").cast("string")
    edge = F.when(c("best_value") == c("threshold_value"), "at").otherwise("near")
    return (
        F.when(F.coalesce(c("n_evidence"), F.lit(0)) == 0, no_evidence(c("mandatory"), desc))
        .when(c("n_values") == 0, made(
            K.NEEDS_REVIEW, 0.4, "Evidence was found for '", left(desc, 100),
            "' but no numeric value could be extracted. Manual verification needed."))
        .when((c("required_count") > 1) & enough, made(
            K.ELIGIBLE, 0.95, "Found ", met, " qualifying items meeting threshold ", bar,
            " (required: ", wanted, "). Sources: ", F.coalesce("sources", F.lit("")), "."))
        .when(c("required_count") > 1, made(
            K.NOT_ELIGIBLE, 0.95, "Only ", met, " out of ", wanted, " required items meet threshold ", bar,
            ". Values found: ", values, "."))
        .when(c("low_ocr"), made(
            K.NEEDS_REVIEW, 0.5, "Extracted value: ", best, " from ", c("best_source"),
            ". However, OCR confidence is low. Please manually verify."))
        .when(T.is_borderline(c("best_value"), c("threshold_value")), made(
            F.when(passes, K.ELIGIBLE).otherwise(K.NEEDS_REVIEW), 0.7, "Extracted value: ", best,
            ". Threshold: ", bar, ". Value is ", edge, " the threshold boundary. Source: ",
            c("best_source"), "."))
        .when(passes, made(K.ELIGIBLE, 0.95, "Extracted value: ", best, " meets threshold ", bar,
                           ". Source: ", c("best_source"), "."))
        .otherwise(made(
            K.NOT_ELIGIBLE, 0.95, "Extracted value: ", best, " does not meet threshold ", bar,
            ". Shortfall: ", whole_number(c("threshold_value") - c("best_value")), ". Source: ",
            c("best_source"), ".")))


RULE_COLUMNS = ["criterion_id", "crit_code", "description", "category", "mandatory", "operator",
                "threshold_value", "required_count"]


def quantitative_verdicts(pairs: DataFrame, prepared: DataFrame, numbers: DataFrame,
                          explain: bool = True) -> DataFrame:
    """Verdict, explanation and confidence for each pair on the rule route.

    ``pairs`` has bidder_id, criterion_id; other columns pass through.  With
    ``explain=False`` the explanation is NULL, and the source and value lists it
    needs, which take further passes over the evidence of counting criteria,
    are left out of the plan.
    """
    rules = prepared.where(F.col("route") == "quantitative").select(*RULE_COLUMNS)
    more = [c for c in pairs.columns if c not in PAIR + RULE_COLUMNS]
    facts = pair_facts(numbers, sources=explain)
    out = pairs.select(*PAIR, *more).join(rules, "criterion_id").join(facts, PAIR, "left")
    if explain:
        largest = rules.agg(F.max("required_count")).first()[0] or 1
        out = (out.join(qualifying_sources(numbers, largest), PAIR, "left")
               .join(listed_values(missed_values(numbers, facts)), PAIR, "left"))
    else:
        out = out.withColumns({"sources": F.lit(None).cast("string"), "values_text": F.lit(None).cast("string")})
    out = out.withColumn("_v", _verdict(explain))
    return out.select(*PAIR, *more, "crit_code", F.col("description").alias("crit_desc"), "category", "mandatory",
                      F.col("_v.verdict").alias("verdict"), F.col("_v.explanation").alias("explanation"),
                      F.col("_v.confidence").alias("confidence"))


def unjudged_verdicts(pairs: DataFrame, prepared: DataFrame, evidence: DataFrame, reason: str = "no model available") -> DataFrame:
    """Verdicts of the pairs on the model route where there is no model to ask.

    Every pair has a row: without evidence the fixed rule, with evidence a review
    that says why.
    """
    rules = prepared.where(F.col("route") == "qualitative").select(*RULE_COLUMNS)
    more = [c for c in pairs.columns if c not in PAIR + RULE_COLUMNS]
    held = evidence.select(*PAIR).distinct().withColumn("_has", F.lit(True))
    rows = pairs.select(*PAIR, *more).join(rules, "criterion_id").join(held, PAIR, "left")
    review = F.struct(F.lit(K.NEEDS_REVIEW).alias("verdict"), F.lit(f"Evaluation error: {reason}. Manual review required.").alias("explanation"),
                      F.lit(0.0).alias("confidence"))
    v = F.when(F.col("_has").isNull(), no_evidence(F.col("mandatory"), F.coalesce("description", F.lit("")))).otherwise(review)
    return rows.withColumn("_v", v).select(*PAIR, *more, "crit_code", F.col("description").alias("crit_desc"), "category", "mandatory", "_v.*")


def empty_corpus_verdicts(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Review verdicts for all pairs of bidders whose documents hold no text."""
    usable = chunks.select("bidder_id").distinct()
    return pairs.join(usable, "bidder_id", "left_anti").select(
        *PAIR, F.lit(K.NEEDS_REVIEW).alias("verdict"),
        F.lit("No usable text could be extracted from this bidder's documents.").alias("explanation"),
        F.lit(0.0).alias("confidence"))
