"""Merging near-duplicate criteria.

The rule is order dependent: a criterion joins the first kept one that it
resembles, else it is kept.  Here equal texts are folded by aggregation first,
likely pairs come from shared trigrams (an exact filter): within a scope of few
texts pair by pair (``pairs_in_scope``), beyond that by an equi-join on rare ones
(``candidate_pairs``).  Only those are compared, and the kept ones follow from rounds
over the resulting edges.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from eligora import constants as K
from eligora.functions.text import bind, left, strip
from eligora.operators.ranking import rank_all
from eligora.session import cut

GRAM = 3
# Two texts, one of which is this short, differ by two characters at most.
SHORT_TEXT = 10
# A scope of at most so many texts and characters is one row, whose pairs are listed.
SCOPE_TEXTS, SCOPE_CHARS = 64, 1 << 16


@F.pandas_udf(T.StringType())
def _compatibility_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t) if t and not t.isascii() else t)


def normal_description(c: Column | str) -> Column:
    """Compatibility form, lower case, punctuation to blanks, single blanks."""
    s = F.lower(_compatibility_form(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    s = F.regexp_replace(s, r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


@F.pandas_udf(T.BooleanType())
def _alike(later: pd.Series, earlier: pd.Series) -> pd.Series:
    return pd.Series([a in b or b in a or SequenceMatcher(None, a, b).ratio() >= K.SIMILARITY
                      for a, b in zip(later, earlier)], dtype=bool)


def _grams(norm: Column, n: int) -> Column:
    last = F.length(norm) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(norm, i, F.lit(n)))
                  ).otherwise(F.array().cast("array<string>"))


def _deletions(norm: Column) -> Column:
    """The text and all it becomes by dropping one or two characters."""
    def drop(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(
            F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    once = drop(norm)
    return F.array_distinct(F.concat(F.array(norm), once, F.flatten(F.transform(once, drop))))


def candidate_pairs(texts: DataFrame, scope: str) -> DataFrame:
    """Pairs (later, earlier) of one scope that may be alike; none is missed.

    Similar texts: ratio r over S characters in all leaves (1-r)S unmatched, so
    the matching blocks number at most (1-r)S + 1 and share at least
    (5r/2 - 2)S - 2 trigrams, counting repeats.  Each text therefore only needs
    its rarest trigrams as join keys, all but that number plus one.  Texts too
    short for this differ by two characters at most and are joined on what is
    left after dropping up to two.  Contained texts: the rarest trigram of the
    shorter one occurs in the longer one.
    """
    r, width = K.SIMILARITY, F.length("norm")
    sized = texts.select(scope, "ord", "norm", width.alias("len"))
    tokens = sized.select(scope, "ord", "len", F.explode(_grams(F.col("norm"), GRAM)).alias("gram"))
    freq = tokens.groupBy(scope, "gram").agg(F.count("*").alias("freq"))
    counted = (tokens.groupBy(scope, "ord", "len", "gram").agg(F.count("*").alias("times"))
               .join(freq, [scope, "gram"]))
    # A repeated trigram counts as (gram, 1), (gram, 2), ...
    listed = counted.groupBy(scope, "ord", "len").agg(F.array_sort(F.flatten(F.collect_list(F.transform(
        F.sequence(F.lit(1), F.col("times").cast("int")),
        lambda t: F.struct(F.col("freq").alias("freq"), F.col("gram").alias("gram"), t.alias("t"))))))
        .alias("rarest"))
    smallest_sum = F.col("len") * (2 / (2 - r))
    sure = F.ceil((2.5 * r - 2) * smallest_sum - 2 - 1e-9)
    keyed = listed.select(
        scope, "ord", "len", F.explode(F.slice("rarest", F.lit(1), F.greatest(
            F.size("rarest") - F.greatest(sure, F.lit(1)) + 1, F.lit(1)).cast("int"))).alias("k"))
    keyed = keyed.select(scope, "ord", "len", F.concat_ws("\u0001", "k.gram", F.col("k.t").cast("string")).alias("key"))
    short = sized.where(F.col("len") <= SHORT_TEXT).select(
        scope, "ord", "len", F.explode(_deletions(F.col("norm"))).alias("key"))

    def alike_keys(keys: DataFrame) -> DataFrame:
        a = keys.select(scope, "key", F.col("ord").alias("later"), F.col("len").alias("la"))
        b = keys.select(scope, "key", F.col("ord").alias("earlier"), F.col("len").alias("lb"))
        near = (F.least("la", "lb") + 1e-9) * (2 - r) >= F.greatest("la", "lb") * r
        return a.join(b, [scope, "key"]).where((F.col("earlier") < F.col("later")) & near)

    rare = sized.where(F.col("len") < GRAM).select(scope, "ord", "len", F.col("norm").alias("gram")).unionByName(
        listed.select(scope, "ord", "len", F.col("rarest")[0]["gram"].alias("gram")))
    pieces = sized.select(scope, F.col("ord").alias("whole"), F.col("len").alias("whole_len"), F.explode(
        F.array_distinct(F.concat(*[_grams(F.col("norm"), n) for n in range(1, GRAM + 1)]))).alias("gram"))
    inside = rare.join(pieces, [scope, "gram"]).where(
        (F.col("len") <= F.col("whole_len")) & (F.col("ord") != F.col("whole"))).select(
        scope, F.greatest("ord", "whole").alias("later"), F.least("ord", "whole").alias("earlier"))
    pairs = [alike_keys(k).select(scope, "later", "earlier") for k in (keyed, short)]
    return reduce(DataFrame.unionByName, pairs, inside).distinct()


def pairs_in_scope(scopes: DataFrame, scope: str) -> DataFrame:
    """Pairs (later, earlier) with their texts ``_a``, ``_b`` that may be alike, from a row of texts per scope; none is missed.

    The trigrams of ``candidate_pairs`` without their repeats, which add no more than
    the repeats of the text that has fewer.
    """
    def prepared(t: Column) -> Column:
        grams = _grams(t["norm"], GRAM)
        return F.struct(t["ord"].alias("ord"), t["norm"].alias("norm"), F.length(t["norm"]).alias("len"),
                        F.array_distinct(grams).alias("grams"), (F.size(grams) - F.size(F.array_distinct(grams))).alias("repeats"))

    def maybe(x: Column, y: Column) -> Column:
        r, total = K.SIMILARITY, x["len"] + y["len"]
        near = (F.least(x["len"], y["len"]) + 1e-9) * (2 - r) >= F.greatest(x["len"], y["len"]) * r
        shared = F.size(F.array_intersect(x["grams"], y["grams"])) + F.least(x["repeats"], y["repeats"])
        return F.contains(x["norm"], y["norm"]) | F.contains(y["norm"], x["norm"]) | (near & (shared >= total * (2.5 * r - 2) - 2 - 1e-9))

    def pairs(texts: Column) -> Column:
        return F.flatten(F.transform(texts, lambda x, i: F.transform(
            F.filter(F.slice(texts, F.lit(1), i), lambda y: maybe(x, y)),
            lambda y: F.struct(x["ord"].alias("later"), y["ord"].alias("earlier"), x["norm"].alias("_a"), y["norm"].alias("_b")))))
    return scopes.select(scope, F.inline(bind(F.transform(F.array_sort("_t"), prepared), pairs)))


def alike_edges(texts: DataFrame, scope: str, most_texts: int = SCOPE_TEXTS, most_chars: int = SCOPE_CHARS) -> DataFrame:
    """Pairs of texts of one scope that are alike; a large scope never stands in one row."""
    held = texts.groupBy(scope).agg(F.count("*").alias("_n"), F.sum(F.length("norm")).alias("_c"))
    few = (F.col("_n") <= most_texts) & (F.col("_c") <= most_chars)
    large = cut(held.where(~few).select(scope))
    only_small = large.isEmpty()
    rest = texts if only_small else texts.join(large, scope, "left_anti")
    rows = rest.groupBy(scope).agg(F.collect_list(F.struct("ord", "norm")).alias("_t")).where(F.size("_t") > 1)
    edges = pairs_in_scope(rows, scope).where(_alike("_a", "_b")).select(scope, "later", "earlier")
    if only_small:
        return edges
    return edges.unionByName(_joined_edges(texts.join(large, scope, "left_semi"), scope))


def _joined_edges(texts: DataFrame, scope: str) -> DataFrame:
    later = texts.select(scope, F.col("ord").alias("later"), F.col("norm").alias("_a"))
    earlier = texts.select(scope, F.col("ord").alias("earlier"), F.col("norm").alias("_b"))
    pairs = candidate_pairs(texts, scope).join(later, [scope, "later"]).join(earlier, [scope, "earlier"])
    return pairs.where(_alike("_a", "_b")).select(scope, "later", "earlier")


def kept_first(texts: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """(scope, ord, root): the kept text each text belongs to.

    A text is kept once all earlier ones it resembles are known not to be, and
    dropped once one of them is kept; both are settled in rounds.
    """
    edges = cut(edges)
    unsettled, kept = cut(texts.select(scope, "ord")), None
    open_edges = edges
    while not unsettled.isEmpty():
        waiting = open_edges.select(scope, F.col("later").alias("ord")).distinct()
        new = cut(unsettled.join(waiting, [scope, "ord"], "left_anti"))
        kept = new if kept is None else kept.unionByName(new)
        dropped = open_edges.join(new.withColumnRenamed("ord", "earlier"), [scope, "earlier"], "left_semi").select(
            scope, F.col("later").alias("ord")).distinct()
        unsettled = cut(unsettled.join(new.unionByName(dropped), [scope, "ord"], "left_anti"))
        for side in ("later", "earlier"):
            open_edges = open_edges.join(unsettled.withColumnRenamed("ord", side), [scope, side], "left_semi")
        open_edges = cut(open_edges)
    if kept is None:
        return texts.select(scope, "ord", F.col("ord").alias("root"))
    joined = (edges.join(kept.withColumnRenamed("ord", "earlier"), [scope, "earlier"], "left_semi")
              .groupBy(scope, F.col("later").alias("ord")).agg(F.min("earlier").alias("root")))
    dropped = joined.join(kept, [scope, "ord"], "left_anti")
    return kept.withColumn("root", F.col("ord")).unionByName(dropped)


def join_sections(first: Column, others: Column) -> Column:
    """"a; b" of section names, leaving out what is contained already."""
    def step(kept: Column, other: Column) -> Column:
        a, b = strip(F.coalesce(kept, F.lit(""))), strip(F.coalesce(other, F.lit("")))
        both = (a != "") & (b != "")
        return (F.when(both & (a == b), kept).when(both & F.contains(b, a), b)
                .when(both & ~F.contains(a, b), left(F.concat(a, F.lit("; "), b), K.SECTION_CHARS))
                .when(~both & (F.length(b) > F.length(a)), other).otherwise(kept))
    return F.aggregate(others, first, step)


def merge_similar(criteria: DataFrame, scope: str = "tender_id") -> DataFrame:
    """One row per distinct criterion of each scope, renumbered in order.

    ``criteria`` has ``scope``, ord (unique position within the scope),
    description, category, mandatory, threshold, expected_evidence,
    source_section.  The longest evidence and threshold texts win, sections are
    joined, everything else comes from the first of the similar ones.
    """
    normal = cut(criteria.select("*", normal_description("description").alias("norm")))
    blank = normal.where(F.col("norm") == "").withColumn("root", F.col("ord"))
    texts = cut(normal.where(F.col("norm") != "").groupBy(scope, "norm").agg(F.min("ord").alias("ord")))
    roots = kept_first(texts, alike_edges(texts, scope), scope)
    rooted = texts.join(roots, [scope, "ord"]).select(scope, "norm", "root")
    full = normal.join(rooted, [scope, "norm"]).unionByName(blank)

    def longest(name: str) -> Column:
        value = F.coalesce(F.col(name), F.lit(""))
        return F.max(F.struct(F.length(strip(value)).alias("n"), (-F.col("ord")).alias("o"), value.alias("v")))["v"]
    sections = (full.where(F.col("ord") != F.col("root")).groupBy(scope, "root", strip("source_section").alias("_s"))
                .agg(F.min(F.struct("ord", "source_section")).alias("_m"))
                .groupBy(scope, "root").agg(F.array_sort(F.collect_list("_m")).alias("_others")))
    best = full.groupBy(scope, "root").agg(longest("expected_evidence").alias("expected_evidence"),
                                           longest("threshold").alias("threshold"),
                                           F.count("*").alias("merged"))
    heads = full.where(F.col("ord") == F.col("root")).select(
        scope, "root", "description", "category", "mandatory", F.col("source_section").alias("_first"))
    out = heads.join(best, [scope, "root"]).join(sections, [scope, "root"], "left")
    names = F.coalesce(F.transform("_others", lambda m: m["source_section"]), F.array().cast("array<string>"))
    out = out.withColumn("source_section", join_sections(F.col("_first"), names)).drop("_first", "_others")
    ranked = rank_all(out, [scope], [F.col("root")], "position")
    return ranked.select(scope, F.format_string(K.CRITERION_CODE_FORMAT, F.col("position")).alias("crit_code"),
                         "description", "category", "mandatory", "threshold", "expected_evidence",
                         "source_section", F.col("root").alias("ord"), "merged")
