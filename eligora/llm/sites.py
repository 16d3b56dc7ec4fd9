"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on measures of the whole text gives each document's own
evidence.  Its host and its path within the host give a prior: with good(x) the
sum of labels, or of the regression's probabilities where there is no label, over
the n(x) other documents of x,

    host:  (good(h) + k_h * global) / (n(h) + k_h)
    path:  (good(p) + k_p * host)   / (n(p) + k_p)

so that sites with few documents shrink to the level above.  The strengths k are
estimated by moments from how much sites differ beyond chance.  The posterior's
log-odds are the evidence plus those of the path less the global ones.

The regression learns from at most ``max_labelled`` labelled documents (beyond it
those with the smallest hashes of their id); all sums cover all documents and are
grouped aggregations with partial sums, so a host with a third of all rows is one
row per task.  A document never counts for its own prior.

Null and empty texts are judged on measures of 0; null hosts or paths are one site
of that name; without labels of both kinds the evidence is 0 and every prior the
global one.  Rows that repeat a doc_id get the label of that id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligora.llm.rules import measures
from eligora.llm.toxicity import fit_logistic, fold
from eligora.session import cut

MAX_LABELLED = 100_000


def features() -> list[Column]:
    """Shape of a text, each between 0 and about 1."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    letters = F.col("n_upper") + F.col("n_lower")
    return [F.least(share("n_symbols", "n_words"), F.lit(1.0)), F.least(share("n_marks", "n_words"), F.lit(1.0)), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
            F.coalesce(F.try_divide(F.col("n_upper").cast("double"), letters), F.lit(0.0)), 1 - share("n_ended_lines", "n_lines"), share("n_digits", "word_chars"),
            share("n_distinct_words", "n_words"), F.exp(-F.col("n_words") / 20.0), F.lit(1.0)]


def strength(sites: DataFrame, n: str, good: str, prior: Column) -> float:
    """Prior weight by moments: prior variance over the variance between sites beyond that of sampling."""
    mean = F.col(good) / F.col(n)
    row = sites.where(F.col(n) > 1).agg(F.sum(F.col(n) * (mean - prior) ** 2), F.sum(prior * (1 - prior)), F.sum(F.col(n) * prior * (1 - prior)), F.count("*")).first()
    if not row[3] or not row[1]:
        return 10.0
    between = max(row[0] - row[1], 1e-9) / max(row[2], 1e-9)
    return float(np.clip(1 / between - 1, 1.0, 1e4))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, evidence, prior, score and predicted for every document; labels of fold 0 are not used."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").cast("double").alias("_label")).where(fold("_id") != 0)
    sites = docs.select("doc_id", "text", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path"))
    seen = measures(sites, ("_host", "_path")).select("doc_id", "_host", "_path", *[c.cast("double").alias(f"f{k}") for k, c in enumerate(features())])
    rows = cut(seen.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id"))
    n = known.count()
    part = min(1.0, max_labelled / max(n, 1))
    names = [f"f{k}" for k in range(len(features()))]
    sample = rows.where(F.col("_label").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * part))).select("_label", *names).toArrow().to_pandas()
    if sample["_label"].nunique() == 2:
        weights = fit_logistic(sample[names].to_numpy(), sample["_label"].to_numpy(), ridge=1.0)
        evidence = sum((F.col(c) * float(w) for c, w in zip(names, weights)), F.lit(0.0))
    else:
        evidence = F.lit(0.0)
    soft = rows.select("doc_id", "_host", "_path", evidence.alias("evidence"), F.coalesce("_label", 1 / (1 + F.exp(-evidence))).alias("good"))
    paths = cut(soft.groupBy("_host", "_path").agg(F.count("*").alias("n_path"), F.sum("good").alias("good_path")))
    hosts = cut(paths.groupBy("_host").agg(F.sum("n_path").alias("n_host"), F.sum("good_path").alias("good_host")))
    total = hosts.agg(F.sum("n_host"), F.sum("good_host")).first()
    overall = F.lit(float(np.clip((total[1] or 0.5) / (total[0] or 1), 0.01, 0.99)))
    k_host = strength(hosts, "n_host", "good_host", overall)
    k_path = strength(paths.join(hosts, "_host"), "n_path", "good_path", F.greatest(F.least(F.col("good_host") / F.col("n_host"), F.lit(0.99)), F.lit(0.01)))
    joined = soft.join(paths.join(hosts, "_host"), ["_host", "_path"])
    at_host = (F.col("good_host") - F.col("good") + k_host * overall) / (F.col("n_host") - 1 + k_host)
    at_path = (F.col("good_path") - F.col("good") + k_path * at_host) / (F.col("n_path") - 1 + k_path)
    prior = F.greatest(F.least(at_path, F.lit(0.999)), F.lit(0.001))
    odds = F.col("evidence") + F.log(F.col("prior") / (1 - F.col("prior"))) - F.log(overall / (1 - overall))
    scored = joined.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "evidence", prior.alias("prior")).withColumn("score", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
