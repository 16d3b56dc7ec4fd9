"""URL filter: host and path rules, and logistic regression on hashed character n-grams.

DataFrame, SQL and ML-pipeline functions only.  A rule fits its host and all
subdomains where the path starts with the rule's path; the longest one decides.
Every other url goes to the regression, which is trained on a small table of
labelled urls given by the caller (``LABELLED`` by default) and scores host and
path, without query and fragment.

The result has one row per input row and moves no data: the regression has a fixed
number of weights.  Null urls and urls without ``://`` have an empty host and path,
fit no rule and are judged by the regression's constant.
"""

from __future__ import annotations

from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = (3, 4, 5)
BUCKETS = 1 << 14
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hosts of the default labelled table; each is combined with every frame below.
BLOCKED_HOSTS = ("spam-mill", "spamlinks", "casino-royal", "bestcasino", "adult-video", "adultchat", "ads-network", "popads", "cheap-pills", "cheapwatches", "free-coins",
                 "getfreegifts", "poker-bonus", "betting-odds", "viagra-shop", "porn-tube", "xxx-cams", "payday-loan", "click-bait", "win-prize", "malware-drop", "phishing-login",
                 "ads-server", "track-pixel", "adtrack", "free-money", "freebets", "bets-today", "link-farm", "casino-online", "adult-dating", "adult-xx",
                 "online-casino", "my-casino", "adultpics", "adult-fun", "the-spam", "spamtown", "deals-cheap", "tube-porn", "track-ads", "big-bets")
ALLOWED_HOSTS = ("library", "university", "museum", "history", "science", "weather", "gardening", "recipes", "physics", "mathematics", "newsroom", "citycouncil", "hospital", "orchestra",
                 "railway", "astronomy", "poetry", "school", "archive", "research", "wikipages", "journal", "theatre", "harbour", "mountain", "thornton", "tanning", "enthern", "attending",
                 "nations", "other", "rethink", "hering", "shandon", "ingrid", "andes", "thistle", "strength", "southern", "eastern", "westhaven", "northend", "theron", "athens", "lathe", "methane", "honest", "harvest", "village", "botanic", "sailing", "chess", "cookery", "language")
FRAMES = ("http://{}.example.com/en/100", "https://www.{}.example.net/fr/7/", "https://blog.{}.example.org/de/2345.html", "http://m.{}.example.net/es/678")
LABELLED = [(frame.format(host), label) for label, hosts in ((1.0, BLOCKED_HOSTS), (0.0, ALLOWED_HOSTS)) for host, frame in product(hosts, FRAMES)]


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def host_and_path(df: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path of the column ``url``."""
    rest = _after_scheme(F.col("url"))
    return (df.withColumn("host", F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER))
            .withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)))


def _fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def deciding_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, as columns over host and path; rules are (verdict, host and path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = _fits(host.lower(), slash + path)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def _grams(df: DataFrame) -> DataFrame:
    """Adds the character n-grams of host and path, told apart by a mark; the digits of the path count as one."""
    def of(text: Column, mark: str) -> list[Column]:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        return [F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(framed) - n + 1, F.lit(1))), lambda i, n=n: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n)))) for n in SIZES]

    path = F.regexp_replace(F.lower("path"), "[0-9]+", "0")
    return df.withColumn("_grams", F.concat(*of(F.col("host"), "h"), *of(path, "p")))


def train(labelled: DataFrame) -> PipelineModel:
    """Regression on (url, label), label 1 for urls to block."""
    grams = _grams(host_and_path(labelled.where("url is not null and label is not null")))
    hashing = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_grams", outputCol="_features")
    regression = LogisticRegression(featuresCol="_features", labelCol="label", predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw", regParam=0.01, maxIter=60)
    return PipelineModel([hashing, regression.fit(hashing.transform(grams))])


def default_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED, "url string, label double")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict ("allow" or "block") and the regression's probability of block."""
    model = train(labelled if labelled is not None else default_labels(pages.sparkSession))
    rule, verdict = deciding_rule(rules)
    scored = model.transform(_grams(host_and_path(pages.select("page_id", F.col("url").cast("string")))))
    block = vector_to_array("_probability")[1]
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(block >= threshold, "block").otherwise("allow")).alias("verdict"), block.alias("score"))
