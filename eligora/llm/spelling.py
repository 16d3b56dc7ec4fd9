"""Spelling variants: near words found over a reduced alphabet, grouped under their most frequent form.

Words are runs of Latin letters (with the deletions that the counting rule asks for),
counted over all texts.  For the search every letter is hashed to one of ``SYMBOLS``
symbols.  The full one-edit neighbourhood of each reduced word (itself, all deletions,
replacements and insertions over the few symbols) is generated and joined with the
reduced vocabulary: whatever differs by one letter differs by at most one symbol.
Both words of a pair have each other in their neighbourhoods, so only the neighbours
that do not come after the reduced word (shorter, or as long and not greater) go to
the join and every pair is met once.  Pairs are verified on the original words.

The neighbourhood of a word grows with the square of its length in characters.  Pairs
whose longer word has more than ``LONG`` letters therefore meet by an equal half: two
such words share their first or their last ``LONG`` / 2 letters.

A word's form is its near word with the largest count if that is at least ``RATIO``
times its own.  Counts grow along forms, so roots are found by pointer doubling in a
few rounds however long the chains are.

Null and empty texts have no words; a null doc_id is written "null" in the deletion
rule; repeated rows count each time.  An empty table gives no rows; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligora.session import cut

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
SYMBOLS = "01234567"
DELETE_EVERY = 199
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
LONG = 64


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("doc", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("doc", F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % DELETE_EVERY == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def reduced(word: Column) -> Column:
    """The word with every letter hashed to a symbol."""
    return F.translate(word, LETTERS, "".join(SYMBOLS[(ord(c) * 0x9E3779B1 >> 24) % len(SYMBOLS)] for c in LETTERS))


def neighbourhood(word: Column) -> Column:
    """Array of the distinct strings of symbols within one edit of a reduced word."""
    size, symbols = F.char_length(word), F.array(*map(F.lit, SYMBOLS))
    head, tail = lambda i: F.substring(word, F.lit(1), i), lambda i: F.substring(word, i + 1, size)
    places = F.sequence(F.lit(0), size)
    inside = F.slice(places, F.lit(1), size)
    deleted = F.transform(inside, lambda i: F.concat(head(i), tail(i + 1)))
    replaced = F.flatten(F.transform(inside, lambda i: F.transform(symbols, lambda s: F.concat(head(i), s, tail(i + 1)))))
    inserted = F.flatten(F.transform(places, lambda i: F.transform(symbols, lambda s: F.concat(head(i), s, tail(i)))))
    return F.array_distinct(F.concat(F.array(word), deleted, replaced, inserted))


def _place(word: Column) -> Column:
    """Order of pairs: by length, reduced word and word."""
    return F.struct(F.char_length(word), reduced(word), word)


def near_pairs(vocabulary: DataFrame, long: int = LONG) -> DataFrame:
    """(u, n_u, v, n_v): every pair of words that differ by one inserted, deleted or replaced letter, once."""
    side = lambda x: (F.col("word").alias(x), F.col("n").alias(f"n_{x}"))
    short = vocabulary.where(F.char_length("word") <= long)
    own = reduced(F.col("word"))
    size = F.char_length("word")
    lower = F.filter(neighbourhood(own), lambda x: (F.char_length(x) < size) | (F.char_length(x) == size) & (x <= own))
    left = short.select(*side("u"), F.explode(F.array_distinct(F.transform(lower, lambda x: F.xxhash64(x)))).alias("key"))
    met = left.join(short.select(*side("v"), F.xxhash64(own).alias("key")), "key").where(_place(F.col("v")) < _place(F.col("u")))
    half = long // 2
    first = lambda w: F.substring(w, F.lit(1), F.lit(half))
    last = lambda w: F.substring(w, F.char_length(w) - half + 1, F.lit(half))
    at = lambda k, end, part: F.struct(k.alias("size"), F.lit(end).alias("end"), part(F.col("word")).alias("part"))
    halves = lambda sizes: F.flatten(F.transform(sizes, lambda k: F.array(at(k, 0, first), at(k, 1, last))))
    longer = vocabulary.where(size > long).select(*side("u"), F.explode(halves(F.array(size, size - 1))).alias("key"))
    others = vocabulary.where(size >= long).select(*side("v"), F.explode(halves(F.array(size))).alias("key"))
    apart = (F.col("key.end") == 0) | (first(F.col("u")) != first(F.col("v")))
    met = met.drop("key").unionByName(longer.join(others, "key").where(apart & (_place(F.col("v")) < _place(F.col("u")))).drop("key"))
    return met.where(F.levenshtein("u", "v", 1) == 1).select("u", "n_u", "v", "n_v")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) that never come back: each word's last form, by pointer doubling."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        above = state.select(F.col("word").alias("root"), F.col("root").alias("above"))
        state = cut(state.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, n, n_near (number of near words), form, form_n, root."""
    words = cut(word_counts(docs, min_letters, min_count))
    pairs = near_pairs(words)
    ways = F.array(*(F.struct(F.col(a).alias("word"), F.struct((-F.col(f"n_{b}")).alias("less"), F.col(b).alias("form")).alias("near")) for a, b in ("uv", "vu")))
    ended = pairs.select(F.explode(ways).alias("w")).select("w.*")
    best = cut(ended.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near")))
    fits = (-F.col("near.less")) >= ratio * F.col("n")
    joined = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                        F.when(fits, F.col("near.form")).alias("form"), F.when(fits, -F.col("near.less")).alias("form_n")))
    root = roots(joined.where("form is not null"))
    return joined.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))
