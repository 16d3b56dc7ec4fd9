"""Line dedup by content-defined chunks of lines; DataFrame functions only.

Every line is hashed.  A polynomial rolling hash over the hashes of the last
``WINDOW`` lines decides after which line a chunk may end; it does end there if at
least ``MIN_LINES`` lines that hold a word stand between this place and the one before
where it might have ended.  So boundaries depend on the lines around them alone, come
back after lines put in or taken out, and no chunk inside a text is a single line.  A
chunk with at least ``MIN_LINES`` lines that hold a word is looked up in all
documents; those whose bytes equal the first occurrence (smallest doc_id, text
hash, place) are taken out of every other place, in other documents and in the
same one.

Only hashes are counted over the corpus; texts move for documents with a repeated
hash (for the byte comparison) and once for the result.  A hot chunk is one row
per task after partial aggregation, and the joins on it have one row on one side,
so that AQE may split the other.

Null texts stay null and empty ones empty.  Rows that repeat both doc_id and text
are one document: all keep the same text.  Null doc_ids come before all others.
Extra columns pass through; n_chars, where there is one, is counted anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligora.llm.names import fresh

WINDOW = 2
DIVISOR = 2
MIN_LINES = 2
_PRIME = (1 << 31) - 1
_BASE = 1_103_515_245


def _worded(line: Column) -> Column:
    return line.rlike("[^ \\t-\\r]")


def chunk_spans(lines: Column, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> Column:
    """Array of (k, start, size): the chunks of an array of lines."""
    marked = F.transform(lines, lambda x: F.struct(F.pmod(F.xxhash64(x), F.lit(_PRIME)).alias("h"), _worded(x).alias("worded")))

    def ends(m: Column) -> Column:
        def possible(i: Column) -> Column:
            rolled = F.lit(0).cast("long")
            for back in range(window - 1, -1, -1):
                rolled = (rolled * _BASE + F.coalesce(F.get(m, i - back)["h"], F.lit(0))) % _PRIME
            return (F.shiftright(rolled, 7) % divisor == 0) | (i == F.size(m) - 1)

        places = F.filter(F.sequence(F.lit(0), F.size(m) - 1), possible)
        before = lambda p, k: F.when(k == 0, F.lit(-1)).otherwise(F.get(p, k - 1))
        enough = lambda p, i, k: F.size(F.filter(F.slice(m, before(p, k) + 2, i - before(p, k)), lambda x: x["worded"])) >= min_lines
        kept = lambda p: F.filter(p, lambda i, k: (i == F.size(m) - 1) | enough(p, i, k))
        return F.get(F.transform(F.array(places), kept), F.lit(0))

    cut = F.get(F.transform(F.array(marked), ends), F.lit(0))
    start = lambda e, k: F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1) + 1)
    spans = lambda e: F.transform(e, lambda end, k: F.struct(k.alias("k"), start(e, k).alias("start"), (end - start(e, k) + 1).alias("size")))
    return F.get(F.transform(F.array(cut), spans), F.lit(0))


def _text(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, span["start"] + 1, span["size"]), "\n")


def chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, keep: tuple[str, ...] = (), min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, text_hash, k, chunk (the text), n_lines (lines with a word) and the ``keep`` columns for each chunk of each text."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"), *keep).where("lines is not null")
    spans = lines.select("doc_id", "text_hash", "lines", *keep, F.explode(chunk_spans(F.col("lines"), window, divisor, min_lines)).alias("s"))
    own = F.slice("lines", F.col("s.start") + 1, F.col("s.size"))
    return spans.select("doc_id", "text_hash", F.col("s.k").alias("k"), F.array_join(own, "\n").alias("chunk"), F.size(F.filter(own, _worded)).alias("n_lines"), *keep)


def repeated_chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, text_hash, k) of every chunk whose bytes have occurred before."""
    docs = docs.select("doc_id", "text")
    whole = lambda d, keep=(): chunks(d, window, divisor, keep, min_lines).where(F.col("n_lines") >= min_lines).withColumn("hash", F.xxhash64("chunk"))
    place = F.struct("doc_id", "text_hash", "k")
    firsts = whole(docs).groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hash", "first")
    repeated = whole(docs).select("doc_id", "text_hash", "k", "hash").join(firsts, "hash", "left_semi")
    suspects = repeated.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set("k").alias("_ks"))
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    met = keyed.join(suspects, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")))
    held = whole(met, ("_ks",)).where(F.array_contains("_ks", F.col("k"))).select("hash", place.alias("place"), "chunk").join(firsts, "hash")
    original = held.where(F.col("place") == F.col("first")).select("hash", F.col("chunk").alias("original")).dropDuplicates(["hash"])
    copies = held.where(F.col("place") != F.col("first")).join(original, "hash")
    return copies.where(F.col("chunk") == F.col("original")).select("place.*")


def without_repeats(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``; all its columns, in their order."""
    gone_doc, gone_hash, gone_ks, own_hash, changed = fresh(docs.columns, "gone_doc", "gone_hash", "gone_ks", "own_hash", "changed")
    gone = repeated_chunks(docs, window, divisor, min_lines).groupBy(F.col("doc_id").alias(gone_doc), F.col("text_hash").alias(gone_hash)).agg(F.collect_set("k").alias(gone_ks))
    marked = docs.withColumn(own_hash, F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col(gone_doc)) & (F.col(own_hash) == F.col(gone_hash)), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(chunk_spans(lines, window, divisor, min_lines), lambda s: ~F.array_contains(gone_ks, s["k"]))
    rest = F.array_join(F.transform(kept, lambda s: _text(lines, s)), "\n")
    text = F.when(F.col(gone_ks).isNull(), F.col("text")).otherwise(rest)
    # the new text is made once; its length is taken from the column, not from the expression again
    new = marked.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], text.alias("text"), F.col(gone_ks).isNotNull().alias(changed))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(changed), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])
