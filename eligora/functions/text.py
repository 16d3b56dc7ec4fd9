"""Text expressions: keywords, chunk maths, safe text, names, file types.

Everything here is a JVM-side ``Column``; nothing calls Python per row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from eligora import constants as K


def reusable(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the expression built for given column names.

    Large expressions take a noticeable time to put together from Python; they
    are immutable, so one per application and set of names will do.
    """
    made: dict[tuple, Column] = {}

    @wraps(build)
    def call(*args):
        if any(isinstance(a, Column) for a in args):
            return build(*args)
        key = (SparkContext._active_spark_context.applicationId, *args)
        if key not in made:
            made[key] = build(*args)
        return made[key]
    return call


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.regexp_replace(col(c), K.U + r"^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    return ~F.coalesce(col(c), F.lit("")).rlike(K.U + r"\S")


def non_empty(c: Column | str) -> Column:
    """``regexp_extract`` gives '' for no match; make that NULL."""
    return F.nullif(col(c), F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _unless_empty(value: Column, body: Callable[[Column], Column] | None = None) -> Column:
    """``body`` over a text that is worked out once, NULL for an empty one."""
    held = F.filter(F.array(value), lambda v: v != "")
    return F.get(F.transform(held, body) if body else held, F.lit(0))


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    return _unless_empty(F.regexp_extract(col(c), K.U + pattern, group))


def as_double(c: Column) -> Column:
    """To DOUBLE, NULL when it is no number.  An empty text is not cast: a failed cast costs an exception."""
    return _unless_empty(c, lambda v: v.try_cast("double"))


def number(c: Column) -> Column:
    """Digits with thousands commas to DOUBLE; NULL when it is no number."""
    return as_double(F.replace(c, F.lit(","), F.lit("")))


def contains_any(c: Column, needles: list[str]) -> Column:
    """Whether one of the needles occurs; a search for bytes each, which costs a fraction of a pattern of alternatives."""
    return reduce(Column.__or__, [F.contains(c, F.lit(n)) for n in needles])


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def fixed_array(values: list) -> Column:
    return F.expr(f"array({', '.join(map(_literal, values))})")


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table, NULL for an unknown key."""
    pairs = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


# -- keywords ----------------------------------------------------------------

def keywords(text: Column | str) -> Column:
    """Distinct meaningful tokens: no stopwords, three letters up or digits."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))),
                                  F.lit(K.KEYWORD_TOKEN), F.lit(0))
    kept = F.array_except(tokens, fixed_array(K.STOPWORDS))
    return F.filter(kept, lambda t: (F.length(t) >= 3) | t.rlike("^[0-9]+$"))


def criterion_keywords(description: Column | str = "description",
                       expected_evidence: Column | str = "expected_evidence",
                       threshold: Column | str = "threshold") -> Column:
    parts = [F.coalesce(col(c), F.lit("")) for c in (description, expected_evidence, threshold)]
    return keywords(F.concat_ws(" ", *parts))


def keyword_score(text: Column | str, words: Column | str) -> Column:
    """Number of distinct keywords found anywhere in the text, as substrings."""
    return keyword_score_low(F.lower(F.coalesce(col(text), F.lit(""))), words)


def keyword_score_low(low: Column | str, words: Column | str) -> Column:
    """The same for text already in lower case, which is then lowered once per
    row instead of once per keyword."""
    return F.size(F.filter(col(words), lambda w: F.contains(col(low), w)))


def criterion_query_text(description: Column | str = "description",
                         threshold: Column | str = "threshold",
                         expected_evidence: Column | str = "expected_evidence",
                         category: Column | str = "category") -> Column:
    parts = [non_empty(c) for c in (description, threshold, expected_evidence, category)]
    return strip(F.concat_ws("\n", *parts))


# -- chunking ----------------------------------------------------------------

def chunk_starts(text: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Zero-based start offsets of the overlapping chunks of a stripped text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    stride = size - overlap
    extra = F.greatest(F.ceil((F.length(text) - size) / stride), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), extra), lambda i: i * stride)


# -- report text -------------------------------------------------------------

def safe_text(c: Column | str) -> Column:
    """Typographic characters to ASCII; whatever Latin-1 lacks becomes '?'."""
    out = col(c)
    for char, plain in K.SAFE_TEXT.items():
        out = F.replace(out, F.lit(char), F.lit(plain))
    return F.regexp_replace(out, "[^\\x{00}-\\x{FF}]", "?")


def html_escape(c: Column | str) -> Column:
    out = col(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def path_safe(c: Column | str, spaces: bool = True) -> Column:
    return F.translate(col(c), "/\\ " if spaces else "/\\", "___" if spaces else "__")


def display_time(c: Column | str) -> Column:
    return F.date_format(col(c), K.REPORT_TIME_FORMAT)


def left(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def short_name(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.length(c) > K.REPORT_NAME_CHARS,
                  F.concat(left(c, K.REPORT_NAME_CHARS), F.lit("..."))).otherwise(c)


def whole_number(c: Column) -> Column:
    """Thousands commas and no decimals, as explanations print amounts."""
    return F.format_number(c, 0)


def title_label(verdict: Column | str) -> Column:
    return F.initcap(F.replace(F.lower(col(verdict)), F.lit("_"), F.lit(" ")))


def badge(verdict: Column | str) -> Column:
    v = col(verdict)
    return (F.when(v == K.ELIGIBLE, "ELIGIBLE").when(v == K.NOT_ELIGIBLE, "NOT ELIGIBLE")
            .otherwise("NEEDS REVIEW"))


def verdict_icon(verdict: Column | str) -> Column:
    v = col(verdict)
    return F.when(v == K.ELIGIBLE, "✅").when(v == K.NOT_ELIGIBLE, "❌").otherwise("⚠️")


def report_mark(verdict: Column | str) -> Column:
    v = col(verdict)
    return (F.when(v == K.ELIGIBLE, F.struct(F.lit("✓").alias("mark"), F.lit("pass").alias("style")))
            .when(v == K.NOT_ELIGIBLE, F.struct(F.lit("✗").alias("mark"), F.lit("fail").alias("style")))
            .otherwise(F.struct(F.lit("◆").alias("mark"), F.lit("review").alias("style"))))


# -- files and flags ---------------------------------------------------------

def file_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def file_type(path: Column | str) -> Column:
    """Kind of file by its (lower-cased) extension; dot-files have none."""
    ext = F.lower(F.regexp_extract(file_name(path), r"^\.*[^.].*(\.[^.]*)$", 1))
    return F.coalesce(lookup(ext, K.FILE_TYPES), F.lit("unknown"))


def flag(c: Column | str, default: bool) -> Column:
    """Environment-style switch: on unless spelt off, or off unless spelt on."""
    value = F.lower(F.trim(col(c)))
    if default:
        return ~F.coalesce(value, F.lit("1")).isin(K.FALSE_WORDS)
    return F.coalesce(value, F.lit("0")).isin(K.TRUE_WORDS)


def fill_template(template: str, **values: Column) -> Column:
    """Put columns into the ``{name}`` slots of a prompt text, in given order."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
