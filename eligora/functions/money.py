"""Money expressions.

Each rule family turns a text column into an array of candidates
``struct<amount, currency, confidence, method>``; the families are concatenated
in a fixed order, noise is filtered, and the best candidate is picked with
``array_max`` over a sortable struct.  All of it is built-in expressions: one
narrow projection, no shuffle, no Python.  Every family sits behind a cheap
substring test so that texts without such amounts never reach a regex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.functions.text import (
    as_double, bind, col, contains_any, lookup, number, reusable, strip,
)

MONEY_TYPE = "struct<amount:double,currency:string,confidence:double,method:string>"
LIST_TYPE = f"array<{MONEY_TYPE}>"


def _money(amount: Column, currency: Column | str, confidence: Column | float,
           method: Column | str) -> Column:
    def as_col(x):
        return x if isinstance(x, Column) else F.lit(x)
    return F.struct(amount.alias("amount"), as_col(currency).alias("currency"),
                    as_col(confidence).alias("confidence"), as_col(method).alias("method"))


def _gate(test: Column, candidates: Column) -> Column:
    return F.when(test, candidates).otherwise(F.array().cast(LIST_TYPE))


# -- number shapes -----------------------------------------------------------

def grouped_number(c: Column | str) -> Column:
    """10,00,000 and 10,000,000 alike; NULL when the text is no such number."""
    s = F.regexp_replace(strip(c), "[   ]", "")
    return F.when(s.rlike(r"^[0-9,]+(\.[0-9]+)?$"), number(s))


def euro_number(c: Column | str) -> Column:
    """1.234,56 with a decimal comma of one or two digits."""
    s = F.regexp_replace(strip(c), "[  ]", "")
    whole = F.regexp_extract(s, r"^(.*),([0-9]{1,2})$", 1)
    decimals = F.regexp_extract(s, r"^(.*),([0-9]{1,2})$", 2)
    return F.when(decimals != "", F.concat(F.replace(whole, F.lit("."), F.lit("")), F.lit("."), decimals)
                  .try_cast("double"))


def signed_token(c: Column | str) -> Column:
    """Accounting parentheses and leading signs: struct<token, sign>."""
    s = strip(c)
    inner = F.regexp_extract(s, r"^\((.*)\)$", 1)
    wrapped = s.rlike(r"^\(.*\)$")
    body = F.when(wrapped, strip(inner)).otherwise(s)
    minus = body.startswith("-")
    token = F.when(minus | body.startswith("+"), strip(F.substr(body, F.lit(2)))).otherwise(body)
    sign = F.when(wrapped, -1).otherwise(1) * F.when(minus, -1).otherwise(1)
    return F.struct(token.alias("token"), sign.alias("sign"))


def currency_code(tag: Column | str) -> Column:
    """Known spellings to ISO codes; any other three letters are taken as a code."""
    t = F.rtrim(F.lower(strip(tag)), F.lit("."))
    return F.coalesce(lookup(t, K.CURRENCY_TAGS), F.when(t.rlike(r"^\p{L}{3}$"), F.upper(t)))


# -- rule families -----------------------------------------------------------

def rupee_candidates(text: Column, low: Column) -> Column:
    units = ((K.CRORE_WORD, K.CRORE, "cr"), (K.LAKH_WORD, K.LAKH, "lc"))
    # a rule whose letters are not there is not tried; its candidate is NULL as without a match
    has = {"cr": F.contains(low, F.lit("cr")), "lc": contains_any(low, ["lakh", "lac"])}

    def within(unit: str, pattern: str) -> Column:
        return F.when(has[unit], F.regexp_extract(low, pattern, 1))

    rules = []
    for prefix, sign, label in ((r"rs\.?", "rs", "inr_digit"), ("₹", "₹", "inr_sym"), ("inr", "inr", "inr_iso")):
        for word, factor, unit in units:
            text_of = F.when(F.contains(low, F.lit(sign)), within(unit, K.U + prefix + K.MARKED_NUMBER + word))
            amount = number(text_of) * factor
            rules.append(_money(amount, "INR", K.CONF_SCALED_INR, f"{label}_{unit}"))
    for (word, factor, unit), conf in zip(units, (K.CONF_BEFORE_CRORE, K.CONF_BEFORE_LAKH)):
        amount = number(within(unit, K.U + K.NUMBER_THEN_SCALE + word)) * factor
        rules.append(_money(amount, "INR", conf, f"inr_scale_before_{unit}"))
    values = {w: float(n) for w, n in K.NUMBER_WORDS.items()}
    for word, factor, unit in units:
        spelt = within(unit, rf"{K.U}\b({K.WORD_NUMBER})\s+{word}")
        rules.append(_money(lookup(spelt, values) * factor, "INR", K.CONF_WORDS, "inr_word_scale"))
    for word, factor, unit in units:
        amount = number(within(unit, K.U + K.BARE_NUMBER + word)) * factor
        rules.append(_money(amount, "INR", K.CONF_BARE, f"bare_{unit}"))

    def marked(pattern: str, label: str) -> Column:
        def read(raw: Column) -> Column:
            commas = F.contains(raw, F.lit(","))
            return _money(number(raw), "INR",
                          F.when(commas, F.lit(K.CONF_COMMA)).otherwise(F.lit(K.CONF_PLAIN)),
                          F.when(commas, F.lit(f"{label}_comma")).otherwise(F.lit(f"{label}_plain")))
        return F.transform(F.array(F.regexp_extract(low, K.U + pattern, 1)), read)

    grouped = F.array(_money(number(F.regexp_extract(text, K.U + K.GROUPED_AMOUNT, 1)), "INR",
                             K.CONF_GROUPED, "inr_grouped_ctx"))
    return F.concat(
        _gate(has["cr"] | has["lc"], F.array(*rules)),
        _gate(F.contains(low, F.lit("rs")), marked(K.RS_AMOUNT, "inr_rs")),
        _gate(F.contains(low, F.lit("₹")), marked(K.RUPEE_SIGN_AMOUNT, "inr_sym")),
        _gate(F.contains(text, F.lit(",")) & contains_any(low, K.RUPEE_CUES), grouped),
    )


def euro_decimal_candidates(text: Column) -> Column:
    def read(hit: Column) -> Column:
        tag = F.upper(hit)
        code = (F.when(tag.contains("EUR") | tag.contains("€"), "EUR")
                .when(tag.contains("US") | tag.contains("$"), "USD")
                .when(tag.contains("GBP") | tag.contains("£"), "GBP")
                .when(tag.contains("CHF"), "CHF").when(tag.contains("INR"), "INR").otherwise("EUR"))
        digits = F.regexp_extract(hit, r"^([0-9.,]+)", 1)
        amount = F.translate(F.replace(digits, F.lit("."), F.lit("")), ",", ".").try_cast("double")
        return _money(amount, code, K.CONF_EURO_DECIMAL, "eu_decimal")
    hits = F.regexp_extract_all(text, F.lit(K.U + K.EURO_DECIMAL), F.lit(0))
    return _gate(F.contains(text, F.lit(",")), F.transform(hits, read))


def english_scale_candidates(text: Column, low: Column) -> Column:
    def scaled(hit: Column, pattern: str, amount_at: int, scale_at: int) -> Column:
        scale = lookup(F.lower(F.regexp_extract(hit, K.U + pattern, scale_at)), K.ENGLISH_SCALES)
        return number(F.regexp_extract(hit, K.U + pattern, amount_at)) * scale

    def leading(hit: Column) -> Column:
        code = F.upper(F.substring(hit, 1, 3))
        return _money(scaled(hit, K.ISO_SCALED, 2, 3), code, K.CONF_ISO_SCALED,
                      F.concat(F.lit("eng_scale_"), F.lower(code)))

    def dollars(hit: Column) -> Column:
        return _money(scaled(hit, K.DOLLAR_SCALED, 1, 2), "USD", K.CONF_DOLLAR_SCALED, "usd_scale")

    def trailing(hit: Column) -> Column:
        code = F.upper(F.right(hit, F.lit(3)))
        return _money(scaled(hit, K.SCALED_ISO, 1, 2), code, K.CONF_SCALED_ISO,
                      F.concat(F.lit("eng_scale_trail_"), F.lower(code)))

    found = [F.transform(F.regexp_extract_all(text, F.lit(K.U + p), F.lit(0)), f)
             for p, f in ((K.ISO_SCALED, leading), (K.DOLLAR_SCALED, dollars), (K.SCALED_ISO, trailing))]
    return _gate(contains_any(low, ["illion", "thousand"]), F.concat(*found))


def spaced_thousands_candidates(text: Column, low: Column) -> Column:
    def read(hit: Column) -> Column:
        digits = F.regexp_extract(hit, K.U + K.SPACED_THOUSANDS, 2)
        amount = F.replace(digits, F.lit(" "), F.lit("")).try_cast("double")
        return _money(amount, F.upper(F.substring(hit, 1, 3)), K.CONF_SPACED, "space_thousands")
    hits = F.regexp_extract_all(text, F.lit(K.U + K.SPACED_THOUSANDS), F.lit(0))
    return _gate(contains_any(low, ["usd", "eur", "gbp", "chf", "inr", "aud", "cad"]), F.transform(hits, read))


def inferred_currency(text: Column) -> Column:
    def read(up: Column) -> Column:
        dollars = (F.contains(up, F.lit("US")) & up.rlike(r"\bUSD\b|\bUS\$\b")) | (text.contains("$") & ~text.rlike(r"[0-9]+%"))
        return (F.when(contains_any(up, ["INR", "RUPEE", "RS.", "₹"]) | (F.contains(up, F.lit(" RS ")) & F.contains(strip(up), F.lit(" RS "))), "INR")
                .when(dollars, "USD")
                .when(contains_any(up, ["EUR", "€"]), "EUR").when(contains_any(up, ["GBP", "£"]), "GBP")
                .when(up.contains("CHF"), "CHF").when(contains_any(up, ["JPY", "¥"]), "JPY"))
    return bind(F.upper(text), read)


def retail_number(part: Column) -> Column:
    """First number not followed by a per cent sign.

    The last separator is the decimal one unless exactly three digits follow it.
    """
    run = F.regexp_extract(part, r"([0-9][0-9\s.,]*)(?:[^%0-9]|$)", 1)
    tidy = F.regexp_replace(run, r"\s+|[\s.,]+$", "")
    point = F.regexp_replace(tidy, r"[.,]([0-9]{1,2}|[0-9]{4,})$", "p$1")
    return as_double(F.translate(point, "p,.", "."))


def retail_candidates(text: Column) -> Column:
    """Everyday price strings, in the whole text and in each of its lines and
    ';' or '|' segments: one number each, its currency taken from the wording."""
    def read(method: str):
        def price(part: Column) -> Column:
            raw = F.struct(retail_number(part).alias("amount"), inferred_currency(part).alias("code"))
            return bind(raw, lambda r: _money(
                r["amount"], F.coalesce(r["code"], F.lit(K.UNKNOWN_CURRENCY)),
                F.when(r["code"].isNull(), F.lit(K.CONF_RETAIL_UNKNOWN)).otherwise(F.lit(K.CONF_RETAIL)), method))
        return price
    segments = F.filter(F.transform(F.split(text, "[\n;|]"), strip),
                        lambda s: (F.length(s) >= 3) & s.rlike("[0-9]"))
    whole = F.transform(F.array(strip(text)), read("price_parser"))
    # A single segment would only repeat the whole text's number.
    each = _gate(contains_any(text, ["\n", ";", "|"]), F.transform(segments, read("price_parser_seg")))
    return _gate(text.rlike("[0-9]"), F.concat(whole, each))


# -- noise, duplicates, ambiguity -------------------------------------------

def is_experience_only(low: Column) -> Column:
    return contains_any(low, ["year", "yrs"]) & ~contains_any(low, K.EXPERIENCE_MONEY_CUES)


def drop_noise(candidates: Column, text: Column, low: Column) -> Column:
    """Amounts above zero that are not fiscal years, bare percentages, or retail
    hits in experience wording.  The text is looked at once."""
    seen = F.struct(
        (contains_any(text, ["-", "–"]) & text.rlike(K.U + K.YEAR_RANGE) | contains_any(low, ["fy", "f.y"]) & low.rlike(K.U + K.FISCAL_YEAR)
         | low.contains("financial year")).alias("years"),
        (text.contains("%") & text.rlike(K.U + K.PERCENTAGE) & ~contains_any(low, ["rs", "inr"])
         & ~text.contains("$")).alias("percents"),
        is_experience_only(low).alias("experience"))

    def keep(c: Column, about: Column) -> Column:
        whole = c["amount"] == F.floor(c["amount"])
        retail = c["method"].startswith("price_parser")
        year_like = retail & whole & c["amount"].between(K.FIRST_YEAR, K.LAST_YEAR)
        noise = ((retail & about["experience"]) | (year_like & about["years"])
                 | (whole & (c["amount"] > 0) & (c["amount"] <= 100) & about["percents"]))
        return ((c["amount"] > 0) | ((c["method"] == "usd_scale") & c["amount"].isNotNull())) & ~noise
    return bind(seen, lambda about: F.filter(candidates, lambda c: keep(c, about)))


@reusable
def money_candidates(text: Column | str) -> Column:
    """All candidates of a text in rule order, noise removed.

    The text, which may be an expression, and its lower case are worked out once.
    """
    def found(t: Column, low: Column) -> Column:
        return drop_noise(F.concat(rupee_candidates(t, low), euro_decimal_candidates(t), english_scale_candidates(t, low),
                                   spaced_thousands_candidates(t, low), retail_candidates(t)), t, low)

    # Each rule needs a digit or a crore/lakh word, so other texts stop here.
    return bind(F.coalesce(col(text), F.lit("")), lambda t: _gate(
        t.rlike("[0-9]|(?i:crore|cr|lakh|lac)"), bind(F.lower(t), lambda low: found(t, low))))


def distinct_candidates(candidates: Column) -> Column:
    """Best confidence per (currency, amount to four places), earliest on ties."""
    keyed = F.array_sort(F.transform(candidates, lambda c, i: F.struct(
        c["currency"].alias("currency"), F.round(c["amount"], 4).alias("key"),
        (-c["confidence"]).alias("worst"), i.alias("i"), c.alias("c"))))

    def firsts(sorted_list: Column) -> Column:
        """Rows that differ from the one before them."""
        def new(x: Column, i: Column) -> Column:
            before = F.get(sorted_list, i - 1)
            return (i == 0) | (x["currency"] != before["currency"]) | (x["key"] != before["key"])
        return F.filter(sorted_list, new)
    kept = F.transform(bind(keyed, firsts), lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c")))
    return F.transform(F.array_sort(kept), lambda x: x["c"])


def is_ambiguous(candidates: Column) -> Column:
    """Among the five surest: two currencies, or different amounts within 5x."""
    def ranked(found: Column) -> Column:
        return F.array_sort(F.transform(distinct_candidates(found), lambda c, i: F.struct(
            (-c["confidence"]).alias("worst"), i.alias("i"), c.alias("c"))))

    def unclear(top: Column) -> Column:
        codes = F.array_distinct(F.filter(F.transform(top, lambda x: x["c"]["currency"]),
                                          lambda c: c != K.UNKNOWN_CURRENCY))
        amounts = F.array_distinct(F.transform(top, lambda x: F.round(x["c"]["amount"], 4)))
        ratio = F.array_max(amounts) / F.greatest(F.array_min(amounts), F.lit(1e-9))
        return F.coalesce((F.size(codes) >= 2)
                          | ((F.size(amounts) >= 2) & (ratio < K.MONEY_AMBIGUITY_RATIO)), F.lit(False))
    # a single candidate is not sorted
    return bind(candidates, lambda found: F.when(F.size(found) < 2, F.lit(False)).otherwise(
        bind(F.slice(ranked(found), 1, 5), unclear)))


def needs_model(candidates: Column, confidence: float = K.MONEY_MODEL_CONFIDENCE) -> Column:
    """Rows whose rules are unsure enough to ask a model, when one is in use."""
    best = F.array_max(F.transform(candidates, lambda c: c["confidence"]))
    return (F.coalesce(best, F.lit(0.0)) < confidence) | is_ambiguous(candidates)


def pick_best(candidates: Column, default: str = "INR", prefer: str | None = "INR") -> Column:
    """Highest confidence with a boost for the preferred currency, then amount."""
    preferred = prefer or default

    def ranked(c: Column, i: Column) -> Column:
        unknown = c["currency"] == K.UNKNOWN_CURRENCY
        code = F.when(unknown, F.lit(default)).otherwise(c["currency"])
        conf = F.when(unknown, c["confidence"] * K.DEFAULT_CURRENCY_FACTOR).otherwise(c["confidence"])
        boost = F.when(code == preferred, F.lit(K.PREFERRED_BOOST)).otherwise(F.lit(0.0))
        large = F.when((code == preferred) & (c["amount"] >= K.LARGE_AMOUNT),
                       F.lit(K.LARGE_BOOST)).otherwise(F.lit(0.0))
        return F.struct((conf + boost + large).alias("score"), F.round(c["amount"], 4).alias("size"),
                        (-i).alias("earliest"), _money(c["amount"], code, conf, c["method"]).alias("money"))
    return F.array_max(F.transform(candidates, ranked))["money"]


@reusable
def parse_money(text: Column | str, default: str = "INR", prefer: str | None = "INR") -> Column:
    """Best single amount of a text as a struct, NULL when it has none."""
    return pick_best(money_candidates(text), default, prefer)


def amounts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows of the texts that have an amount, with its four columns.

    An explode, so that the amount is worked out once per row: a filter on it
    or a use of several of its fields cannot repeat the parsing.
    """
    return df.select(*keys, F.inline(F.array_compact(F.array(parse_money(text)))))


@reusable
def rupees(text: Column | str) -> Column:
    """The amount when the best candidate is in rupees; no exchange rates."""
    return bind(parse_money(text), as_rupees)


def as_rupees(money: Column | str) -> Column:
    m = col(money)
    return F.when(m["currency"] == "INR", m["amount"])


@reusable
def evidence_rupees(extracted_value: Column | str, source_text: Column | str) -> Column:
    blank = F.lit("")
    return rupees(F.concat_ws(" ", F.coalesce(col(extracted_value), blank), F.coalesce(col(source_text), blank)))


def model_money(reply: Column) -> Column:
    """A model's {amount, currency, confidence} reply as a candidate."""
    amount = reply["amount"].try_cast("double")
    raw = F.upper(F.coalesce(reply["currency"], F.lit("INR")))
    code = F.when(F.length(raw) == 3, raw).otherwise(F.coalesce(currency_code(raw), F.lit("INR")))
    conf = F.coalesce(F.nullif(reply["confidence"].try_cast("double"), F.lit(0.0)), F.lit(0.5))
    money = _money(amount, code, F.least(F.lit(0.9), F.greatest(F.lit(0.4), conf)), "llm_disambiguate")
    return F.when(amount > 0, money)
