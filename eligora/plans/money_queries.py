"""Amounts of money, thresholds and counts read from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.functions import money as M
from eligora.functions import text as X
from eligora.functions import thresholds as T
from eligora.plans import domain as D
from eligora.session import spread

# Tasks per piece of a scan of orders or parts: a piece of 128 MB holds some millions of rows.
SHARES = 16
WORDS = ["two", "thirteen", "twenty-five", "ninety", "hundred"]


def _amount_text() -> Column:
    """Order totals written in twelve ways."""
    p = F.format_number("o_totalprice", 2)
    small = F.format_number(F.col("o_totalprice") / 10000, 1)
    whole = F.format_number("o_totalprice", 0)
    k = F.pmod("o_orderkey", F.lit(89)).cast("string")
    word = F.get(X.fixed_array(WORDS), F.pmod("o_custkey", F.lit(len(WORDS))).cast("int"))
    c = F.concat
    ways = [
        c(F.lit("EMD Rs. "), p, F.lit("/- only")),
        c(F.lit("Performance bond USD "), small, F.lit(" million")),
        c(F.lit("Turnover not less than "), word, F.lit(" crore rupees")),
        c(F.lit("Quoted at "), F.translate(p, ",.", ".,"), F.lit(" EUR net")),
        c(F.lit("Turnover aggregated "), small, F.lit(" crores INR")),
        c(F.lit("Bank draft $"), p, F.lit(" for fees")),
        c(F.lit("Tax audit for F.Y. 2023-24 scored "), k, F.lit("%")),
        c(F.lit("minimum "), k, F.lit(" years of civil engineering experience")),
        c(F.lit("Equipment EUR "), F.translate(whole, ",", " "), F.lit(".50 all inclusive")),
        c(F.lit("Paid ₹ "), p, F.lit(" and later "), small, F.lit(" lakhs")),
        c(F.lit("Bond for "), small, F.lit(" thousand GBP; copy | fee "), k, F.lit("\nRs "), whole),
        c(F.lit("Total "), whole, F.lit(" due, or $ "), small, F.lit(" billion, ref 12,50 CHF"))]
    way, out = F.pmod("o_orderkey", F.lit(len(ways))), F.lit(None).cast("string")
    for i, text in enumerate(ways):
        out = text if i == 0 else F.when(way == i, text).otherwise(out)
    return out


def order_texts(spark: SparkSession, sf: str) -> DataFrame:
    orders = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return spread(orders, "o_orderkey", shares=SHARES).select("o_orderkey", _amount_text().alias("t"))


def money_best(spark: SparkSession, sf: str) -> DataFrame:
    best = order_texts(spark, sf).select("o_orderkey", M.parse_money("t").alias("m"))
    return best.select("o_orderkey", F.round("m.amount", 4).alias("amount"), F.col("m.currency").alias("currency"),
                       F.round("m.confidence", 4).alias("confidence"), F.col("m.method").alias("method"),
                       F.round(M.as_rupees("m"), 4).alias("rupees"))


def money_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = order_texts(spark, sf).select("o_orderkey", F.inline(M.distinct_candidates(M.money_candidates("t"))))
    return found.select("o_orderkey", F.round("amount", 4).alias("amount"), "currency", "confidence", "method")


def money_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Which texts are ambiguous, and which would be shown to a model."""
    found = order_texts(spark, sf).select("o_orderkey", M.money_candidates("t").alias("c"))
    return found.select("o_orderkey", M.is_ambiguous(F.col("c")).alias("ambiguous"),
                        M.needs_model(F.col("c")).alias("ask_model"))


def money_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Best amount of each whole document."""
    docs = spread(D.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return M.amounts(docs, ["doc_id"], "text").select("doc_id", "amount", "currency", "method")


def money_by_currency(spark: SparkSession, sf: str) -> DataFrame:
    return M.amounts(order_texts(spark, sf), [], "t").groupBy("currency", "method").agg(
        F.count("*").alias("texts"), F.max(F.round("amount", 2)).alias("largest"))


def number_shapes(spark: SparkSession, sf: str) -> DataFrame:
    p = F.format_number("o_totalprice", 2)
    tag = F.get(X.fixed_array(["Rs.", "US$", "€", "abc", "yen", "no"]), F.pmod("o_custkey", F.lit(6)).cast("int"))
    signed = M.signed_token(F.concat(F.lit("(-"), p, F.lit(")")))
    orders = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return spread(orders, "o_orderkey", shares=SHARES).select(
        "o_orderkey", M.grouped_number(F.concat(F.lit(" "), p)).alias("grouped"),
        M.euro_number(F.translate(p, ",.", ".,")).alias("euro"), signed["token"].alias("token"),
        signed["sign"].alias("sign"), M.currency_code(tag).alias("currency"),
        M.inferred_currency(F.concat(F.lit("pay "), tag, F.lit(" 5"))).alias("inferred"))


def _criteria(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as criteria: eleven wordings, six threshold fields."""
    k, n = F.col("p_size").cast("string"), F.format_number(F.col("p_retailprice") * 100, 0)
    word = F.get(X.fixed_array(["one", "two", "three", "nine", "ten"]), F.pmod("p_size", F.lit(5)).cast("int"))
    c = F.concat
    descriptions = [
        c(F.lit("At least "), word, F.lit(" similar works, each of value not less than Rs. "), n, F.lit("/-")),
        c(F.lit("An engineer with minimum "), k, F.lit(" years of experience")),
        c(F.lit("ISO 9001 certificate, copy "), k),
        c(F.lit("ISO 14001:2015 is desirable, up to "), k, F.lit(" marks")),
        c(F.lit("Three ("), k, F.lit(") completed projects")),
        c(F.lit("Annual turnover of "), k, F.lit(" crore")),
        c(F.lit("Track record of completing projects in "), k, F.lit(" months")),
        c(k, F.lit(" or more similar works delivered")),
        c(F.lit("Firm active for at least "), k, F.lit("  yrs")),
        c(F.lit("Minimum of "), word, F.lit(" depots")),
        c(F.lit("Registered office in the region"))]
    thresholds = [F.lit(""), c(F.lit(">= "), n), c(F.lit("<="), k, F.lit(".5")), c(F.lit("Rs. "), k, F.lit(" lakh")),
                  c(F.lit("about "), k), c(F.lit("= "), k, F.lit(",000"))]

    def pick(options: list[Column], at: Column) -> Column:
        out = options[0]
        for i, o in enumerate(options[1:], 1):
            out = F.when(at == i, o).otherwise(out)
        return out
    category = F.get(X.fixed_array(K.ALL_CATEGORIES), F.pmod("p_partkey", F.lit(5)).cast("int"))
    parts = D.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return spread(parts, "p_partkey", shares=SHARES).select(
        "p_partkey", pick(descriptions, F.pmod("p_partkey", F.lit(11))).alias("description"),
        pick(thresholds, F.pmod(F.floor(F.col("p_partkey") / 11), F.lit(6))).alias("threshold"), category.alias("category"))


def count_requirement(spark: SparkSession, sf: str) -> DataFrame:
    return _criteria(spark, sf).select("p_partkey", T.count_requirement("description").alias("required_count"),
                                       T.years_threshold("description").alias("years"),
                                       T.is_qualitative("description").alias("qualitative"))


def threshold_parse(spark: SparkSession, sf: str) -> DataFrame:
    staged = _criteria(spark, sf).select("*", M.rupees("description").alias("_d"), M.rupees("threshold").alias("_f"))
    parsed = staged.select("p_partkey", T.parse_threshold("description", "threshold", "_d", "_f").alias("t"),
                           T.has_numeric_content("description", "threshold", "_d").alias("numeric"))
    return parsed.select("p_partkey", F.col("t.operator").alias("operator"),
                         F.round("t.value", 2).alias("value"), "numeric")


def compare_values(spark: SparkSession, sf: str) -> DataFrame:
    op = F.get(X.fixed_array([">=", ">", "<=", "<", "=", "!"]), F.pmod("l_partkey", F.lit(6)).cast("int"))
    lineitem = D.table(spark, sf, "lineitem")
    return lineitem.select(
        op.alias("operator"), T.compare(F.col("l_quantity"), op, F.lit(25.0)).alias("passes"),
        T.is_borderline(F.col("l_quantity"), F.lit(25.0)).alias("borderline")).groupBy(
        "operator", "passes", "borderline").agg(F.count("*").alias("rows"))


def numeric_reading(spark: SparkSession, sf: str) -> DataFrame:
    """First number or rupee amount of an evidence text."""
    text = F.concat(F.get(X.fixed_array(["", "Rs. ", "-", "ISO ", "about "]), F.pmod("o_orderkey", F.lit(5)).cast("int")),
                    F.format_number("o_totalprice", 2), F.get(X.fixed_array(["", " lakh", " years"]),
                                                              F.pmod("o_custkey", F.lit(3)).cast("int")))
    orders = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return spread(orders, "o_orderkey", shares=SHARES).select("o_orderkey", text.alias("x")).select(
        "o_orderkey", F.round(T.to_numeric("x"), 2).alias("value"))


# -- the same in SQL ---------------------------------------------------------

_P, _S, _W = "format('{:,.2f}', o_totalprice)", "format('{:,.1f}', o_totalprice / 10000)", "format('{:,.0f}', o_totalprice)"
_K = "(o_orderkey % 89)"
_WORD = "['two','thirteen','twenty-five','ninety','hundred'][o_custkey % 5 + 1]"
_TEXTS = f"""texts AS (SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 0 THEN 'EMD Rs. ' || {_P} || '/- only'
 WHEN 1 THEN 'Performance bond USD ' || {_S} || ' million' WHEN 2 THEN 'Turnover not less than ' || {_WORD} || ' crore rupees'
 WHEN 3 THEN 'Quoted at ' || translate({_P}, ',.', '.,') || ' EUR net'
 WHEN 4 THEN 'Turnover aggregated ' || {_S} || ' crores INR' WHEN 5 THEN 'Bank draft $' || {_P} || ' for fees'
 WHEN 6 THEN 'Tax audit for F.Y. 2023-24 scored ' || {_K} || '%'
 WHEN 7 THEN 'minimum ' || {_K} || ' years of civil engineering experience'
 WHEN 8 THEN 'Equipment EUR ' || replace({_W}, ',', ' ') || '.50 all inclusive'
 WHEN 9 THEN 'Paid ₹ ' || {_P} || ' and later ' || {_S} || ' lakhs'
 WHEN 10 THEN 'Bond for ' || {_S} || ' thousand GBP; copy | fee ' || {_K} || chr(10) || 'Rs ' || {_W}
 ELSE 'Total ' || {_W} || ' due, or $ ' || {_S} || ' billion, ref 12,50 CHF' END AS t FROM orders)"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# best amount of each id among the rows of a table like ``named``
BEST_SQL = """SELECT * FROM {} QUALIFY row_number() OVER (PARTITION BY id ORDER BY
  round(confidence + CASE WHEN currency = 'INR' THEN 0.08 ELSE 0 END
    + CASE WHEN currency = 'INR' AND amount >= 1000000 THEN 0.02 ELSE 0 END, 9) DESC, round(amount, 4) DESC, ord) = 1"""


def money_sql(texts: str) -> str:
    """CTEs kept(id, amount, currency, confidence, method, ord) and best from
    texts(id, t), written rule by rule with rows instead of arrays."""
    num = "try_cast(replace({}, ',', '') AS DOUBLE)"
    words = "CASE {} " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in K.NUMBER_WORDS.items()) + " END"
    scales = "CASE lower({}) " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in K.ENGLISH_SCALES.items()) + " END"
    rules, order = [], 0

    def single(source: str, pattern: str, value: str, factor: float, conf: str, method: str, where: str = "TRUE"):
        nonlocal order
        order += 1
        hit = f"regexp_extract({source}, {_q(pattern)}, 1)"
        rules.append(f"SELECT id, {value.format(hit)} * {factor} AS amount, 'INR' AS currency, {conf.format(hit)} AS confidence, "
                     f"{method.format(hit)} AS method, {order * 1000000}::BIGINT AS ord FROM low WHERE {where}")

    units = ((K.CRORE_WORD, K.CRORE, "cr"), (K.LAKH_WORD, K.LAKH, "lc"))
    for prefix, label in ((r"rs\.?", "inr_digit"), ("₹", "inr_sym"), ("inr", "inr_iso")):
        for word, f, u in units:
            single("l", prefix + K.MARKED_NUMBER + word, num, f, "0.93", _q(f"{label}_{u}"))
    for (word, f, u), conf in zip(units, ("0.9", "0.89")):
        single("l", K.NUMBER_THEN_SCALE + word, num, f, conf, _q(f"inr_scale_before_{u}"))
    for word, f, u in units:
        single("l", rf"\b({K.WORD_NUMBER})\s+{word}", words, f, "0.93", "'inr_word_scale'")
    for word, f, u in units:
        single("l", K.BARE_NUMBER + word, num, f, "0.88", _q(f"bare_{u}"))
    for pattern, label in ((K.RS_AMOUNT, "inr_rs"), (K.RUPEE_SIGN_AMOUNT, "inr_sym")):
        single("l", pattern, num, 1, "CASE WHEN contains({}, ',') THEN 0.9 ELSE 0.85 END",
               f"CASE WHEN contains({{}}, ',') THEN '{label}_comma' ELSE '{label}_plain' END")
    single("t", K.GROUPED_AMOUNT, num, 1, "0.82", "'inr_grouped_ctx'",
           "(" + " OR ".join(f"contains(l, '{w}')" for w in K.RUPEE_CUES) + ")")

    def many(pattern: str, amount: str, currency: str, conf: float, method: str):
        nonlocal order
        order += 1
        rules.append(f"SELECT id, {amount} AS amount, {currency} AS currency, {conf} AS confidence, {method} AS method, "
                     f"{order * 1000000} + i AS ord FROM (SELECT id, i, regexp_extract_all(t, {_q(pattern)})[i] AS h FROM low, "
                     f"UNNEST(range(1, len(regexp_extract_all(t, {_q(pattern)})) + 1)) AS u(i))")

    def group(pattern: str, n: int) -> str:
        return f"regexp_extract(h, {_q(pattern)}, {n})"
    many(K.EURO_DECIMAL, "try_cast(replace(replace(regexp_extract(h, '^([0-9.,]+)', 1), '.', ''), ',', '.') AS DOUBLE)",
         "CASE WHEN upper(h) LIKE '%EUR%' OR h LIKE '%€%' THEN 'EUR' WHEN upper(h) LIKE '%US%' OR h LIKE '%$%' THEN 'USD' "
         "WHEN upper(h) LIKE '%GBP%' OR h LIKE '%£%' THEN 'GBP' WHEN upper(h) LIKE '%CHF%' THEN 'CHF' "
         "WHEN upper(h) LIKE '%INR%' THEN 'INR' ELSE 'EUR' END", 0.84, "'eu_decimal'")
    for pattern, a, s, code, conf, method in (
            (K.ISO_SCALED, 2, 3, "upper(left(h, 3))", 0.86, "'eng_scale_' || lower(left(h, 3))"),
            (K.DOLLAR_SCALED, 1, 2, "'USD'", 0.84, "'usd_scale'"),
            (K.SCALED_ISO, 1, 2, "upper(right(h, 3))", 0.85, "'eng_scale_trail_' || lower(right(h, 3))")):
        many(pattern, f"{num.format(group(pattern, a))} * {scales.format(group(pattern, s))}", code, conf, method)
    many(K.SPACED_THOUSANDS, f"try_cast(replace({group(K.SPACED_THOUSANDS, 2)}, ' ', '') AS DOUBLE)",
         "upper(left(h, 3))", 0.8, "'space_thousands'")

    def retail(source: str, method: str, at: str) -> str:
        run = f"regexp_replace(regexp_extract({source}, '([0-9][0-9\\s.,]*)(?:[^%0-9]|$)', 1), '\\s+|[\\s.,]+$', '', 'g')"
        point = f"regexp_replace({run}, '[.,]([0-9]{{1,2}}|[0-9]{{4,}})$', 'p\\1')"
        amount = f"try_cast(replace(replace(replace({point}, ',', ''), '.', ''), 'p', '.') AS DOUBLE)"
        u = f"upper({source})"
        cur = (f"CASE WHEN {u} LIKE '%INR%' OR {u} LIKE '%RUPEE%' OR {u} LIKE '%RS.%' OR {u} LIKE '% RS %' OR {u} LIKE '%₹%' "
               f"THEN 'INR' WHEN regexp_matches({u}, '\\bUSD\\b|\\bUS\\$\\b') OR ({u} LIKE '%$%' AND NOT "
               f"regexp_matches({u}, '[0-9]+%')) THEN 'USD' WHEN {u} LIKE '%EUR%' OR {u} LIKE '%€%' THEN 'EUR' "
               f"WHEN {u} LIKE '%GBP%' OR {u} LIKE '%£%' THEN 'GBP' WHEN {u} LIKE '%CHF%' THEN 'CHF' "
               f"WHEN {u} LIKE '%JPY%' OR {u} LIKE '%¥%' THEN 'JPY' END")
        return (f"SELECT id, {amount} AS amount, coalesce({cur}, 'XXX') AS currency, CASE WHEN {cur} IS NULL THEN 0.55 "
                f"ELSE 0.72 END AS confidence, '{method}' AS method, {at} AS ord FROM ")
    trim = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    rules.append(retail("s", "price_parser", "90000000") + f"(SELECT id, {trim.format('t')} AS s FROM low)")
    rules.append(retail("s", "price_parser_seg", "91000000 + i") + "(SELECT id, i, "
                 + trim.format("string_split_regex(t, '[\\n;|]')[i]") + " AS s FROM low, "
                 "UNNEST(range(1, len(string_split_regex(t, '[\\n;|]')) + 1)) AS u(i)) WHERE length(s) >= 3")
    cues = " OR ".join(f"contains(l, {_q(c)})" for c in K.EXPERIENCE_MONEY_CUES)
    return f"""{texts}, low AS (SELECT id, t, lower(t) AS l FROM texts),
about AS (SELECT id, regexp_matches(l, {_q(K.FISCAL_YEAR)}) OR contains(l, 'financial year') OR regexp_matches(t, {_q(K.YEAR_RANGE)})
    AS years, regexp_matches(t, {_q(K.PERCENTAGE)}) AND NOT contains(l, 'rs') AND NOT contains(l, 'inr') AND NOT contains(t, '$')
    AS percents, (contains(l, 'year') OR contains(l, 'yrs')) AND NOT ({cues}) AS experience FROM low),
found AS ({' UNION ALL '.join(rules)}),
clean AS (SELECT f.* FROM found f JOIN about USING (id) WHERE amount > 0
  AND NOT (method LIKE 'price_parser%' AND experience)
  AND NOT (method LIKE 'price_parser%' AND amount BETWEEN 1980 AND 2100 AND amount = floor(amount) AND years)
  AND NOT (amount <= 100 AND amount = floor(amount) AND percents)),
kept AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY id, currency, round(amount, 4)
  ORDER BY confidence DESC, ord) = 1),
named AS (SELECT id, amount, CASE currency WHEN 'XXX' THEN 'INR' ELSE currency END AS currency,
  CASE currency WHEN 'XXX' THEN confidence * 0.9 ELSE confidence END::DOUBLE AS confidence, method, ord FROM kept),
best AS ({BEST_SQL.format('named')})"""


_MONEY = MONEY_SQL = "WITH " + money_sql(_TEXTS)
# ids with ``c`` the surest confidence and ``x`` whether the surest five are ambiguous
GATE_SQL = """top AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY id
        ORDER BY confidence DESC, ord) <= 5), a AS (SELECT id, max(confidence) AS c,
        count(DISTINCT CASE WHEN currency <> 'XXX' THEN currency END) >= 2 OR (count(DISTINCT round(amount, 4)) >= 2
        AND max(round(amount, 4)) / min(round(amount, 4)) < 5) AS x FROM top GROUP BY id)"""
_CRIT = """crit AS (SELECT p_partkey AS id, CASE p_partkey % 11
 WHEN 0 THEN 'At least ' || w || ' similar works, each of value not less than Rs. ' || n || '/-'
 WHEN 1 THEN 'An engineer with minimum ' || p_size || ' years of experience' WHEN 2 THEN 'ISO 9001 certificate, copy ' || p_size
 WHEN 3 THEN 'ISO 14001:2015 is desirable, up to ' || p_size || ' marks' WHEN 4 THEN 'Three (' || p_size || ') completed projects'
 WHEN 5 THEN 'Annual turnover of ' || p_size || ' crore'
 WHEN 6 THEN 'Track record of completing projects in ' || p_size || ' months'
 WHEN 7 THEN p_size || ' or more similar works delivered' WHEN 8 THEN 'Firm active for at least ' || p_size || '  yrs'
 WHEN 9 THEN 'Minimum of ' || w || ' depots' ELSE 'Registered office in the region' END AS d,
 CASE (p_partkey // 11) % 6 WHEN 0 THEN '' WHEN 1 THEN '>= ' || n WHEN 2 THEN '<=' || p_size || '.5'
 WHEN 3 THEN 'Rs. ' || p_size || ' lakh' WHEN 4 THEN 'about ' || p_size ELSE '= ' || p_size || ',000' END AS th
 FROM (SELECT *, format('{:,.0f}', p_retailprice * 100) AS n, ['one','two','three','nine','ten'][p_size % 5 + 1] AS w FROM part))"""


def _count_sql() -> str:
    words = "CASE {0} " + " ".join(f"WHEN '{w}' THEN {K.NUMBER_WORDS[w]}" for w in K.COUNT_WORD.split("|")) + \
            " ELSE try_cast(nullif({0}, '') AS BIGINT) END"
    return "coalesce(" + ", ".join(words.format(f"regexp_extract(lower(d), {_q(p)}, 1)") for p in K.COUNT_PATTERNS) + ", 1)::BIGINT"


_YEARS = ("CASE WHEN regexp_matches(lower(d), 'year|yrs') AND regexp_matches(lower(d), 'experience|engineer|personnel') THEN coalesce("
          + ", ".join(f"try_cast(nullif(regexp_extract(lower(d), {_q(p)}, 1), '') AS DOUBLE)" for p in K.YEAR_PATTERNS) + ") END")
_QUAL = ("(NOT regexp_matches(lower(d), '" + "|".join(w.replace(".", "\\.") for w in K.MONEY_WORDING) + "') AND (regexp_matches(lower(d), "
         + _q(K.ISO_STANDARD) + ") OR regexp_matches(lower(d), '" + "|".join(K.MERIT_WORDING) + "') OR contains(lower(d), "
         "'ahead of schedule') OR (contains(lower(d), 'track record') AND regexp_matches(lower(d), 'project|complet'))))")
_CRIT_MONEY = "WITH " + _CRIT + ", " + money_sql(
    "texts AS (SELECT id * 2 AS id, d AS t FROM crit UNION ALL SELECT id * 2 + 1, th FROM crit)")

QUERIES = {
    "money_best": (money_best, f"""{_MONEY} SELECT t.id AS o_orderkey, round(amount, 4) AS amount, currency,
      round(confidence, 4) AS confidence, method, CASE WHEN currency = 'INR' THEN round(amount, 4) END AS rupees
      FROM texts t LEFT JOIN best USING (id)"""),
    "money_candidates": (money_candidates, f"""{_MONEY} SELECT id AS o_orderkey, round(amount, 4) AS amount, currency,
      confidence::DOUBLE AS confidence, method FROM kept"""),
    "money_gate": (money_gate, f"""{_MONEY}, {GATE_SQL}
      SELECT t.id AS o_orderkey, coalesce(x, FALSE) AS ambiguous, coalesce(c, 0) < 0.62 OR coalesce(x, FALSE) AS ask_model
      FROM texts t LEFT JOIN a USING (id)"""),
    "money_in_documents": (money_in_documents, "WITH " + money_sql("texts AS (SELECT doc_id AS id, text AS t FROM documents)")
                           + " SELECT id AS doc_id, amount, currency, method FROM best"),
    "money_by_currency": (money_by_currency, f"""{_MONEY} SELECT currency, method, count(*) AS texts,
      max(round(amount, 2)) AS largest FROM best GROUP BY ALL"""),
    "number_shapes": (number_shapes, f"""SELECT o_orderkey, replace({_P}, ',', '')::DOUBLE AS grouped,
      replace({_P}, ',', '')::DOUBLE AS euro, {_P} AS token, 1 AS sign,
      ['INR','USD','EUR','ABC','JPY',NULL][o_custkey % 6 + 1] AS currency,
      ['INR','USD','EUR',NULL,NULL,NULL][o_custkey % 6 + 1] AS inferred FROM orders"""),
    "count_requirement": (count_requirement, f"""WITH {_CRIT} SELECT id AS p_partkey, {_count_sql()} AS required_count,
      {_YEARS} AS years, {_QUAL} AS qualitative FROM crit"""),
    "threshold_parse": (threshold_parse, f"""{_CRIT_MONEY}, r AS (SELECT c.id, d, th, CASE WHEN b1.currency = 'INR' THEN
        b1.amount END AS dm, CASE WHEN b2.currency = 'INR' THEN b2.amount END AS fm, coalesce(nullif(regexp_extract(th,
        {_q(K.OPERATOR)}, 1), ''), '>=') AS op, {_YEARS} AS yt, {_QUAL} AS ql FROM crit c LEFT JOIN best b1 ON b1.id = c.id * 2
        LEFT JOIN best b2 ON b2.id = c.id * 2 + 1),
      x AS (SELECT *, try_cast(nullif(regexp_extract(lower(d), {_q(K.LOOSE_YEARS)}, 1), '') AS DOUBLE) AS ly,
        try_cast(nullif(regexp_extract(lower(d), {_q(K.PLAIN_YEARS)}, 1), '') AS DOUBLE) AS py,
        try_cast(replace(nullif(regexp_extract(th, {_q(K.ANY_NUMBER)}, 1), ''), ',', '') AS DOUBLE) AS an FROM r)
      SELECT id AS p_partkey, CASE WHEN ql OR coalesce(yt, dm, ly, py, fm, an) IS NULL THEN NULL WHEN yt IS NOT NULL OR dm > 0
          THEN op WHEN ly IS NOT NULL OR py IS NOT NULL THEN '>=' ELSE op END AS operator,
        CASE WHEN NOT ql THEN round(coalesce(yt, dm, ly, py, fm, an), 2) END AS value,
        regexp_matches(th, '[0-9]') OR coalesce(dm, 0) <> 0 OR regexp_matches(lower(d), {_q(K.ANY_YEARS)}) AS numeric FROM x"""),
    "compare_values": (compare_values, """SELECT operator, CASE operator WHEN '>=' THEN l_quantity >= 25 WHEN '>' THEN l_quantity > 25
      WHEN '<=' THEN l_quantity <= 25 WHEN '<' THEN l_quantity < 25 WHEN '=' THEN l_quantity = 25 ELSE FALSE END AS passes,
      abs(l_quantity - 25) <= 2.5 AS borderline, count(*) AS rows FROM (SELECT l_quantity,
        ['>=','>','<=','<','=','!'][l_partkey % 6 + 1] AS operator FROM lineitem) GROUP BY ALL"""),
    "numeric_reading": (numeric_reading, "WITH " + money_sql(f"""texts AS (SELECT o_orderkey AS id,
        ['','Rs. ','-','ISO ','about '][o_orderkey % 5 + 1] || {_P} || ['',' lakh',' years'][o_custkey % 3 + 1] AS t FROM orders)""")
        + r""" SELECT t.id AS o_orderkey, round(coalesce(CASE WHEN currency = 'INR' THEN amount END,
        try_cast(regexp_extract(replace(t, ',', ''), '-?\d+(?:\.\d+)?') AS DOUBLE)), 2) AS value FROM texts t
        LEFT JOIN best USING (id)"""),
}
