"""Amounts read from text, by rules only."""

import pytest
from pyspark.sql import functions as F

from eligora.functions import money as M
from eligora.functions import text as X
from eligora.plans import money_queries as MQ
from eligora.sources.models import money_with_model

# text, currency, amount
AMOUNTS = [
    ("Earnest deposit of Rs. 7,25,000/- by demand draft", "INR", 725_000),
    ("net worth of seventeen crore rupees at year end", "INR", 170_000_000),
    ("paid-up capital: 0.75 crores INR", "INR", 7_500_000),
    ("hired plant worth 40 lakhs", "INR", 4_000_000),
    ("letter of credit over USD 8.1 million", "USD", 8_100_000),
    ("a loan of 6 billion USD", "USD", 6_000_000_000),
    ("courier charge $2,048.16 refundable", "USD", 2048.16),
    ("the licence (USD 75.00) is extra", "USD", 75),
    ("spare parts 9,40 EUR", "EUR", 9.40),
    ("invoice total 8.765,43 EUR", "EUR", 8765.43),
    ("crane EUR 7 654 321.10 delivered", "EUR", 7_654_321.10),
    ("an engineer of 14 years standing, experience certified", None, None),
    ("accounts of financial year 2019-20", None, None),
    ("uptime of 98% over the quarter", None, None),
    # quirks kept on purpose
    ("Rupees Six Crore Forty Lakhs only", "INR", 60_000_000),
    ("Rs. 3,48,72,000/-", "INR", 34_872_000),
    ("12,50 £", "EUR", 12.50),
    ("years 2023", "INR", 2023),
    ("twenty-five lakh", "INR", 2_500_000),
    ("$0 million", "USD", 0),
    ("", None, None),
    ("   ", None, None),
    (None, None, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(AMOUNTS)]
    df = spark.createDataFrame(rows, "i int, t string")
    return {r.i: r.m for r in df.select("i", M.parse_money("t").alias("m")).collect()}


@pytest.mark.parametrize("i", range(len(AMOUNTS)), ids=lambda i: str(AMOUNTS[i][0])[:30])
def test_amount(parsed, i):
    _, currency, amount = AMOUNTS[i]
    got = parsed[i]
    if currency is None:
        assert got is None
    else:
        assert got.currency == currency
        assert got.amount == pytest.approx(amount)


def test_grouped_and_euro_numbers(spark):
    rows = [("10,00,000",), ("10,000,000",), ("1 234.5",), ("x",), ("1.234,56",), ("12.345,6",), ("1,234",)]
    got = spark.createDataFrame(rows, "t string").select(
        "t", M.grouped_number("t").alias("g"), M.euro_number("t").alias("e")).collect()
    by = {r.t: (r.g, r.e) for r in got}
    assert by["10,00,000"][0] == 1_000_000
    assert by["10,000,000"][0] == 10_000_000
    assert by["1 234.5"][0] == 1234.5
    assert by["x"] == (None, None)
    assert by["1.234,56"][1] == 1234.56
    assert by["12.345,6"][1] == 12345.6
    assert by["1,234"][1] is None


def test_signs_and_currency_tags(spark):
    rows = [("(-5)",), ("-5",), ("+7 ",), ("(3)",)]
    got = spark.createDataFrame(rows, "t string").select("t", M.signed_token("t").alias("s")).collect()
    assert {r.t: (r.s.token, r.s.sign) for r in got} == {
        "(-5)": ("5", 1), "-5": ("5", -1), "+7 ": ("7", 1), "(3)": ("3", -1)}
    tags = spark.createDataFrame([("Rs.",), ("US$",), ("xyz",), ("zz",), (None,)], "t string")
    assert [r.c for r in tags.select(M.currency_code("t").alias("c")).collect()] == ["INR", "USD", "XYZ", None, None]


def test_duplicates_and_ambiguity(spark):
    df = spark.createDataFrame([(1, "Rs. 3,48,72,000/-"), (2, "5 crore"), (3, "")], "i int, t string")
    got = {r.i: r for r in df.select("i", M.money_candidates("t").alias("c")).select(
        "i", M.distinct_candidates(F.col("c")).alias("d"), M.is_ambiguous(F.col("c")).alias("a"),
        M.needs_model(F.col("c")).alias("n")).collect()}
    assert got[1].a and got[1].n and {c.currency for c in got[1].d} == {"INR", "EUR"}
    # Three rules and the bare number find two distinct amounts.
    assert sorted(c.amount for c in got[2].d) == [5.0, 50_000_000.0]
    assert not got[2].a
    assert got[3].d == [] and got[3].n


class AmountModel:
    def chat(self, messages, json_mode, max_tokens):
        if "broken" in messages[-1]["content"]:
            return "no answer"
        return 'Here: {"amount": "77", "currency": "inr", "confidence": 0.99}'


def test_model_is_asked_only_where_rules_are_unsure(spark):
    df = spark.createDataFrame([(1, "pay some"), (2, "five crore"), (3, "broken")], "i int, t string")
    got = {r.i: r.money for r in money_with_model(df, "i", "t", AmountModel).collect()}
    assert (got[1].amount, got[1].confidence, got[1].method) == (77.0, 0.9, "llm_disambiguate")
    assert got[2].amount == 50_000_000
    assert got[3] is None


def test_scans_are_cut_by_their_pieces(spark):
    """A piece of narrow rows holds millions, so a task gets a part of one, however many pieces there are."""
    folder = "/root/testdata/sf0.001"
    for name, scan in (("orders", MQ.order_texts(spark, folder)), ("part", MQ._criteria(spark, folder)),
                       ("orders", MQ.numeric_reading(spark, folder))):
        pieces = spark.read.parquet(f"{folder}/{name}.parquet").rdd.getNumPartitions()
        assert scan.rdd.getNumPartitions() >= 16 * pieces


def test_texts_that_are_no_number_are_not_cast(spark):
    out = spark.createDataFrame([("",), ("1.5",), ("x",), (None,)], "t string").select(X.as_double(F.col("t")).alias("n"))
    assert [r.n for r in out.collect()] == [None, 1.5, None, None]
