"""Options, calls that are made once, criteria read block by block, amounts of criteria by a model."""

from functools import partial
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eligora.operators import evaluate as E
from eligora.operators.assess import assess_by
from eligora.options import Options
from eligora.sources import models as MO
from eligora.sources.replies import ReplyStore, ask_once, available


def counting(folder, answer, **attributes):
    """A client class whose calls each leave a line in ``folder``, whatever worker makes them."""
    log = str(Path(folder) / "calls")

    class Client:
        def chat(self, messages, json_mode, max_tokens):
            with open(log, "a") as out:
                out.write(repr(messages[-1]["content"]) + "\n")
            return answer(messages[-1]["content"])
    for name, value in attributes.items():
        setattr(Client, name, value)
    return Client, lambda: open(log).read().splitlines() if Path(log).exists() else []


def test_options_are_read_by_name():
    assert Options.read({}) == Options()
    got = Options.read({"ELIGORA_MONEY_MODEL": " Off ", "ELIGORA_EVIDENCE_FROM_INDEX": "YES", "ELIGORA_RESERVE_DOCUMENTS": "maybe",
                        "ELIGORA_BATCH_CHUNKS": "5", "ELIGORA_MONEY_CONFIDENCE": "0.5", "OTHER": "x"})
    assert got == Options(money_model=False, evidence_from_index=True, batch_chunks=5, money_confidence=0.5)
    assert Options.read({"ELIGORA_INDEX": "anything"}).index
    for wrong in ("0", "-1", "many"):
        with pytest.raises(ValueError):
            Options.read({"ELIGORA_CALLS_AT_ONCE": wrong})


def test_equal_requests_are_made_once(spark, tmp_path):
    # one prompt has a third of all rows, one is NULL, one is empty
    texts = ["hot"] * 300 + [f"p{i % 40}" for i in range(600)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, q string").repartition(6)
    client, calls = counting(tmp_path, str.upper)
    got = {r.id: (r.reply, r.error) for r in ask_once(rows, "q", client, at_once=3, wait=0).collect()}
    assert got == {i: ((t or "").upper(), None) for i, t in enumerate(texts)}
    assert sorted(calls()) == sorted(repr(t) for t in {t or "" for t in texts})
    assert ask_once(rows.limit(0), "q", client).count() == 0


def test_stored_replies_are_not_asked_for_again(spark, tmp_path):
    store = ReplyStore(spark, str(tmp_path / "replies"))
    store.create()

    def answer(text):
        if text == "down":
            raise OSError("no line")
        return text[::-1]
    client, calls = counting(tmp_path, answer)
    ask = partial(ask_once, client=client, retries=0, wait=0, store=store)

    def run(texts, **more):
        rows = spark.createDataFrame([(t,) for t in texts], "q string")
        return sorted((r.q, r.reply, r.error) for r in ask(rows, "q", **more).collect())
    assert run(["ab", "down", "ab"]) == [("ab", "ba", None), ("ab", "ba", None), ("down", None, "no line")]
    assert len(calls()) == 2
    # the failed one is tried again, the new one is asked, the old one is not
    assert run(["ab", "down", "cd"]) == [("ab", "ba", None), ("cd", "dc", None), ("down", None, "no line")]
    assert len(calls()) == 4
    run(["ab"], model="other")
    run(["ab"], system="other")
    assert len(calls()) == 6 and store.rows().count() == 4


def test_availability(spark, tmp_path):
    fine, _ = counting(tmp_path, str)
    busy, _ = counting(tmp_path, str, available=lambda self: False)

    def unmade():
        raise OSError
    assert available(spark, fine) and not available(spark, busy) and not available(spark, unmade)


def test_clients_are_warmed_up_before_calls(spark):
    class Cold:
        warm = False

        def warm_up(self):
            self.warm = True
            raise OSError("a warm-up may fail")

        def chat(self, messages, json_mode, max_tokens):
            return str(self.warm)
    assert {r.reply for r in MO.ask(spark.createDataFrame([("a",), ("b",)], "q string"), "q", Cold).collect()} == {"True"}


@pytest.mark.parametrize("n", [0, 1, 79, 80, 100, 101, 180, 181, 200, 1000])
def test_blocks_hold_the_whole_text(spark, n):
    text = "".join(chr(97 + i * 7 % 26) if i % 9 else "\n" for i in range(n)) if n else ""
    (row,) = spark.createDataFrame([(text,)], "t string").select(MO._overlapping(F.col("t"), 100, 20).alias("b")).collect()
    want, at = [text[:100]], 80
    while at + 20 < n:
        want.append(text[at:at + 100])
        at += 80
    assert row.b == want


def test_criteria_of_all_blocks_are_merged_and_failed_blocks_stay(spark):
    class Lister:
        def chat(self, messages, json_mode, max_tokens):
            text = messages[-1]["content"]
            if "fail" in text:
                raise OSError("no line")
            if "prose" in text:
                return "nothing to list"
            if "wrong" in text:
                return '{"criteria": 7}'
            marks = sorted({w for w in text.split() if w.startswith("mark")})
            return '{"criteria": [{"description": "Audited accounts of three years"}%s]}' % "".join(
                ', {"description": "%s", "mandatory": false}' % (m * 5) for m in marks)

    def page(word):
        return (word + " " + "x " * 50)[:100]
    tenders = spark.createDataFrame([(1, page("marka") + page("fail") + page("markb")), (2, page("prose")), (3, page("wrong")), (4, None)],
                                    "id long, full_text string")
    found, failed = MO.read_criteria(tenders, Lister, 100, 0, partial(ask_once, retries=0, wait=0))
    got = sorted((r.tender_id, r.crit_code, r.description, r.mandatory, r.merged) for r in found.collect())
    assert got == [(1, "C-001", "Audited accounts of three years", True, 2), (1, "C-002", "marka" * 5, False, 1),
                   (1, "C-003", "markb" * 5, False, 1), (4, "C-001", "Audited accounts of three years", True, 1)]
    assert sorted((r.tender_id, r.block, r.error) for r in failed.collect()) == [
        (1, 1, "no line"), (2, 0, "invalid JSON"), (3, 0, "no list of criteria")]


CRITERIA = ("id long, tender_id long, crit_code string, description string, category string, mandatory boolean, "
            "threshold string, expected_evidence string")
RULES = [(1, 7, "C-001", "Turnover as notified in the annexure", "financial", True, "", ""),
         (2, 7, "C-002", "Turnover of five crore rupees", "financial", True, "", "")]


def test_amounts_of_criteria_by_a_model(spark, tmp_path):
    client, calls = counting(tmp_path, lambda text: '{"amount": 900000, "currency": "INR", "confidence": 0.8}')
    criteria = spark.createDataFrame(RULES, CRITERIA)
    read = partial(MO.money_with_model, client=client, call=partial(ask_once, wait=0))
    got = {r.criterion_id: (r.threshold_value, r.route) for r in E.prepare_criteria(criteria, read).collect()}
    assert got == {1: (900000.0, "quantitative"), 2: (50000000.0, "quantitative")}
    assert len(calls()) == 1 and "annexure" in calls()[0]
    assert {r.criterion_id: r.threshold_value for r in E.prepare_criteria(criteria).collect()} == {1: None, 2: 50000000.0}


def test_assessment_by_options(spark, tmp_path):
    def answer(text):
        if "Excerpts:" in text:
            return '{"evidence": [{"extracted_value": "Rs. 60,000,000", "source_text": "turnover"}]}'
        if ">>>" in text:
            return '{"amount": 900000, "currency": "INR", "confidence": 0.8}'
        return '{"verdict": "ELIGIBLE", "explanation": "seen", "confidence": 0.9}'
    client, calls = counting(tmp_path, answer)
    bidders = spark.createDataFrame([(1, 7, "a")], "id long, tender_id long, name string")
    documents = spark.createDataFrame([(1, 7, 1, "f", "Our turnover was Rs. 60,000,000 last year.", None)],
                                      "bidder_id long, tender_id long, doc_ordinal long, filename string, full_text string, min_ocr_confidence double")
    criteria = spark.createDataFrame(RULES, CRITERIA)
    store = ReplyStore(spark, str(tmp_path / "replies"))
    store.create()

    def run(options, client, store=None):
        _, verdicts = assess_by(options, bidders, criteria, documents, client, store=store)
        return {r.criterion_id: r.verdict for r in verdicts.collect()}
    first = run(Options(), client, store)
    assert first == {1: "ELIGIBLE", 2: "ELIGIBLE"} and any(">>>" in c for c in calls())
    made = len(calls())
    assert run(Options(), client, store) == first and len(calls()) == made
    run(Options(money_model=False), client)
    assert not any(">>>" in c for c in calls()[made:])
    client.available = lambda self: False
    made = len(calls())
    assert set(run(Options(), client).values()) == {"NEEDS_REVIEW"} and len(calls()) == made
