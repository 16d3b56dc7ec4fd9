"""Likely pairs of texts, within small scopes and by join, against all pairs."""

import random
from difflib import SequenceMatcher

from eligora import constants as K
from eligora.operators import dedupe as D


def _texts(rng):
    """Digests, copies with few edits, parts of others, repeats of one letter, short and empty-ish texts."""
    rows = []
    for tender in range(12):
        base = ["".join(rng.choice("0123456789abcdef ") for _ in range(rng.randint(1, 40))).strip() or "a" for _ in range(rng.randint(1, 8))]
        base += ["a" * rng.randint(1, 30), "ab" * rng.randint(1, 15)]
        for text in list(base):
            at = rng.randrange(len(text))
            base += [text[:at] + "x" + text[at + 1:], text[:at] + "\u00e9" + text[at:], text[at:], text + " tail"]
        rows += [(tender, i, t) for i, t in enumerate(dict.fromkeys(base))]
    return rows


def _alike(a, b):
    return a in b or b in a or SequenceMatcher(None, a, b).ratio() >= K.SIMILARITY


def test_pairs_of_small_and_large_scopes_equal_all_pairs(spark):
    rows = _texts(random.Random(3))
    texts = spark.createDataFrame(rows, "tender_id long, ord long, norm string")
    want = {(s, j, i) for s, i, a in rows for t, j, b in rows if s == t and i < j and _alike(b, a)}
    assert len(want) > 50
    for most in (64, 20, 0):  # all scopes small, some, none
        got = [tuple(r) for r in D.alike_edges(texts, "tender_id", most_texts=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_small_scopes_need_no_join_of_trigrams(spark, monkeypatch):
    def refuse(*args):
        raise AssertionError("joined by trigrams")
    monkeypatch.setattr(D, "candidate_pairs", refuse)
    texts = spark.createDataFrame([(1, 0, "one text"), (1, 1, "one  text"), (2, 0, "one text")], "tender_id long, ord long, norm string")
    assert [tuple(r) for r in D.alike_edges(texts, "tender_id").collect()] == [(1, 1, 0)]
