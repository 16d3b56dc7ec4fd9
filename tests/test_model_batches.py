"""Model calls read batches of long texts in slices."""

import contextlib
import io

from eligora.sources import models as M
from eligora.sources import replies as R


class Echo:
    def chat(self, messages, json_mode, max_tokens):
        if messages[-1]["content"] == "7":
            raise ValueError("seven")
        return messages[-1]["content"] + "!"

    def embed(self, text):
        return [float(len(text)), 1.0]


def test_rows_pass_unchanged_through_slices(spark):
    big = (1 << 53) + 1
    rows = [(None if i % 3 == 0 else big + i, str(i)) for i in range(2 * M.SLICE + 5)]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)
    asked = M.ask(df, "t", Echo, retries=0).collect()
    assert [(r.k, r.t) for r in asked] == rows
    assert [(r.reply, r.error) for r in asked] == [(None, "seven") if t == "7" else (t + "!", None) for _, t in rows]
    assert [(r.k, r.embedding) for r in M.embed(df, "t", Echo).collect()] == [(k, [float(len(t)), 1.0]) for k, t in rows]


def test_distinct_requests_are_hashed_not_sorted(spark, monkeypatch):
    seen = []

    def spy(requests, *args):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            requests.explain()
        seen.append(plan.getvalue())
        return M.ask(requests, *args)
    monkeypatch.setattr(R, "ask", spy)
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")], "k long, t string")
    got = R.ask_once(df, "t", Echo, at_once=2).select("k", "reply").collect()
    assert sorted(map(tuple, got)) == [(1, "a!"), (2, "a!"), (3, "b!"), (4, "!"), (5, "!")]
    assert "HashAggregate" in seen[0] and "SortAggregate" not in seen[0]
