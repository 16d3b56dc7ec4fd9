"""Running numbers and lengths over groups of any size, and the evidence texts made with them."""

from pyspark.sql import functions as F

from eligora.operators.ranking import running_sum
from eligora.sources import models as MO

PAIR = ["bidder_id", "criterion_id"]


def test_running_sum_over_a_hot_group(spark):
    # group 0 holds a third of all rows and is spread over several range partitions
    rows = [(0 if i % 3 == 0 else i % 50, i, i * 7 % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, o int, a int").repartition(6)
    got = {(r.g, r.o): (r["rank"], r.before) for r in running_sum(df, ["g"], [F.col("o")], F.col("a").cast("bigint")).collect()}
    want, seen = {}, {}
    for g, o, a in sorted(rows):
        n, s = seen.get(g, (0, 0))
        want[g, o] = (n + 1, s)
        seen[g] = (n + 1, s + a)
    assert got == want
    assert running_sum(df.limit(0), ["g"], [F.col("o")], F.col("a").cast("bigint")).count() == 0


def test_evidence_parts_hold_all_evidence_in_order(spark):
    rows = [(1, 1, i, f"d{i % 4}", "v" * (i % 9), None, None) for i in range(400)] + [(2, 1, 1, None, None, "s", "n"), (3, 1, 1, "d", "x" * 5000, "", "")]
    df = spark.createDataFrame(rows, "bidder_id long, criterion_id long, ordinal long, source_document string, extracted_value string, "
                                     "source_text string, notes string")
    parts = MO.evidence_parts(df, PAIR, 300).collect()
    whole = {}
    for r in sorted(parts, key=lambda r: (r.bidder_id, r.part)):
        assert r.bidder_id == 3 or len(r.evidence) < 400
        whole[r.bidder_id] = whole.get(r.bidder_id, "") + r.evidence

    def line(n, d, v, s, t):
        d, v, s, t = ("?" if x is None else x for x in (d, v, s, t))
        return f"\n{n}. in {d}: {v}\n   wording {s}\n   remark {t}\n"
    want = {}
    for b, _, i, *item in rows:
        want[b] = want.get(b, "") + line(i + 1 if b == 1 else 1, *item)
    assert whole == want
