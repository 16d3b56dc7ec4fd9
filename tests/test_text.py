"""Chunks, keywords, order, batches, replies, files, similar criteria."""

import io
import zipfile
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from eligora.functions import jsontext as J
from eligora.functions import text as X
from eligora.operators import dedupe, ranking, retrieval
from eligora.sources import files as S


def split(text, size=700, overlap=100):
    text, start, out = text.strip(), 0, []
    while text:
        out.append(text[start:start + size])
        if start + size >= len(text):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(700, 100), (50, 40), (10, 0)])
def test_chunks_match_plain_splitting(spark, size, overlap):
    texts = ["", "  \n ", "a", "x" * 700, "x" * 701, "é" * 1300, "ab " * 433 + "c", " \t" + "word\n" * 700 + " "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, full_text string")
    got = {}
    for r in retrieval.chunk_documents(df, ["i"], size=size, overlap=overlap).collect():
        got[r.i, r.chunk_index] = r.text
    want = {(i, j): c for i, t in enumerate(texts) for j, c in enumerate(split(t, size, overlap))}
    assert got == want


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        X.chunk_starts(F.lit("x"), 10, 10)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abc é\n1", max_size=400), min_size=1, max_size=5))
def test_chunks_cover_the_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, full_text string")
    rows = retrieval.chunk_documents(df, ["i"], size=30, overlap=10).collect()
    for i, text in enumerate(texts):
        parts = [r.text for r in sorted((r for r in rows if r.i == i), key=lambda r: r.chunk_index)]
        assert "".join(p if n == 0 else p[10:] for n, p in enumerate(parts)) == text.strip()


def test_keywords(spark):
    got = spark.createDataFrame([("The ISO9001 of GST, 5 works in rs 12 abc-de ab",)], "t string").select(
        X.keywords("t").alias("k"), X.keyword_score("t", X.keywords("t")).alias("s")).first()
    assert set(got.k) == {"iso9001", "gst", "5", "works", "12", "abc"}
    assert got.s == 6


def test_top_k_falls_back_to_first_chunks(spark):
    rows = [(1, i, 0) for i in range(12)] + [(2, i, i % 3) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, ord int, score int")
    got = retrieval.keyword_top_k(df, ["g"], ["ord"], 8).collect()
    assert sorted(r.ord for r in got if r.g == 1) == list(range(8))
    assert [r.ord for r in sorted((r for r in got if r.g == 2), key=lambda r: r.rank)] == [2, 5, 8, 11, 1, 4, 7, 10]


def test_rank_over_split_groups_is_a_row_number(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("s"),
                                  F.md5(F.col("id").cast("string")).alias("name"))
    got = ranking.rank_all(df, ["g"], [F.col("s").desc(), F.col("name")]).collect()
    for g in range(3):
        rows = sorted((r for r in got if r.g == g), key=lambda r: (-r.s, r.name))
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    plan = ranking.top_k(df, ["g"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


REPLIES = [
    ('{"evidence": [{"extracted_value": "5", "normalized_value": 5}, {"found": false}, "x"]}', [("5", 5.0)]),
    ('Sure: {"evidence": {"extracted_value": 7}} done', [("7", None)]),
    ('[{"extracted_value": "a"}, 3]', [("a", None)]),
    ('text [{"extracted_value": "a"}] text', []),
    ("nonsense {", []), ('{"evidence": []}', []), ("{}", []), (None, []),
]


def test_replies(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, r string")
    for r in df.select("i", J.evidence_items("r").alias("e")).collect():
        assert [(e.extracted_value, e.normalized_value) for e in r.e] == REPLIES[r.i][1]


def test_file_types(spark):
    names = {"a/b.PDF": "pdf", "x.tar.gz": "unknown", ".txt": "unknown", "d/.pdf": "unknown", "a.b.txt": "text",
             "doc.DOC": "docx", "p.jpeg": "image", "noext": "unknown", "dir.txt/file": "unknown", "..a.bmp": "image"}
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert {r.p: r.t for r in df.select("p", X.file_type("p").alias("t")).collect()} == names


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def p(t):
        return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = (p("Turnover Rs. 5 crore") + p("  ") + f"<w:tbl><w:tr><w:tc>{p(' a ')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
            + "<w:p><w:r><w:t>last</w:t><w:tab/><w:t>line</w:t></w:r></w:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files_become_documents(spark, tmp_path):
    folder = tmp_path / "T1" / "B1"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"one\r\ntwo \xff\xfe three")
    (folder / "b.docx").write_bytes(docx())
    (folder / "c.bin").write_bytes(b"zz")
    (folder / "d.docx").write_bytes(b"no archive")
    rows = {r.filename: r for r in S.ingest(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].full_text == "one\ntwo  three"
    assert rows["b.docx"].full_text == "Turnover Rs. 5 crore\nlast\tline"
    assert rows["b.docx"].pages[0].tables == [[["a", "b"]]]
    assert rows["d.docx"].full_text == "" and "BadZipFile" in rows["d.docx"].error and rows["a.txt"].error is None
    assert (rows["c.bin"].full_text, rows["c.bin"].page_count, rows["c.bin"].file_type) == ("", 1, "unknown")
    assert {(r.tender, r.bidder, r.min_ocr_confidence) for r in rows.values()} == {("T1", "B1", None)}


CRITERIA = ("tender_id long, ord long, description string, category string, mandatory boolean, threshold string, "
            "expected_evidence string, source_section string")


def test_similar_criteria_by_hand(spark):
    """Clusters written down by hand: copies, spelling, containment, order dependence, blanks, two scopes."""
    rows = [
        (1, 0, "Valid GST registration", "short", "3.1"),
        (1, 1, "PAN card of the bidder", "", ""),
        (1, 2, "valid   GST-registration!", "a longer threshold", "3.1"),
        (1, 3, "A valid GST registration must be produced", "x", "4"),
        (1, 4, "...", "", ""),
        (1, 5, "", "", ""),
        (1, 6, "Audited turnover of five crore rupees in each of the last three years", "", "A"),
        (1, 7, "Audited turnover of five crore rupees in each of the last three year", "", "B"),
        (1, 8, "Audited turnover", "", " "),
        (2, 0, "Valid GST registration", "", ""),
    ]
    df = spark.createDataFrame([(t, o, d, "c", True, h, "", x) for t, o, d, h, x in rows], CRITERIA)
    got = [(r.tender_id, r.crit_code, r.ord, r.threshold, r.source_section) for r in dedupe.merge_similar(df).orderBy("tender_id", "crit_code").collect()]
    assert got == [(1, "C-001", 0, "a longer threshold", "3.1; 4"), (1, "C-002", 1, "", ""), (1, "C-003", 4, "", ""),
                   (1, "C-004", 5, "", ""), (1, "C-005", 6, "", "A; B"), (2, "C-001", 0, "", "")]


def test_similar_criteria_keep_the_rule(spark):
    """No two kept texts are alike, and every dropped one is alike to a kept one that comes before it."""
    import random
    rng = random.Random(11)
    words = "the bidder must hold turnover of rupees crore gst pan iso work completed similar project engineer".split()
    texts = []
    for _ in range(120):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))
        if texts and rng.random() < 0.5:
            t = rng.choice(texts)
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["x", "", "zz"]) + t[at + rng.randrange(3):]
        texts.append(t)
    df = spark.createDataFrame([(1, i, t, "c", True, "", "", "") for i, t in enumerate(texts)], CRITERIA)
    kept = sorted(r.ord for r in dedupe.merge_similar(df).collect())
    plain = [" ".join(t.split()) for t in texts]

    def alike(i, j):
        return plain[i] in plain[j] or plain[j] in plain[i] or SequenceMatcher(None, plain[max(i, j)], plain[min(i, j)]).ratio() >= 0.88
    assert not any(alike(i, j) for i in kept for j in kept if i < j)
    assert all(any(alike(i, j) for j in kept if j < i) for i in range(len(texts)) if i not in kept)


def test_report_text(spark):
    got = spark.createDataFrame([("“a” – ₹5 ≥ Ω <b>&'",)], "t string").select(
        X.safe_text("t").alias("s"), X.html_escape("t").alias("h")).first()
    assert got.s == "\"a\" - Rs.5 >= ? <b>&'"
    assert got.h == "“a” – ₹5 ≥ Ω &lt;b&gt;&amp;&#x27;"
