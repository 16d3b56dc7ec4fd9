"""Index upkeep, retrieval modes of the assessment, and their registered queries."""

import pytest
from pyspark.sql import functions as F

from eligora.operators import hits as H
from eligora.operators.assess import assess
from eligora.operators.index import VectorIndex

DOCS = "bidder_id long, doc_pos long, filename string, file_hash string, full_text string, min_ocr_confidence double"


class NotingModel:
    """Writes down what it is asked to embed, so that tests can count calls made in workers."""

    folder = ""

    def __init__(self, folder):
        self.folder = folder

    def chat(self, messages, json_mode, max_tokens):
        return "about " + messages[-1]["content"].split("\n")[2]

    def embed(self, text):
        if "unreadable" in text:
            raise OSError("down")
        with open(f"{self.folder}/asked", "a") as out:
            out.write(text + "\n")
        return [float(text.count("gst")), float(text.count("turnover")), 1.0]


def documents(spark, *rows):
    return spark.createDataFrame([(b, p, f"f{p}", t, t, None) for b, p, t in rows], DOCS)


def asked(folder):
    path = folder / "asked"
    lines = path.read_text().splitlines() if path.exists() else []
    path.write_text("")
    return sorted(lines)


def test_refresh_embeds_stale_bidders_only(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.create()
    folder = str(tmp_path)
    client = lambda: NotingModel(folder)
    state = lambda: {r.bidder_id: (r.version, r.n_rows) for r in index.manifest().collect()}
    texts = lambda: sorted((r.bidder_id, r.document) for r in index.rows().collect())
    one = [(1, 0, "alpha"), (1, 1, "  "), (2, 0, "beta"), (3, 0, None)]
    assert index.refresh(documents(spark, *one), client, "m", summaries=False) == 1
    assert asked(tmp_path) == ["alpha", "beta"] and state() == {1: (1, 1), 2: (1, 1)}
    # nothing changed: no call, no new line
    index.refresh(documents(spark, *one), client, "m", summaries=False)
    assert asked(tmp_path) == [] and state() == {1: (1, 1), 2: (1, 1)}
    # bidder 2 hands in another text, bidder 4 is new; 1 stays, also where it is not named
    index.refresh(documents(spark, (2, 0, "gamma"), (4, 0, "delta")), client, "m", summaries=False)
    assert asked(tmp_path) == ["delta", "gamma"] and texts() == [(1, "alpha"), (2, "gamma"), (4, "delta")]
    # one failed embedding takes the bidder out, and the next refresh tries again
    index.refresh(documents(spark, (2, 0, "gamma"), (2, 1, "unreadable")), client, "m", summaries=False)
    assert sorted(state()) == [1, 4]
    index.refresh(documents(spark, (2, 0, "gamma")), client, "m", summaries=False)
    assert sorted(state()) == [1, 2, 4]
    # another model makes all anew, with summaries here
    asked(tmp_path)
    index.refresh(documents(spark, *one), client, "other")
    assert asked(tmp_path) == ["about alpha", "about beta", "alpha", "beta"]
    before = texts()
    index.compact()
    assert texts() == before and len({r.part for r in index.manifest().collect()}) == 1
    index.refresh(documents(spark, *one), client, "other")
    assert asked(tmp_path) == []
    index.remove(spark.createDataFrame([(1,), (9,)], "bidder_id long"))
    assert sorted(state()) == [2, 4]
    assert [r.bidder_id for r in index.rows(spark.createDataFrame([(4,)], "bidder_id long")).collect()] == [4]


def test_rows_without_a_manifest_line_are_not_seen(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.create()
    assert index.rows().count() == 0 and index.manifest().count() == 0
    folder = str(tmp_path)
    index.refresh(documents(spark, (1, 0, "alpha")), lambda: NotingModel(folder), "m", summaries=False)
    index._write(index.rows().withColumn("document", F.lit("half")), "v2-broken")
    assert [r.document for r in index.rows().collect()] == ["alpha"]


CHUNKS = "tender_id long, bidder_id long, doc_ordinal long, source_document string, chunk_index int, text string"


def test_hits_of_each_mode(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "a", 0, "roof tiles"), (1, 1, 0, "a", 1, "gst number"), (1, 1, 1, "b", 0, "gst and turnover"),
                                    (1, 2, 0, "c", 0, "nothing")], CHUNKS)
    prepared = spark.createDataFrame([(1, 7, "gst turnover", "", "")], "tender_id long, criterion_id long, description string, "
                                                                      "expected_evidence string, threshold string")
    pending = spark.createDataFrame([(1, 1, 7), (1, 2, 7)], "tender_id long, bidder_id long, criterion_id long")
    keyword = H.keyword_hits(chunks, prepared, pending, 2)
    rows = lambda df: sorted((r.bidder_id, r["rank"], r.doc_ordinal, r.chunk_index) for r in df.collect())
    assert rows(keyword) == [(1, 1, 1, 0), (1, 2, 0, 1), (2, 1, 0, 0)]
    # bidder 1 has an index whose summary of document 0 is near; bidder 2 has none; zero and missing vectors are no hits
    index = spark.createDataFrame([(1, 0, "chunk", 0, [1.0, 0.0]), (1, 0, "chunk", 1, [0.0, 0.0]), (1, 1, "chunk", 0, None),
                                   (1, 0, "doc_summary", -1, [1.0, 1.0])],
                                  "bidder_id long, doc_pos long, kind string, chunk_index int, embedding array<float>")
    queries = spark.createDataFrame([(1, 7, [1.0, 0.0])], "tender_id long, criterion_id long, embedding array<float>")
    fused = H.vector_hits(index, queries, chunks, keyword, pending, k=3, pool=1)
    assert rows(fused) == [(1, 1, 0, 0), (1, 2, 0, 1), (1, 3, 1, 0), (2, 1, 0, 0)]
    # without a query vector only keyword hits are left
    assert rows(H.vector_hits(index, queries.limit(0), chunks, keyword, pending, k=2)) == rows(keyword)
    batch = {r.bidder_id: (r.source_document, r.context) for r in H.hit_batches(fused, chunks).collect()}
    assert batch[1] == ("a", "[CHUNK 1 from a]\nroof tiles\n\n[CHUNK 2 from a]\ngst number\n\n[CHUNK 3 from b]\ngst and turnover")
    assert batch[2] == ("c", "[CHUNK 1 from c]\nnothing")


class Finder:
    def chat(self, messages, json_mode, max_tokens):
        text = messages[-1]["content"]
        if "Excerpts:" not in text:
            return '{"verdict": "ELIGIBLE", "explanation": "shown"}'
        return '{"evidence": [{"extracted_value": "yes"}]}' if "gst 12" in text else '{"evidence": []}'

    def embed(self, text):
        return [float("gst" in text.lower()), 1.0]


@pytest.mark.parametrize("mode", ["top_k", "vector"])
def test_assessment_by_retrieval(spark, tmp_path, mode):
    bidders = spark.createDataFrame([(1, 5, "A"), (2, 5, "B"), (3, 5, "C")], "id long, tender_id long, name string")
    criteria = spark.createDataFrame([(9, 5, "C-001", "gst registration", "compliance", True, "", "")],
                                     "id long, tender_id long, crit_code string, description string, category string, mandatory boolean, "
                                     "threshold string, expected_evidence string")
    docs = spark.createDataFrame([(1, 5, 1, "a", "filler", 80.0), (1, 5, 2, "b", "gst 12", 70.0), (2, 5, 1, "a", "none here", None),
                                  (3, 5, 1, "a", None, None)],
                                 "bidder_id long, tender_id long, doc_ordinal long, filename string, full_text string, min_ocr_confidence double")
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.create()
    index.refresh(docs.withColumnRenamed("doc_ordinal", "doc_pos").withColumn("file_hash", F.md5("full_text")), Finder, "m", summaries=False)
    evidence, verdicts = assess(bidders, criteria, docs, Finder, retrieval=mode, index=index.rows() if mode == "vector" else None)
    assert [(r.bidder_id, r.source_document, r.extracted_value, r.ocr_confidence) for r in evidence.collect()] == [(1, "b", "yes", 70.0)]
    assert {r.bidder_id: r.verdict for r in verdicts.collect()} == {1: "ELIGIBLE", 2: "NEEDS_REVIEW", 3: "NEEDS_REVIEW"}


def test_modes_are_checked(spark):
    nothing = spark.range(0)
    for wrong in ({"retrieval": "guess"}, {"retrieval": "vector"}, {"retrieval": "top_k", "reserve": True}):
        with pytest.raises(ValueError):
            assess(nothing, nothing, nothing, Finder, **wrong)
