"""Packing, SentencePiece, near duplicates, components, top-k search, pipeline."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eligora.llm import mtree, nearsets, packing, pieces, queries, wordbpe
from eligora.llm.batches import HashIndex, blocks, span_hashes, word_spans
from eligora.llm.components import components
from tests.conftest import SMALL
from tests.llm.conftest import clashing, sentence

WORDS = queries.tokenizer_path()
PIECES = queries.tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b\n\tc", "aaaaaaaa aaa!!! don't it's <|endoftext|> x<|ENDOFTEXT|>", "Straße ÀÉ ﬁ １２ é é 日本語 😀 <s> <0x0A>", "12ab3 Σς ΑΣ İ naïve...,, 99% a_b-c", "a\0b zero​width", "x  " * 5]


def test_word_spans_and_hashes():
    import pyarrow as pa

    texts = [None, "", " a  bb\x0bc\r", "é", "a"]
    (block,) = blocks(pa.array(texts))
    starts, ends, first = word_spans(block)
    words = [block.data[s:e].tobytes().decode() for s, e in zip(starts, ends)]
    assert words == ["a", "bb", "c", "é", "a"] and first.tolist() == [0, 0, 0, 3, 4, 5]
    h = span_hashes(block.data, starts, ends)
    assert h[0] == h[4] and len(set(h.tolist())) == 4
    assert [b.rows for b in blocks(pa.array(["x" * 10] * 5), limit=25)] == [slice(0, 2), slice(2, 4), slice(4, 5)]


def test_hash_index_grows():
    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 62, 5000).astype(np.uint64))
    index = HashIndex(4)
    for k in range(0, len(keys), 700):
        index.insert(keys[k:k + 700], np.arange(k, min(k + 700, len(keys)), dtype=np.int32))
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1)) == -1).sum() > 4900


def test_word_ids_like_the_library(spark):
    import pyarrow as pa

    texts = ODD + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    model = wordbpe.WordEncoder(WORDS, limit=50)  # forgets often
    for block in blocks(pa.array(texts), limit=2000):
        ids, counts = model.encode(block)
        want = [e.ids for e in model.library.encode_batch([block.text(i).decode() for i in range(len(counts))], add_special_tokens=False)]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))


def test_packing_of_edges(spark, edge_docs, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    packed = packing.pack(edge_docs, WORDS).collect()
    want = sorted(([i for i in library.encode(r.text or "", add_special_tokens=False).ids] + [1] for r in edge_docs.collect()))
    made, by_doc = {}, {}
    for r in packed:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= 2048
        made.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for places in made.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    single = {k: [i for _, p in sorted(v) for i in p] for k, v in by_doc.items() if k in (1, 2, 4, 7)}
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    for k, ids in single.items():
        assert ids == library.encode(texts[k] or "", add_special_tokens=False).ids + [1]
    assert sum(r.length for r in packed) == sum(map(len, want))
    whole = packing.sequences(spark.createDataFrame(packed)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in whole) == 4 * sum(map(len, want))
    assert packing.packed_digests(no_docs, WORDS).count() == 0


def test_packing_digests_and_padding(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.packed_digests(docs, WORDS).toPandas()
    assert not rows.duplicated(["doc_id", "start"]).any() and (rows.groupby("doc_id").length.sum() == rows.groupby("doc_id").doc_tokens.first()).all()
    filled = rows.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048 and filled.sum() / (2048 * len(filled)) > 0.95


def test_cutting_plan_covers_the_histogram():
    rng = np.random.default_rng(4)
    for _ in range(5):
        histogram = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 129), 20, replace=False), rng.integers(1, 400, 20))}
        plan = packing.cutting_plan(histogram, 128)
        load, seen = {}, {}
        for size, first, last, each, base, _ in plan:
            assert (last - first + 1) % each == 0
            seen.setdefault(size, []).extend(range(first, last + 1))
            for s in range(base, base + (last - first + 1) // each):
                load[s] = load.get(s, 0) + size * each
        assert {s: sorted(x) for s, x in seen.items()} == {s: list(range(1, n + 1)) for s, n in histogram.items()}
        sizes = np.array(sorted(histogram))
        columns, amounts = packing.solve(sizes, np.array([histogram[s] for s in sizes], float), 128)
        assert np.allclose(columns @ amounts, [histogram[s] for s in sizes]) and (sizes @ columns <= 128).all()
        assert max(load.values()) <= 128 and sorted(load) == list(range(len(load)))
        assert sum(s * n for s, n in histogram.items()) / 128 <= amounts.sum() + 1e-6 <= len(load) + 1e-6 <= amounts.sum() + len(sizes) + 1


def test_pieces_like_the_library(spark, edge_docs, no_docs):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    texts = ODD + ["▁x"] + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    model = pieces.Encoder(PIECES, limit=500)
    for k in range(0, len(texts), 7):
        ids, counts = model.encode([t.encode() for t in texts[k:k + 7]])
        want = library.encode(texts[k:k + 7])
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))
        assert model.decode(ids, counts) == [t.replace("▁", " ") for t in texts[k:k + 7]]
    rows = pieces.decode(pieces.encode(edge_docs, PIECES, ("doc_id", "text")), PIECES, ("doc_id", "text")).collect()
    assert len(rows) == edge_docs.count() and all(r.decoded == r.text for r in rows)
    assert pieces.encode(no_docs, PIECES).count() == 0


def test_suffix_ranges_like_str_find():
    vocabulary = pieces.Vocabulary(PIECES)
    text = np.array(list(map(ord, "▁the▁other▁theme▁in▁inning")) + [pieces.END], np.uint32)
    order = pieces.suffix_array(text, vocabulary.longest)
    low, high = pieces.occurrences(text, order, vocabulary)
    plain = "▁the▁other▁theme▁in▁inning"
    for k in range(len(vocabulary.ids)):
        piece = "".join(map(chr, vocabulary.letters[k, :vocabulary.lengths[k]]))
        assert sorted(order[low[k]:high[k]].tolist()) == [i for i in range(len(plain)) if plain.startswith(piece, i)]


def brute_components(rows, width, threshold):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                root[max(top(a), top(b))] = min(top(a), top(b))
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[top(k)] = min(names.get(top(k), i), i)
    return [(i, len(s), names.get(top(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def edited_chains():
    """Groups of texts edited from one source and chains edited step by step, so that families split into several components."""
    rng, rows = random.Random(1), []
    for _ in range(6):
        source = sentence(rng, 120).split()
        for share in (0.01, 0.02, 0.03, 0.04, 0.05, 0.06):
            for _ in range(3):
                words = list(source)
                for k in range(len(words)):
                    if rng.random() < share:
                        words[k] = sentence(rng, 1)
                rows.append(" ".join(words))
        chain = list(source)
        for _ in range(8):
            at = rng.randrange(len(chain) - 6)
            chain[at:at + 5] = sentence(rng, 5).split()
            rows.append(" ".join(chain))
    rows += [rows[0], rows[0].upper(), "one two", "One  TWO", "one", "", None]
    rng.shuffle(rows)
    return [(i if i % 17 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("width,threshold", [(3, 85), (5, 80)])
def test_near_components_like_brute_force(spark, width, threshold):
    rows = edited_chains()
    got = nearsets.near_components(clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), width, threshold).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(rows, width, threshold), key=key)
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in got)
    assert 3 < sum(r.kept for r in got) < len(rows)


def test_missing_links_with_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearsets, "BLOCK_MEMBERS", 4)
    monkeypatch.setattr(nearsets, "SLICE", 64)
    rows = edited_chains()
    got = nearsets.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(rows, 3, 85), key=key)


def passage_mixtures():
    """Texts mixed from one pool of passages (similarity about 0.5), with planted near copies."""
    rng = random.Random(29)
    pool = [sentence(rng, 10) for _ in range(90)]
    texts = [" ".join(pool[k] for k in sorted(rng.sample(range(90), 66))) for _ in range(450)]
    for text in texts[:40]:
        words = text.split()
        for _ in range(rng.randint(14, 16)):
            words[rng.randrange(len(words))] = "edited" + str(rng.randrange(1000))
        texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_components_of_mixed_passages(spark, monkeypatch):
    """With few and short bands nearly every bucket of two copies is led by a third text."""
    monkeypatch.setattr(nearsets, "ROWS", 3)
    monkeypatch.setattr(nearsets, "BANDS", 8)
    monkeypatch.setattr(nearsets, "BLOCK_MEMBERS", 16)
    rows = passage_mixtures()
    got = nearsets.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 3, 85))


def test_near_edges(edge_docs, no_docs):
    rows = nearsets.near_components(edge_docs, 3, 85).collect()
    assert len(rows) == edge_docs.count() and nearsets.near_components(no_docs, 3, 85).count() == 0
    got = {r.doc_id: r for r in rows}
    assert got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0 and got[3].kept
    assert got[5].component_id == 4 and got[7].component_id == 6 and not got[7].kept


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        common, a, b = (rng.integers(1, 1 << 63, n).astype(np.uint64) for n in (int(2000 * share), int(1000 * (1 - share)), int(1000 * (1 - share))))
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        rx, ry = nearsets.registers(x), nearsets.registers(y)
        assert (nearsets.merged(rx, ry) == nearsets.registers(np.unique(np.concatenate([x, y])))).all()
        truth = len(common) / (len(common) + len(a) + len(b))
        like = nearsets.likely_similarity(np.array([(rx > ry).sum()]), np.array([(rx < ry).sum()]), np.array([len(x)], float), np.array([len(y)], float))[0]
        assert abs(like - truth) < nearsets.MARGIN


def test_components_of_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(0).shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(9)}, 200: 200, 201: 200}


def test_components_of_few_links_take_few_jobs(spark):
    """Each job's exchanges leave threads and plans with the driver; a chain took several rounds of joins."""
    spark.sparkContext.setJobGroup("few-links", "few links")
    try:
        got = components(spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")) <= 5
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(401)}


@pytest.mark.parametrize("most", [1, 7, 40])
def test_components_beyond_one_task(spark, monkeypatch, most):
    """Tasks that can't hold all links give them on in parts, and rounds of joins settle the rest."""
    monkeypatch.setattr("eligora.llm.components.TASK_ROWS", most)
    rng = random.Random(most)
    names = [bytes([x % 256, x // 256]) for x in range(400)]  # first bytes beyond 127 as well
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(30)] + [(names[40], names[41 + i]) for i in range(30)] + [tuple(rng.sample(names[100:], 2)) for _ in range(120)]
    links += [(names[99], names[99]), (None, names[98]), *links[:20]]
    root = {x: x for p in links if None not in p and p[0] != p[1] for x in p}
    while any(root[a] != root[b] for a, b in links if a in root and b in root):
        for a, b in links:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(links, "a binary, b binary").repartition(3)).collect()
    assert sorted((bytes(r.node), bytes(r.root)) for r in got) == sorted(root.items())


def vectors(n=700, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    rows = [(i, [float(x) for x in centres[i % 8] + 0.1 * rng.normal(size=dim)]) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2100, [1.0, None] + [0.0] * (dim - 2)), (2200, [float("nan")] * dim), (2300, [float("inf")] * dim), (None, rows[0][1]), (2400, [1.0]), (2401, [2.0]), (2500, []), rows[3]]
    return rows


def brute_top(rows, k):
    held = {(i, tuple(np.floor(1024 * np.array(v, float)).astype(int).tolist())) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    for q, v in held:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in held if i != q and len(w) == len(v) > 0)
            yield from ((q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k]))


def test_top_k_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 7)
    rows = vectors()
    df = clashing(spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>"))
    stored = mtree.integers(df, "vec_id", "embedding").cache()
    got = mtree.search(mtree.trees(stored, tree_rows=100), stored.where("vec_id % 20 = 0"), 10).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_top(rows, 10))
    assert mtree.inner_product_top_k(df.where("false"), F.col("vec_id") % 20 == 0, 10).count() == 0
    few = mtree.inner_product_top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, 10)
    assert [(r.rank, r.query_id) for r in few.orderBy("rank").collect()] == [(1, 0), (2, 0)]


def test_top_k_leaves_out_own_id_before_the_cut(spark):
    """Six rows with the query's own id are nearest; ten others are due."""
    rows = [(100, [50.0 + k, 0.0]) for k in range(6)] + [(i, [float(i), 1.0]) for i in range(1, 31)]
    got = mtree.inner_product_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 100, 10).collect()
    pairs = [(1024 * int(q[0]) * 1024 * int(v[0]), i) for k, q in rows if k == 100 for i, v in rows if i != 100]
    assert sorted((-r.score, r.vec_id) for r in got) == sorted((-s, i) for s, i in pairs)[:10]


def test_stored_bounds_avoid_distances():
    rows = [(i, v) for i, v in vectors(3000) if i is not None and v is not None and len(v) == 12 and None not in v and np.isfinite(v).all()]
    ids, matrix = np.array([i for i, _ in rows]), np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    pages = list(mtree.build_pages(ids, matrix))
    for p in pages:
        p["vectors"] = p["vectors"].astype("<i8").tobytes()
    tree = mtree.Search(pages, 12)
    for q in range(0, 40):
        want = sorted(((int(s), -int(i)) for s, i in zip(matrix @ matrix[q], ids) if i != ids[q]), reverse=True)[:10]
        assert tree.best(int(ids[q]), matrix[q], 10) == [(s, -i) for s, i in want]
    assert tree.computed < 0.6 * (40 * len(ids)) and tree.avoided > 0


def test_top_k_query_like_sql(spark):
    got = queries.op10_mtree_topk(spark, SMALL).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    want = con.sql(queries.MTREE_SQL).df().sort_values(["query_id", "rank"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[list(got.columns)], check_dtype=False)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        made = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert made.columns == docs.columns
            assert made.join(docs, "doc_id", "left_anti").count() == 0
            if name in ("toxicity", "near_dedup"):
                assert made.exceptAll(docs).count() == 0 and made.count() <= docs.count()
            else:
                assert made.count() == docs.count() and made.join(docs.withColumnRenamed("text", "before"), "doc_id").where("length(text) > length(before)").count() == 0
        else:
            assert made.select("doc_id").distinct().count() == docs.count()
        docs = made
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "start", "ids_crc32").collect()))


def test_pipeline_edges(spark, edge_docs, no_docs):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SMALL).count() == 0
        edge_docs = stage(spark, edge_docs, SMALL)
    assert edge_docs.count() > 0
