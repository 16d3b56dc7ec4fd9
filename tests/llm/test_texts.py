"""Toxicity, substring dedup, line dedup, quality rules, quality classifier, URL filter."""

import inspect
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eligora.llm import lines, rules, sites, substrings, toxicity, urls
from tests.llm.conftest import clashing, held_out, sentence


def texts(df):
    return sorted((r.doc_id is None, r.doc_id, r.text is None, r.text) for r in df.select("doc_id", "text").collect())


def test_toxicity_on_held_out_documents(toxic_corpus):
    docs, labels = toxic_corpus
    rows = toxicity.toxicity_scores(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == docs.count() and all(r.held_out == held_out(r.doc_id) for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_never_learns_from_the_held_out_fold(spark, toxic_corpus):
    docs, labels = toxic_corpus
    turned = labels.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_toxicity_edges(edge_docs, no_docs, toxic_corpus):
    _, labels = toxic_corpus
    rows = toxicity.toxicity_scores(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(edge_docs, labels.where("false")).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity_scores(edge_docs, labels.where("toxic = 1")).collect()} == {1.0}


def test_toxicity_reads_short_texts_and_rare_insults(spark):
    """An insult in 5 labelled texts counts, as a whole text and in front of a longer one."""
    rng = random.Random(9)
    rows = [(i, sentence(rng, 30), int(i % 6 == 0)) for i in range(900)]
    rows = [(i, t + (" moron" if x else ""), x) for i, t, x in rows] + [(1000 + k, "scum! " + sentence(rng, 30), 1) for k in range(8)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, "scum!"), (5001, "abcd"), (5002, "Scum! " + sentence(rng, 30))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert scores[5000] > 0.5 > scores[5001] and scores[5002] > 0.5


def test_toxicity_curve_is_fitted_on_all_rows_where_they_are(spark):
    assert not {"max_labelled", "limit", "sample"} & set(inspect.signature(toxicity.toxicity_scores).parameters)
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(400, len(toxicity.EVIDENCE) - 1)), np.ones(400)])
    y = (x[:, 0] + rng.normal(size=400) > 0.3).astype(int)
    rows = spark.createDataFrame([(int(t), *map(float, e)) for t, e in zip(y, x)], "toxic long, " + ", ".join(f"{e} double" for e in toxicity.EVIDENCE))
    assert np.allclose(toxicity.fit_rows(rows.repartition(7)), toxicity.fit_logistic(x, y), rtol=1e-9, atol=1e-9)
    assert toxicity.fit_rows(rows.where("toxic = 1")) is None and toxicity.fit_rows(rows.limit(0)) is None


def test_toxicity_with_a_partitioned_table_gives_the_same_scores(toxic_corpus, monkeypatch):
    docs, labels = toxic_corpus
    monkeypatch.setattr(toxicity, "BLOCK_TEXT", 20_000)
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(docs, labels, broadcast_rows=n).collect()) for n in (toxicity.BROADCAST_ROWS, 0))
    assert a == b


def test_kneser_ney_by_hand(spark):
    """Differences of a small model against the recursion written out over counts."""
    grams = {b"xaaaab": (3, 0), b"yaaaab": (1, 2), b"xaaaac": (0, 4), b"zbaaab": (2, 2), b"zbaaad": (0, 1)}
    number = lambda b: int.from_bytes(b, "big")
    counts = spark.createDataFrame([(number(g), *n, 0, 0) for g, n in grams.items()], "expression long, " + ", ".join(f"{c} long" for c in toxicity.COUNTS))
    table = toxicity.ratios(counts).toPandas()
    model = toxicity.Model.of(table.entry.to_numpy(), table.ab.to_numpy())

    def tables(c):
        level = {6: {g: n[c] for g, n in grams.items()}}
        for m in range(5, 0, -1):
            level[m] = {}
            for g, n in level[m + 1].items():
                level[m][g[1:]] = level[m].get(g[1:], 0) + (n > 0)
        return level

    def discount(values):
        one, two = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return one / (one + 2 * two) if one and two else 0.75

    both = tables(0)
    for m in range(toxicity.SHARED, 0, -1):
        both[m] = {}
        for g in (both[m + 1] if m < toxicity.SHARED else {k[-m - 1:]: 1 for k in grams}):
            both[m][g[1:]] = both[m].get(g[1:], 0) + 1

    def chance(level, g, shared):
        m = len(g)
        if m == 1:
            return (both[1].get(g, 0) + 0.5) / (sum(both[1].values()) + 128)
        n = both[m] if m <= toxicity.SHARED else level[m]
        d = discount(n.values())
        own = {k: v for k, v in n.items() if k[:-1] == g[:-1]}
        total = sum(own.values())
        below = chance(level, g[1:], shared)
        return max(n.get(g, 0) - d, 0) / total + d * sum(v > 0 for v in own.values()) / total * below if total else below

    probes = [*grams, b"qaaaab", b"xaaaad", b"yaaaac"]
    want = [np.log(chance(tables(0), g, both)) - np.log(chance(tables(1), g, both)) for g in probes]
    assert np.allclose(model.differences(np.array([number(g) for g in probes], np.uint64)), want, atol=1e-5)


def brute_substrings(rows, divisor=substrings.DIVISOR, min_words=substrings.MIN_WORDS):
    table, cut, seen = [int(x) for x in substrings._GEAR], {}, {}
    for i, t in rows:
        raw, out, cur = t.encode(), [], []
        for m in re.finditer(rb"[^ \t-\r]+", raw):
            cur.append(m)
            h = sum(table[raw[m.end() - 1 - k]] << k for k in range(min(16, m.end()))) & 0xFFFFFFFF
            if (h >> 6) % divisor == 0 and m.end() >= 16:
                out, cur = [*out, cur], []
        cut[i] = [(c[0].start(), c[-1].end(), len(c)) for c in [*out, cur] if c]
    for i, t in sorted(rows):
        for s, e, _ in cut[i]:
            seen.setdefault(t.encode()[s:e], i)
    for i, t in rows:
        raw, local, gone, run = t.encode(), set(), set(), []
        for k, (s, e, n) in enumerate([*cut[i], (0, 0, 0)]):
            chunk = raw[s:e]
            if k < len(cut[i]) and (chunk in local or seen[chunk] < i):
                run.append((k, n))
            else:
                gone |= {x for x, _ in run} if sum(n for _, n in run) >= min_words else set()
                run = []
            local.add(chunk)
        starts = [s for s, _, _ in cut[i]] + [len(raw)]
        kept = b"".join([raw[:starts[0]], *(raw[starts[k]:starts[k + 1]] for k in range(len(cut[i])) if k not in gone)]).decode()
        yield i, kept.rstrip() if gone and len(cut[i]) - 1 in gone else kept


def passages():
    rng = random.Random(11)
    shared = [sentence(rng, 60) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randint(5, 60)) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randrange(4), rng.choice(shared))
        rows.append((i, rng.choice([" ", "\n"]).join(parts) + rng.choice(["", "\n", " é"])))
    return shared, rows


def test_substrings_like_brute_force(spark):
    shared, rows = passages()
    got = {r.doc_id: r.text for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == dict(brute_substrings(rows))
    for passage in shared:
        middle = " ".join(passage.split()[20:40])
        assert sum(middle in t for _, t in rows) > 1 and sum(middle in t for t in got.values()) == 1
    assert sum(got[i] == t for i, t in rows) >= 30  # documents without a shared passage are as they were


def test_substrings_of_a_small_vocabulary_stay(spark):
    """Texts whose chunks have all occurred somewhere, but no passage of 16 words."""
    rng = random.Random(13)
    vocabulary = sentence(rng, 8).split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(400))) for i in range(60)]
    seen = Counter(g for _, t in rows for g in zip(*[t.split()[k:] for k in range(16)]))
    assert max(seen.values()) == 1
    got = {r.doc_id: r.text for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) and any(t != dict(rows)[i] for i, t in brute_substrings(rows))


def test_substrings_edges(edge_docs, no_docs):
    out = substrings.without_repeats(edge_docs)
    assert out.columns == edge_docs.columns and substrings.without_repeats(no_docs).count() == 0
    rows = texts(out)
    assert len(rows) == edge_docs.count()
    got = {}
    for _, i, _, t in rows:
        got.setdefault(i, []).append(t)
    assert got[1] == [None] and got[2] == [""] and got[3] == [" \n\t "]
    assert len(got[4][0]) > 100_000 and got[5] == [""]
    assert got[6][0] == got[6][1] and len(got[7][0]) < len(got[6][0]) and got[None][0] == got[6][0] and got[None][1] is None
    assert {r.doc_id: r.n_chars for r in out.where("doc_id in (5, 7)").collect()} == {5: 0, 7: len(got[7][0])}


def brute_lines(rows):
    def value(b):
        v = xxhash.xxh64(b, seed=42).intdigest()
        return v - (1 << 64) if v >> 63 else v

    def cut(t):
        part, h = t.split("\n"), [value(x.encode()) % lines._PRIME for x in t.split("\n")]
        out, start, worded = [], 0, 0
        for i in range(len(part)):
            roll = 0
            for back in range(lines.WINDOW - 1, -1, -1):
                roll = (roll * lines._BASE + (h[i - back] if i >= back else 0)) % lines._PRIME
            worded += bool(re.search("[^ \t-\r]", part[i]))
            possible = (roll >> 7) % lines.DIVISOR == 0
            if possible and worded >= lines.MIN_LINES or i == len(part) - 1:
                out, start = [*out, part[start:i + 1]], i + 1
            worded *= not possible
        return out

    first = {}
    for i, t in sorted(rows):
        for k, c in enumerate(cut(t)):
            if sum(bool(re.search("[^ \t-\r]", x)) for x in c) >= 2:
                first.setdefault("\n".join(c), (i, k))
    for i, t in rows:
        whole = cut(t)
        kept = [c for k, c in enumerate(whole) if first.get("\n".join(c), (i, k)) == (i, k)]
        yield i, t if len(kept) == len(whole) else "\n".join(x for c in kept for x in c)


def test_lines_like_brute_force(spark):
    rng = random.Random(3)
    blocks = [[sentence(rng, 4) for _ in range(12)] for _ in range(4)]
    rows = [(i, "\n".join([sentence(rng, 3) for _ in range(rng.randint(0, 6))] + rng.choice(blocks) * (i % 3) + [sentence(rng, 3), ""])) for i in range(40)]
    got = {r.doc_id: r.text for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == dict(brute_lines(rows)) and sum(got[i] != t for i, t in rows) > 10


@pytest.mark.parametrize("between", ["\n", "\n\n"])
def test_a_long_repeated_block_of_lines_goes_but_for_its_ends(spark, between):
    rng = random.Random(11)
    block = [sentence(rng, 5) for _ in range(400)]
    own = lambda n: [sentence(rng, 5) for _ in range(n)]
    rows = [(1, between.join(own(7) + block + own(5))), (2, between.join(own(4) + block + own(9)))]
    got = {r.doc_id: r.text for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1]
    left = got[2].split("\n")
    assert sum(x in left for x in block) <= 40 and all(x in left for x in rows[1][1].split(between)[:4] + rows[1][1].split(between)[-9:])


def test_lines_edges(spark, edge_docs, no_docs):
    out = lines.without_repeats(edge_docs)
    assert out.columns == edge_docs.columns and texts(out) == texts(edge_docs)  # no text has two lines
    assert lines.without_repeats(no_docs).count() == 0
    block = "\n".join(f"line {i}" for i in range(30))
    rows = [(1, block), (1, block), (2, block + "\n" + block), (None, block), (3, None)]
    got = [(r.doc_id, r.text, r.n_chars) for r in lines.without_repeats(clashing(spark.createDataFrame([(*r, -1) for r in rows], "doc_id long, text string, n_chars int"))).collect()]
    first = [t for i, t, _ in got if i is None]
    assert first == [block] and [t for i, t, _ in got if i == 3] == [None]  # null ids come first
    again = [t for i, t, _ in got if i == 1]
    assert again[0] == again[1] and len(again[0]) < len(block)
    assert all(n == -1 or n == len(t) for _, t, n in got if t is not None)


def brute_measures(t):
    words, covered, at = re.findall("[^\x20\x09-\x0D]+", t), set(), {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            covered |= {x for i in places for x in range(i, i + 8)}
    held = Counter(x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(n - 1 for n in held.values()), len(covered)


def test_rule_measures_and_verdicts(spark, edge_docs, no_docs):
    rng = random.Random(2)
    good = [sentence(rng, 40) + ".\n" + sentence(rng, 30) + "." for _ in range(120)]
    bad = [" ".join(w + "$$$" for w in sentence(rng, 60).split()) for _ in range(15)] + [" ".join(w + "!!" for w in sentence(rng, 60).upper().split()) for _ in range(10)] + [(sentence(rng, 9) + ".\n") * 8 for _ in range(5)]
    odd = ["", "é ü\x0b中 #\n\n é\né", " ".join(sentence(rng, 4).split() * 9), "\r\n \n"]
    rows = list(enumerate(good + bad + odd))
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(120)) and not any(got[i].kept for i in range(120, 150))
    edge = rules.quality_rules(edge_docs).collect()
    assert len(edge) == edge_docs.count() and all(r.base_failed for r in edge if r.doc_id in (1, 2, 3, 8))
    assert rules.quality_rules(no_docs).count() == 0


def test_rule_accuracies_are_recovered():
    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    votes = np.where(rng.random((len(truth), 5)) < accuracy, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, table = rules.fit(patterns, counts.astype(float))
    found = table[1, :, 2] / (table[1, :, 2] + table[1, :, 0])
    assert abs(share - 0.8) < 0.03 and np.abs(found - accuracy).max() < 0.04


def test_site_posteriors_by_hand(spark):
    """Without evidence, a document's prior is its path's mean of the others, shrunk to its host and to all."""
    rows = [(i, None, "en" if i % 2 else "de", "a" if i < 40 else "b" if i < 80 else None, 0) for i in range(90)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in sites.quality_scores(docs, labels).collect()}
    assert len(got) == 90
    a = np.mean([got[i].prior for i in range(40)])
    b = np.mean([got[i].prior for i in range(40, 80)])
    alone = np.mean([got[i].prior for i in range(80, 90)])
    assert a > alone > b and a > 0.8 and b < 0.3
    assert sites.quality_scores(docs.where("false"), labels).count() == 0
    assert sites.quality_scores(docs, labels.where("false")).count() == 90


def test_quality_on_held_out_documents(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(w + ("***" if i % 4 == 0 else "") for w in sentence(rng, 50).split()) + ".", "en", f"src{i % 5}", 0) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)], "doc_id long, quality int")
    out = [r for r in sites.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), labels).collect() if r.held_out]
    assert out and all(r.predicted == int(r.doc_id % 4 != 0) for r in out)


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def test_url_rules_by_hand(spark, no_docs):
    cases = {
        "http://A.Example.ORG/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/17#z": ("example.org", "/en/17", "example.org/en/1", "block"),
        "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://casino-royal.example.org/a": ("casino-royal.example.org", "/a", "org/", "allow"),
        "http://www.x.com/de/": ("www.x.com", "/de/", "com/de/", "block"),
        "http://x.com/DE/": ("x.com", "/DE/", None, None),
        "http://x.org": ("x.org", "", None, None),
        "http://x.org?a=/es/": ("x.org", "", None, None),
        "no scheme.org/es/": ("", "", None, None),
        "": ("", "", None, None),
    }
    pages = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(99, None), (None, "http://q.org/"), (0, next(iter(cases)))], "page_id long, url string"))
    rows = urls.filter_urls(pages, RULES).collect()
    assert len(rows) == len(cases) + 3
    got = {r.page_id: r for r in rows}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert got[99].rule is None and got[99].verdict in ("allow", "block") and got[None].verdict == "allow"
    assert urls.filter_urls(pages.where("false"), RULES).count() == 0


def test_url_regression_on_unseen_hosts(spark):
    bad = ["spam-city", "mega-casino", "adult-zone", "cheap-deals", "free-gifts"]
    good = ["thereon", "valley", "botany", "swimming", "go-club"]
    pages = spark.createDataFrame([(i, f"https://www.{h}.example.net/en/{i}") for i, h in enumerate(bad + good)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, []).collect()}
    assert [got[i] for i in range(10)] == ["block"] * 5 + ["allow"] * 5
    with pytest.raises(Exception):
        urls.filter_urls(pages.drop("url"), []).count()


def test_texts_without_a_label_are_left_out_before_the_join(spark):
    docs = spark.range(20_000).select((F.col("id") * 7 - 9_000).alias("doc_id"), F.col("id").cast("string").alias("text"))
    known = docs.where("pmod(doc_id, 4) = 1").select("doc_id")
    n = known.count()
    for most, passed in ((64, 0.15), (1, 1.0)):  # a table large enough, and one that is too small
        got = toxicity.likely_labelled(docs.unionByName(docs.where("doc_id < 0")), known, n, most)
        assert got.join(known, "doc_id", "left_semi").count() == n + known.where("doc_id < 0").count()
        assert got.where("pmod(doc_id, 4) <> 1").count() <= passed * (30_000 - n)
    none = docs.where("false")
    assert toxicity.likely_labelled(none, known, n).count() == toxicity.likely_labelled(docs, none, 0).count() == 0
