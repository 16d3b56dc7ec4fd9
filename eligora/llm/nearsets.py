"""Near-duplicate documents by SetSketch registers over word shingles, confirmed on full sets.

A document's set is its distinct ``width``-word shingles (lower-cased A-Z, words
between ASCII white space).  The SetSketch of a set has ``REGISTERS`` one-byte
registers: the smallest of the set's exponential hash values, on a scale of
powers of ``SCALE`` and truncated at both ends.  Registers of a union are the
maxima of its parts' registers, and two registers agree the more often the more
alike the sets are, so bands of registers find candidates.  The similarity of a
candidate pair is estimated by maximum likelihood from how many registers are
larger, smaller and equal and from the two set sizes; pairs that stay below the
threshold by ``MARGIN`` (over five standard errors) are left out, all others are
confirmed on the sets themselves.

Copies have one node, the digest of their set.  A bucket's leader is the node that
shares most buckets with others, which in a group of edited copies is the text
nearest to all.  Every node is compared with one leader, the one it shares most
buckets with; promising pairs tie texts to families.  In buckets that still hold
several families every node is compared once more with one leader of another family,
so a node has two links at most however large its group is.  What is then still in
different families in one bucket is compared by registers, those outside its largest
family with all, in blocks, and promising pairs join the families.  Families whose
links leave them in several components are compared on their sets: the nodes outside
the largest component with all nodes, in blocks bounded by members and by the sizes
of their sets.  So every pair of a bucket is compared or tied already, neither a
bucket nor a family ever stands in one task, and no list of all pairs is made.  Two
texts with similarity 0.85 share no band with probability 1e-8 (0.8: 1e-5).

Texts without a word are linked with nothing.  Rows with a null doc_id are linked
like others but never give a component its name; a component of such rows alone
has a null component_id and keeps all of them.  Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligora.llm.batches import LOWER, Block, blocks, mix, random64, span_hashes, window_hashes, word_spans
from eligora.llm.components import components
from eligora.session import cut

REGISTERS = 216
ROWS = 6
BANDS = REGISTERS // ROWS
SCALE = 1.1
RATE = 20.0
TOP = 255
MARGIN = 0.13
BLOCK_MEMBERS = 256
BLOCK_ITEMS = 400_000
SLICE = 1 << 13


def shingle_sets(block: Block, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = Block(block.rows, LOWER[block.data], block.starts, block.ends)
    starts, ends, first = word_spans(low)
    words = span_hashes(low.data, starts, ends)
    windows = window_hashes(words, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(windows[a:b - width + 1])
        else:
            yield window_hashes(words[a:b], b - a) if b > a else words[:0]


def digest(items: np.ndarray) -> bytes:
    """128 bits of a set."""
    salt = np.uint64(0xA5A5A5A55A5A5A5A)
    return np.array([mix(items).sum(), mix(items ^ salt).sum()], np.uint64).tobytes()


_XOR = random64(REGISTERS, 3).astype(np.uint32)
_ODD = random64(REGISTERS, 4).astype(np.uint32) | np.uint32(1)


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch of a set of 64-bit hashes."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 512):
        least = np.minimum(least, ((short[k:k + 512, None] ^ _XOR) * _ODD).min(axis=0))
    exponential = -np.log1p(-(least + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(SCALE)), 0, TOP).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 101)


def likely_similarity(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, from registers of a larger / smaller than those of b and the set sizes."""
    share = (n_a / (n_a + n_b))[:, None]
    cap = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    j = _GRID[None, :] * cap[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (SCALE - 1) / SCALE) / np.log(SCALE)
    up, down = p(share - (1 - share) * j), p((1 - share) - share * j)
    same = np.maximum(1 - up - down, 1e-12)
    fit = (larger[:, None] * np.log(np.maximum(up, 1e-12)) + smaller[:, None] * np.log(np.maximum(down, 1e-12))
           + (REGISTERS - larger - smaller)[:, None] * np.log(same))
    return j[np.arange(len(j)), np.argmax(fit, axis=1)]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), REGISTERS)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, node, registers); node and registers are null for texts without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sizes, nodes, regs = [], [], []
                for items in shingle_sets(block, width):
                    sizes.append(len(items))
                    nodes.append(digest(items) if len(items) else None)
                    regs.append(registers(items).tobytes() if len(items) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0)[block.rows], pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(regs, pa.binary())],
                                                 ["doc_id", "n_shingles", "node", "registers"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, node binary, registers binary")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, items) with the whole set of every text that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                sets = [s for s in shingle_sets(block, width) if len(s)]
                offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))],
                                                 ["node", "items"])

    return docs.select("text").mapInArrow(run, "node binary, items array<long>")


def _promising(pairs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) with both sketches whose likely similarity comes up to the threshold less the margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = _matrix(batch.column("ra")), _matrix(batch.column("rb"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            close = likely_similarity((x > y).sum(axis=1), (x < y).sum(axis=1), n_a, n_b) >= threshold / 100 - MARGIN
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(close)), batch.column("b").filter(pa.array(close))], ["a", "b"])

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a binary, b binary")


def _joining_pairs(groups: DataFrame, threshold: int) -> DataFrame:
    """Promising pairs between the two blocks of a bucket that join what is still in different families.

    ``groups``: lists m of (node, family, n, registers, left); nodes with ``left`` are compared with all others of the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0):
                m = group.values
                nodes, families = m.field("node").to_pylist(), m.field("family").to_pylist()
                n, regs = m.field("n").to_numpy().astype(float), _matrix(m.field("registers"))
                _, kind = np.unique(np.array([f.hex() for f in families]), return_inverse=True)
                left = np.flatnonzero(m.field("left").to_numpy(zero_copy_only=False))
                same = np.zeros((len(left), len(nodes)), np.uint8)
                for x in np.ascontiguousarray(regs.T):
                    same += x[left][:, None] == x[None, :]
                # fewer equal registers than this are six standard errors from a pair at the threshold
                open_ = (same >= (threshold / 100 - 0.15) * REGISTERS) & (kind[left][:, None] != kind[None, :])
                open_ &= 100 * np.minimum(n[left][:, None], n[None, :]) >= threshold * np.maximum(n[left][:, None], n[None, :])
                a, b = np.nonzero(open_)
                a = left[a]
                known: dict = {}

                def top(x):
                    while known.get(x, x) != x:
                        x = known[x]
                    return x

                out_a, out_b = [], []
                for low in range(0, len(a), SLICE):
                    i, j = a[low:low + SLICE], b[low:low + SLICE]
                    x, y = regs[i], regs[j]
                    close = likely_similarity((x > y).sum(axis=1), (x < y).sum(axis=1), n[i], n[j]) >= threshold / 100 - MARGIN
                    for p, q in zip(i[close].tolist(), j[close].tolist()):
                        u, v = top(kind[p]), top(kind[q])
                        if u != v:
                            known[max(u, v)] = min(u, v)
                            out_a.append(nodes[p])
                            out_b.append(nodes[q])
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    return groups.mapInArrow(run, "a binary, b binary")


def _mixed(full: DataFrame, family: DataFrame | None) -> DataFrame:
    """(bucket, node, family) of the buckets that hold several families; without ``family`` every node is its own."""
    if family is None:
        return full.select("bucket", "node", F.col("node").alias("family"))
    placed = full.select("bucket", "node").join(family, "node", "left").withColumn("family", F.coalesce("family", "node"))
    several = placed.groupBy("bucket").agg(F.min("family").alias("x"), F.max("family").alias("y")).where("x <> y").select("bucket")
    return cut(placed.join(several, "bucket"))


def _leader_links(mixed: DataFrame, weight: DataFrame) -> DataFrame:
    """(a, b): for every node b the leader a of another family that it shares most buckets with; one row per node at most."""
    weighed = mixed.join(weight, "node")
    leaders = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node", "family")).alias("best")).select("bucket", F.col("best.node").alias("leader"), F.col("best.family").alias("led"))
    shared = mixed.join(leaders, "bucket").where("family <> led").groupBy("node", "leader").agg(F.count("*").alias("n"))
    return shared.groupBy("node").agg(F.max(F.struct("n", "leader")).alias("best")).select(F.col("best.leader").alias("a"), F.col("node").alias("b"))


def _tied(family: DataFrame | None, near: DataFrame) -> DataFrame:
    """(node, family) after more promising pairs: the links between families are contracted before their components are sought."""
    if family is None:
        return components(near).select("node", F.col("root").alias("family"))
    of = lambda x: family.select(F.col("node").alias(x), F.col("family").alias(f"f{x}"))
    named = near.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("fa", "a").alias("fa"), F.coalesce("fb", "b").alias("fb"))
    merged_ = components(named.select("fa", "fb").where("fa <> fb"), "fa", "fb").select(F.col("node").alias("family"), "root")
    every = family.unionByName(near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(family, "node", "left_anti").withColumn("family", F.col("node")))
    return cut(every.join(merged_, "family", "left").select("node", F.coalesce("root", "family").alias("family")))


def _across_families(mixed: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Promising pairs that join families which meet in a bucket; ``mixed``: (bucket, node, family)."""
    sizes = mixed.groupBy("bucket", "family").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "family")).alias("main")).select("bucket", "size", F.col("main.family").alias("main"))
    rest = cut(mixed.join(main, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK_MEMBERS)).cast("long")))
    sketch = classes.select("node", "n", "registers")
    every = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK_MEMBERS) - 1)
    member = lambda left: F.struct("node", "family", "n", "registers", F.lit(left).alias("left"))
    apart = rest.where("family <> main")
    outside = apart.join(sketch, "node").select("bucket", F.col("part").alias("i"), F.explode(every).alias("j"), member(True).alias("m"))
    inside = rest.join(apart.select("bucket", F.col("part").alias("i")).distinct(), "bucket").join(sketch, "node").select("bucket", "i", F.col("part").alias("j"), member(False).alias("m"))
    groups = outside.unionByName(inside).groupBy("bucket", "i", "j").agg(F.collect_list("m").alias("m"))
    return _joining_pairs(groups.select("m"), threshold).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links: pairs whose sets have 100 * |intersection| >= threshold * |union|."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b")
    common = F.size(F.array_intersect("ia", "ib"))
    return both.where(100 * common >= threshold * (F.size("ia") + F.size("ib") - common)).select("a", "b")


def _missing_links(groups: DataFrame, threshold: int) -> DataFrame:
    """Links between the two blocks of a family that join what is still apart.

    ``groups``: lists m of (node, root, items, left); nodes with ``left`` are compared with all others of the list.
    All intersections of a list come from products of 0/1 matrices, taken over slices of the shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0):
                m = group.values
                nodes, roots = m.field("node").to_pylist(), m.field("root").to_pylist()
                left = np.flatnonzero(m.field("left").to_numpy(zero_copy_only=False))
                items = m.field("items")
                sizes = np.diff(items.offsets.to_numpy()).astype(float)
                values = items.values.slice(items.offsets[0].as_py(), int(sizes.sum())).to_numpy()
                _, column = np.unique(values, return_inverse=True)
                row = np.repeat(np.arange(len(nodes)), sizes.astype(int))
                order = np.argsort(column, kind="stable")
                row, column = row[order], column[order]
                common = np.zeros((len(left), len(nodes)))
                for low in range(0, int(column[-1]) + 1, SLICE):
                    a, b = np.searchsorted(column, [low, low + SLICE])
                    part = np.zeros((len(nodes), min(SLICE, int(column[-1]) + 1 - low)), np.float32)
                    part[row[a:b], column[a:b] - low] = 1
                    common += part[left] @ part.T
                linked = 100 * common >= threshold * (sizes[left][:, None] + sizes[None, :] - common)
                known: dict = {}

                def top(x):
                    while known.get(x, x) != x:
                        x = known[x]
                    return x

                out_a, out_b = [], []
                for i, j in zip(*np.nonzero(linked)):
                    x, y = top(roots[left[i]]), top(roots[j])
                    if x != y:
                        known[max(x, y)] = min(x, y)
                        out_a.append(nodes[left[i]])
                        out_b.append(nodes[j])
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    return groups.mapInArrow(run, "a binary, b binary")


def _within_families(family: DataFrame, roots: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """All links that join components of one family: texts tied together by promising pairs.

    In each family the nodes outside its largest component are compared with all
    nodes of the family, a block of the former and a block of the latter per list.
    """
    placed = cut(family.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sets.select("node", F.size("items").alias("n_items")), "node"))
    sizes = placed.groupBy("family", "root").agg(F.count("*").alias("n"), F.sum("n_items").alias("n_items"))
    parts = F.greatest(F.ceil(F.sum("n") / BLOCK_MEMBERS), F.ceil(F.sum("n_items") / BLOCK_ITEMS))
    split = sizes.groupBy("family").agg(parts.alias("parts"), F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    rest = cut(placed.drop("n_items").join(split.select("family", F.col("main.root").alias("main"), "parts"), "family")
               .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("long")))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    member = lambda left: F.struct("node", "root", "items", F.lit(left).alias("left"))
    apart = rest.where("root <> main")
    outside = apart.join(sets, "node").select("family", F.col("part").alias("i"), F.explode(every).alias("j"), member(True).alias("m"))
    inside = rest.join(apart.select("family", F.col("part").alias("i")).distinct(), "family").join(sets, "node").select("family", "i", F.col("part").alias("j"), member(False).alias("m"))
    groups = outside.unionByName(inside).groupBy("family", "i", "j").agg(F.collect_list("m").alias("m"))
    return _missing_links(groups.select("m"), threshold)


def near_components(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach), kept.

    ``threshold`` in hundredths.  ``docs`` is read twice: for the sketches, and
    for the sets of those documents that share a bucket with another text.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = cut(sketches(docs, width))
    classes = cut(rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("low"), F.max(F.struct("n_shingles", "registers")).alias("s")).select("node", "low", F.col("s.n_shingles").alias("n"), F.col("s.registers").alias("registers")))
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.substring("registers", k * ROWS + 1, F.lit(ROWS))))
    buckets = classes.select("node", band).select("node", F.xxhash64("pos", "col").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    full = cut(buckets.join(sizes, "bucket"))
    weight = cut(full.groupBy("node").agg(F.sum("size").alias("weight")))
    wanted = full.select("node").distinct().join(classes, "node").select(F.col("low").alias("doc_id")).distinct()
    sets = cut(docs.where("doc_id is null").unionByName(docs.join(wanted, "doc_id", "left_semi")).transform(lambda d: full_sets(d, width)).dropDuplicates(["node"]))

    def sketched(pairs: DataFrame) -> DataFrame:
        side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))

    first = cut(_promising(sketched(_leader_links(_mixed(full, None), weight)), threshold))
    family = _tied(None, first)
    second = cut(_promising(sketched(_leader_links(_mixed(full, family), weight)), threshold))
    family = _tied(family, second)
    across = cut(_across_families(_mixed(full, family), classes, threshold))
    if not across.isEmpty():
        family = _tied(family, across)
    near = first.unionByName(second).unionByName(across)
    links = cut(_confirmed(near, sets, threshold))
    roots = components(links)
    more = cut(_within_families(family, roots, sets, threshold))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = (classes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_node = named.join(names, "root").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(by_node, "node", "left")
    name = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", name.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
