"""Exact top-k search by integer inner product with M-trees, best first.

Vectors become integers (floor of ``SCALE`` times each component).  The rows are
dealt by their id into trees of about ``TREE_ROWS`` vectors.  In a tree every vector
gets one more coordinate that makes all lengths equal to the longest one, so that
the largest inner product is the smallest Euclidean distance, which is a metric.
Nodes are pages: a routing page has pivots with covering radius, distance to the
parent's pivot and child page; a leaf page has vectors with that distance.  The
search takes pages in the order of their lower bound from a queue and leaves out,
without computing a distance, every entry for which the stored distances and the
triangle inequality already show that it cannot be among the best k.  Bounds only
ever leave out what is worse by more than rounding, and scores are exact.

Trees are stored pages; each meets every block of queries through an equi-join on
the tree's number, so no task ever holds more than one tree and one block, and
the best k of each tree are merged by a bounded top-k.  The work is queries times
trees, as the query set is part of the question.

Rows take no part whose id or vector is null or whose vector holds a null or
non-finite component; vectors of another dimension than the query's are no
candidates of it.  Rows that repeat id and vector count once, and rows with the
query's own id are its own.  Ties go to the smaller id.  An empty table gives no
rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligora.operators.ranking import top_k
from eligora.session import cut

SCALE = 1024
TREE_ROWS = 4096
LEAF = 48
FANOUT = 12
QUERY_BLOCK = 128
PAGES = "tree long, dim int, page int, leaf boolean, ids array<long>, vectors binary, norms array<double>, parent array<double>, radius array<double>, child array<int>, longest double"


def integers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, v): rows that take part, once each."""
    x = F.col(vector_col)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & x.isNotNull()).where(whole)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v")).withColumn("dim", F.size("v")).distinct()


def build_pages(ids: np.ndarray, vectors: np.ndarray) -> Iterator[dict]:
    """Pages of the tree over the rows of ``vectors``; page 0 is the root."""
    squares = (vectors.astype(float) ** 2).sum(axis=1)
    longest = float(squares.max())
    lifted = np.column_stack([vectors, np.sqrt(longest - squares)])
    far = lambda rows, pivot: np.sqrt(np.maximum(((lifted[rows] - lifted[pivot]) ** 2).sum(axis=1), 0))
    queue, pages = [(0, np.arange(len(ids)), None)], 1
    for number, rows, parent in queue:
        to_parent = lambda r: far(r, parent) if parent is not None else np.zeros(len(r))
        spread = []
        if len(rows) > LEAF:
            pivots, nearest = [int(rows[0])], far(rows, rows[0])
            owner = np.zeros(len(rows), int)
            while len(pivots) < FANOUT and nearest.max() > 0:
                pivots.append(int(rows[np.argmax(nearest)]))
                d = far(rows, pivots[-1])
                owner[d < nearest] = len(pivots) - 1
                nearest = np.minimum(nearest, d)
            spread = [(p, rows[owner == k], float(nearest[owner == k].max())) for k, p in enumerate(pivots)]
        if len(spread) > 1:
            entries = np.array([p for p, _, _ in spread])
            yield dict(page=number, leaf=False, ids=ids[entries], vectors=vectors[entries], norms=squares[entries], parent=to_parent(entries),
                       radius=np.array([r for _, _, r in spread]), child=np.arange(pages, pages + len(spread)), longest=longest)
            queue += [(pages + k, own, p) for k, (p, own, _) in enumerate(spread)]
            pages += len(spread)
        else:
            yield dict(page=number, leaf=True, ids=ids[rows], vectors=vectors[rows], norms=squares[rows], parent=to_parent(rows), radius=np.zeros(0), child=np.zeros(0, int), longest=longest)


def trees(rows: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Stored pages of the trees over (vec_id, dim, v); trees of one dimension are numbered from 0."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        made = list(build_pages(group.vec_id.to_numpy(), np.stack(group.v.to_list()).astype(np.int64)))
        return pd.DataFrame([{**p, "tree": int(group.tree.iloc[0]), "dim": int(group.dim.iloc[0]), "vectors": p["vectors"].astype("<i8").tobytes(),
                              **{k: p[k].tolist() for k in ("ids", "norms", "parent", "radius", "child")}} for p in made])

    counts = rows.groupBy("dim").agg(F.ceil(F.count("*") / tree_rows).alias("n_trees"))
    dealt = rows.where("dim > 0").join(counts, "dim").withColumn("tree", F.pmod(F.xxhash64("vec_id"), F.col("n_trees")))
    return cut(dealt.select("tree", "dim", "vec_id", "v").groupBy("tree", "dim").applyInPandas(build, PAGES))


class Search:
    """Best-first search in one tree."""

    def __init__(self, pages: list[dict], dim: int) -> None:
        self.pages = {p["page"]: p for p in pages}
        self.longest = pages[0]["longest"]
        for p in pages:
            p["matrix"] = np.frombuffer(p["vectors"], "<i8").reshape(-1, dim)
            for k in ("ids", "norms", "parent", "radius"):
                p[k] = np.array(p[k])
        self.computed = self.avoided = 0

    def best(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k largest (score, vec_id), ties to the smaller id."""
        square = float((query.astype(float) ** 2).sum())
        slack = 1e-6 * (np.sqrt(square) + np.sqrt(self.longest) + 1)
        found: list[tuple[int, int]] = []  # (score, -vec_id), the worst first
        limit = np.inf
        queue = [(0.0, 0, None)]
        while queue:
            bound, number, to_pivot = heapq.heappop(queue)
            if bound > limit + slack:
                break
            page = self.pages[number]
            matrix, reach = page["matrix"], page["radius"] if not page["leaf"] else 0.0
            if to_pivot is not None:
                can = np.flatnonzero(np.abs(to_pivot - page["parent"]) - reach <= limit + slack)
            else:
                can = np.arange(len(matrix))
            if page["leaf"]:
                can = can[page["ids"][can] != own]
            self.computed, self.avoided = self.computed + len(can), self.avoided + len(matrix) - len(can)
            if not len(can):
                continue
            scores = matrix[can] @ query
            if page["leaf"]:
                ids = page["ids"][can]
                for i in np.lexsort((ids, -scores))[:k].tolist():
                    entry = (int(scores[i]), -int(ids[i]))
                    if len(found) < k:
                        heapq.heappush(found, entry)
                    elif entry > found[0]:
                        heapq.heapreplace(found, entry)
                    else:
                        break
                if len(found) == k:
                    limit = np.sqrt(max(square + self.longest - 2.0 * found[0][0], 0))
            else:
                distance = np.sqrt(np.maximum(square + self.longest - 2.0 * scores, 0))
                low = np.maximum(distance - page["radius"][can], 0)
                for i in np.flatnonzero(low <= limit + slack).tolist():
                    heapq.heappush(queue, (float(low[i]), int(page["child"][can[i]]), float(distance[i])))
        return [(s, -i) for s, i in sorted(found, reverse=True)]


def search(pages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each query (vec_id, dim, v)."""
    n_trees = pages.groupBy("dim").agg((F.max("tree") + 1).alias("n_trees"))
    sizes = queries.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("n_blocks"))
    dealt = queries.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")))
    blocks = dealt.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    sent = blocks.join(n_trees, "dim").withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_trees") - 1))).select("dim", "tree", "queries")
    names = [c for c in pages.columns if c not in ("tree", "dim")]
    whole = pages.groupBy("dim", "tree").agg(F.collect_list(F.struct(*names)).alias("pages"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                tree = Search([p if isinstance(p, dict) else p.asDict() for p in row.pages], row.dim)
                for q in row.queries:
                    out += [(q["vec_id"], i, s) for s, i in tree.best(q["vec_id"], np.array(q["v"], np.int64), k)]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    hits = sent.join(whole, ["dim", "tree"]).select("dim", "pages", "queries").mapInPandas(run, "query_id long, vec_id long, score long")
    return top_k(hits, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def inner_product_top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows for every row that meets ``is_query`` (over vec_id), against all rows but its own."""
    rows = cut(integers(vectors, id_col, vector_col))
    return search(trees(rows), rows.where(is_query), k)
