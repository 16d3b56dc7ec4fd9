"""Connected components of a table of links: forests of each task's links, then rounds of joins where one task can't hold them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligora.llm.stored import stored

#: Links per task, and links that a task holds at once: few links are settled in one task, without a join; many have many tasks.
TASK_ROWS = 200_000


def _forests(links: DataFrame, most: int, roots: bool = False) -> DataFrame:
    """(node, root): for each task the nodes of its links with the smallest node they reach there; with ``roots`` these have a row too.

    A task holds ``most`` links at once and gives the forest of so many before it
    goes on; the rows are links with the same components as before.
    """
    links = links.toDF("node", "root").where("node <> root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        held = 0

        def top(x):
            path = []
            while (above := known.get(x, x)) != x:
                path.append(x)
                x = above
            for p in path:
                known[p] = x
            return x

        def made() -> pa.RecordBatch:
            nodes = list(known)
            nodes += {top(x) for x in nodes} if roots else ()
            return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], ["node", "root"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = top(a), top(b)
                if x != y:
                    known[max(x, y)] = min(x, y)
                held += 1
                if held == most:
                    yield made()
                    known.clear()
                    held = 0
        if known:
            yield made()

    return links.mapInArrow(run, links.schema)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node that can be reached; nodes without a link have no row.

    Each task first turns its links into a forest, and a second pass does so with
    ``TASK_ROWS`` of these in each task.  If that is one task, its trees are the
    components.  Else every round hangs each node on the smallest root among its
    neighbours and then follows roots to their roots, so that long chains need few
    rounds.  What a round uses twice is written into the shared folder: a plan that
    makes it again has several times the exchanges, whose threads and plans the
    driver holds, and a checkpoint keeps the estimated size of its plan, which joins
    multiply, so that after some rounds planning alone would take forever.
    """
    trees = stored(_forests(links.select(a, b), TASK_ROWS), "links")
    tasks = max(1, -(-trees.count() // TASK_ROWS))
    if tasks == 1:
        return stored(_forests(trees.coalesce(1), TASK_ROWS, roots=True), "roots")
    trees = _forests(trees.coalesce(tasks), TASK_ROWS)
    both = stored(trees.unionByName(trees.select(F.col("root").alias("node"), F.col("node").alias("root"))).distinct().toDF("node", "other"), "links").coalesce(tasks)
    state = stored(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")).coalesce(tasks), "roots")
    while True:
        met = both.join(state.select(F.col("node").alias("other"), F.col("root").alias("near")), "other").coalesce(tasks)
        near = met.groupBy("node").agg(F.min("near").alias("near"))
        moved = stored(state.join(near, "node").select("node", "root", F.least("root", "near").alias("near")).coalesce(tasks), "moved")
        hooks = moved.where("near < root").groupBy("root").agg(F.min("near").alias("hook"))
        hung = moved.join(hooks, "root", "left").select("node", F.col("root").alias("old"), F.least("near", F.coalesce("hook", "near")).alias("root")).coalesce(tasks)
        jump = hung.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = stored(hung.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")).coalesce(tasks), "roots")
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        state = new.select("node", "root")
