"""Connected components of a link table.

Links are contracted inside tasks of bounded size (a union-find over at most ``LINKS_A_TASK`` links
of one task) and, while they fill more than one task, by alternating large and small stars over the
whole table. Nothing is gathered on the driver but one count a round. A node with very many
links is an ordinary group of a partial aggregate, and the one join back to its minimum can be split
by adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.tables import stored

LINKS_A_TASK = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars with the components of this task's links: (node, smallest node)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = [(x, root(x)) for x in list(parent) if root(x) != x]
    for at in range(0, len(stars), 10_000):
        part = stars[at : at + 10_000]
        yield pa.record_batch([pa.array([x for x, _ in part], pa.int64()), pa.array([y for _, y in part], pa.int64())], names=["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, rounds: int = 60, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    ``links`` has integer columns a and b, in any order and with repeats; links of a node with
    itself, or with a null end, say nothing. An empty table gives an empty result.
    """
    clean = links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).filter("a <> b and a is not null and b is not null")
    state, mark = stored(clean, "links"), None
    for _ in range(rounds):
        tasks = -(-state.count() // links_a_task)
        # Coalescing moves no rows; more links than a task may hold stay in as many tasks.
        state = state.coalesce(max(1, tasks)).mapInArrow(_contract, "a long, b long")
        if tasks <= 1:
            state = stored(state, "links")
            break
        state = stored(_small_star(_large_star(stored(state, "links")).distinct()).filter("a <> b").distinct(), "links")
        # Unchanged means stars only: every node has one link down, and none is both above and below.
        seen = state.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(members.select(F.col("component").alias("node"), "component").distinct())
