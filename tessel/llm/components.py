"""Connected components of an edge table.

Each task first reduces its own edges to a forest (union-find), which keeps what is reachable. If
no more than ``BOUND`` edges are left, one task reads these and finishes; it holds some 100 bytes
for each. Beyond that alternating large-star and small-star steps go on: each rewrites the edges
so that nodes hang on smaller nodes (Kiveris et al., Connected Components in MapReduce and
Beyond, 2014); some log of the longest path steps are needed. Both ways give the same roots.
Edges stay in Spark and are written to the shared folder after each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, with_looked_up


#: Edges that one task works on, at most.
BOUND = 500_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each node with the smallest of its component among the edges (a, b) of the batches.
    Of more than ``BOUND`` nodes parts are given out in between, which are linked by the next step."""
    parent: dict = {}
    kind = None

    def top(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> Iterator[pa.RecordBatch]:
        nodes = list(parent)
        for at in range(0, len(nodes), 10_000):
            some = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array(list(map(top, some)), kind)], ["a", "b"])
        parent.clear()

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 2 * BOUND:
            yield from out()
    if parent:
        yield from out()


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or to itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return with_looked_up(both.filter("b > a"), least, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's smaller neighbours, and the node itself, are linked to the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return with_looked_up(down, least, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, bound: int = BOUND) -> DataFrame:
    """(node, root) for each node that has an edge and isn't the smallest of its component.
    ``edges``: columns a, b of one orderable type; loops and repeated edges do no harm, and
    rows with a null are left out. A hub's neighbours are joined by broadcast, so its edges stay
    spread out; tables of past rounds are deleted."""
    rows = edges.select("a", "b").filter("a <> b")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    now = stored(rows.mapInArrow(forest, kind), "edges")
    total, last = now.count(), None
    if total <= bound:
        done = stored(now.coalesce(1).mapInArrow(forest, kind), "roots")
        discard(now)
        return done.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        between = stored(large_star(now, total), "edges")
        after = stored(small_star(between, total), "edges")
        discard(now)
        discard(between)
        now, n = after, after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        total, last = n[0], n
