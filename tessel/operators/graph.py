"""Connected components of an edge table (a, b: bigint).

Each task reduces its edges to a forest by union-find, which keeps what is reachable. At most ``BOUND`` edges that are
left are finished in one task. Beyond that each node takes the smallest label among its neighbours and then its label's
own label, round by round, until none changes; tables of the rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.shared import new_folder

BOUND = 500_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): nodes below the smallest one that this task's edges link them to."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        path = []
        while x in above:
            path.append(x)
            x = above[x]
        for p in path:
            above[p] = x
        return x

    def told() -> pa.RecordBatch:
        nodes = list(above)
        made = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(n) for n in nodes], pa.int64())], ["a", "b"])
        above.clear()
        return made

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            low, high = sorted((top(a), top(b)))
            if low < high:
                above[high] = low
        if len(above) > 2 * BOUND:  # what is linked by several parts is linked in the next step
            yield told()
    if above:
        yield told()


def components(edges: DataFrame, bound: int = BOUND) -> DataFrame:
    """(node, root): each node that isn't the smallest of its component, with that one. Edges with a null are left out."""
    schema = "a bigint, b bigint"
    left = written(edges.select("a", "b").dropna().mapInArrow(forest, schema), "forest")
    n = left.count()
    if n <= bound:
        done = written(left.coalesce(1).mapInArrow(forest, schema), "roots")
        return done.select(F.col("a").alias("node"), F.col("b").alias("root"))
    both = written(left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    now, last = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), None
    while True:
        now = written(now, "labels")
        state = now.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if state == last:  # labels only ever fall
            return now.filter("node <> root")
        last = state
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = now.join(near, now["node"] == near["a"]).select("node", F.least("root", "near").alias("root"))
        own = now.select(F.col("node").alias("root"), F.col("root").alias("further"))
        now = lower.join(own, "root").select("node", F.least("root", "further").alias("root"))
