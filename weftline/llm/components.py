"""Connected components by alternating large stars and small stars, on DataFrames only.

Each round links the larger neighbours of every node to its least neighbour, then the smaller
ones; minima are partly aggregated before their shuffle, so a hub costs one row a task. Edges are
first contracted inside each partition, by spanning forests. Rounds end when the edges stay the same, which takes
about the square of the logarithm of their number at most; each round is written to the shared folder, so lineage stays short.

Defined results: edges of a node to itself and repeated edges change nothing; without edges there are no rows; the least node
of a component is its root, whatever the order of rows; null ends must not occur.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, written
from .common import ready, tidied


@tidied
def forest(batches):
    """Edges of each batch as stars around the least node."""
    for batch in batches:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        nodes = [x for x in up if top(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that isn't the least of its component. edges: two columns of longs."""
    ready(edges.sparkSession)
    e = written(edges.mapInArrow(forest, "node long, root long").distinct(), "edges")
    before = None
    while True:
        both = e.select(F.col("node").alias("a"), F.col("root").alias("b")).union(e.select("root", "node"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small, "a")
        last, e = e, written(linked.select(F.col("b").alias("node"), F.col("m").alias("root")).where("node != root").union(small.select("a", "m")).distinct(), "edges")
        forget(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == before:
            return e
        before = now


