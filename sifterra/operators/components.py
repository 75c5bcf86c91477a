"""Connected components of an edge table (alternating large-star and small-star).

No group is ever gathered: each step is a partial ``min`` per node and an equi-join
that adaptive execution may split.  Before the loop each partition contracts its own
edges to a forest, which leaves at most one edge per node and partition (and per
``FOREST_NODES`` nodes, which bounds a task's memory).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifterra.storage import discard, materialize

#: Nodes that a task contracts at once; edges, after contraction, that one task may finish.
FOREST_NODES, LAST_EDGES = 1_000_000, 20_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    def flush() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in root if find(x) != x]
        for at in range(0, len(nodes), 100_000):
            part = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["u", "v"])
        root.clear()

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > FOREST_NODES:
            yield from flush()
    yield from flush()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges`` (two long columns).

    ``component`` is the smallest node id that can be reached.  Null ends and self-loops
    are left out; repeated edges count once; an empty table gives an empty result.
    Nodes without edges do not appear: the caller keeps them as their own component.
    """
    start = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = materialize(start.mapInArrow(_forest, "u long, v long").distinct(), "edges")
    if e.count() <= LAST_EDGES:  # a bounded rest: one task contracts it to its components
        last = materialize(e.coalesce(1).mapInArrow(_forest, "u long, v long"), "edges")
        discard(e)
        return _labels(last)
    seen = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "edges")
        discard(e)
        e = new
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return _labels(e)


def _labels(stars: DataFrame) -> DataFrame:
    own = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(own)
