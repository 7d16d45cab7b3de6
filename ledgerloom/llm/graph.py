"""Connected components of a large graph: forests of parts of its links, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored

#: Links that a task takes at most when it replaces them by a forest.
LINKS = 1 << 17


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links``; the root is the smallest node of its component.

    The links are dealt to tasks, LINKS each, and every task points the nodes of its own components at the smallest
    of them. Where there are several tasks, rounds then point nodes at the smallest node they know of. Links stay in the cluster and no node's
    neighbours meet in one task: smallest neighbours are partial sums, and the joins back to the links
    can be split by Spark where a node has many. Rounds grow with the logarithm of a component's size;
    each one is written to the shared folder, so a lost executor costs one round at most.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = stored(pairs.filter("u <> v"), "links")
    tasks = pairs.count() // LINKS + 1
    pairs = stored(pairs.repartition(tasks).mapInArrow(_forest, "u long, v long"), "links")
    before = _state(pairs) if tasks > 1 else (0,)
    while before[0]:
        pairs = stored(_small_star(_large_star(pairs)), "links")
        state = _state(pairs)
        if state == before:
            break
        before = state
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``u, v``: every node but the smallest of its component, and that smallest one."""
    up: dict[int, int] = {}

    def root(node: int) -> int:
        top = node
        while (above := up.setdefault(top, top)) != top:
            top = above
        while up[node] != top:
            up[node], node = top, up[node]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(u), root(v)
            up[max(x, y)] = min(x, y)
    found = [(node, root(node)) for node in list(up)]
    found = [(node, top) for node, top in found if node != top]
    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])


def _state(pairs: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(mark)).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Larger neighbours of a node are pointed at the smallest node among it and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    larger = both.filter("v > u").join(low, "u")
    return larger.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are pointed at the smallest of them."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low"))
    smaller = pairs.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return smaller.unionByName(low.select("u", F.col("low").alias("v"))).distinct()
