"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Smallest member of each node's group."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(root)}


def _contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars around the least node of each group that it can see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        stars = [(x, y) for x, y in union_find(pairs).items() if x != y]
        for at in range(0, len(stars), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars[at : at + 10_000]], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b), component being its smallest node.

    Large stars link every larger neighbour of a node to the least one, small stars do so for
    the smaller ones; after a logarithmic number of rounds only stars are left (Kiveris et al., 2014).
    Each round is written to the shared folder; only counts reach the driver. A node with many
    neighbours takes part in sums and in joins that can be split; as edges grow with the corpus, nothing is broadcast. Loops and repeated edges do no harm.
    """
    now = written(_contracted(edges.where(F.col("a") != F.col("b"))).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        large = written(_contracted(large).distinct(), "edges")
        lower = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = lower.groupBy("a").agg(F.min("b").alias("m"))
        small = lower.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        then = written(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        seen = tuple(then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(now)
        discard(large)
        now = then
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
