"""Connected components of an edge table, without collecting it.

Alternating large-star / small-star rounds (Kiveris et al., "Connected
components in MapReduce and beyond"): every round replaces the edges by stars
around smaller nodes until nothing changes; the number of rounds grows with the
logarithm of a component's size.  Each round's edges are a written table, so a
lost executor costs one round's partitions at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import UnionFind, write_table


#: Nodes whose components a task keeps in memory while it thins out its edges.
FOREST_NODES = 1_000_000


def _stars(sets: UnionFind) -> Iterator[pa.RecordBatch]:
    nodes = [x for x in sets.parent if sets.find(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i:i + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([sets.find(x) for x in part], pa.int64()), pa.array(part, pa.int64())],
            names=["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars (same connectivity, fewer rows), a
    stretch of ``FOREST_NODES`` nodes at a time."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        if len(sets.parent) >= FOREST_NODES:
            yield from _stars(sets)
            sets = UnionFind()
    yield from _stars(sets)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, no nulls) -> (node, root): one row per node that
    has an edge to another node; ``root`` is the smallest node of its component.

    Self-loops, repeated edges and either direction are allowed; an empty table
    gives an empty table."""
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    links = write_table(links.mapInArrow(_forest, "a long, b long").distinct(), "components")
    while True:
        # large star: every node sends its larger neighbours to its smallest neighbour or itself
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a")
                 .select(F.col("m").alias("a"), "b").distinct())
        # small star: every node sends its smaller neighbours, and itself, to the smallest of them
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(down, "b")
                 .select(F.explode(F.array(
                     F.struct(F.col("m").alias("a"), F.col("a").alias("b")),
                     F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a < b").distinct())
        after = write_table(small, "components")
        same = (after.withColumn("s", F.lit(1)).union(links.withColumn("s", F.lit(2)))
                .groupBy("a", "b").agg(F.sum("s").alias("s")).where("s <> 3").limit(1))
        links, done = after, same.isEmpty()
        if done:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
