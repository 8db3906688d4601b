"""Approximate nearest neighbours: a forest of random-projection trees, searched
through one priority queue, with exact reranking of the candidates.

The trees' splits are fitted on at most ``SAMPLE_ROWS`` vectors (a parameter): a
node projects on the difference of two of its points and splits at the median,
until ``leaf`` sampled points are left.  Every vector is then dealt to its leaf in
every tree, so the index holds all rows.  A query walks all trees through a shared
queue ordered by how far it lies on the wrong side of the splits, nearest first,
until the leaves it has opened hold ``probe`` of all rows counted with their
repetition across trees; leaf sizes are counted over all rows.  What the opened
leaves hold is ranked by the exact distance.

Leaves are cut into blocks of at most ``BLOCK`` rows, so a task holds one block
and a batch of queries however full a leaf is.  Equal vectors are one entry of the
index with the ids it can contribute: an answer needs at most ``k`` of them, the
smallest, beside the query's own.

Results for odd input: vectors that are null, empty, all zero, or hold null or
non-finite components, and rows without an id, take no part, neither as queries
nor as candidates; vectors of another length than most are left out likewise;
repeated rows (same id and vector) count once; a query with fewer candidates than
``k`` gets all that are found; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import small_batches, stream_groups, write_table

SAMPLE_ROWS, TREES, LEAF = 20_000, 16, 128
#: Share of all rows, counted once for every tree in which they turn up, that a query opens.
PROBE = 1.8
BLOCK = 4096


@dataclass
class Forest:
    """Per node: split vector, offset, children (a leaf's number is -1 - child)."""

    splits: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]
    n_leaves: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each vector in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (inner := node >= 0).any():
                i = np.flatnonzero(inner)
                n = node[i]
                side = (np.einsum("ij,ij->i", x[i], self.splits[n]) > self.offsets[n]).astype(int)
                node[i] = self.children[n, side]
            out[:, t] = -1 - node
        return out

    def open(self, q: np.ndarray, sizes: np.ndarray, rows: float) -> list[int]:
        """Leaves for one query, nearest first, until they hold ``rows`` rows."""
        margins = self.splits @ q - self.offsets
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        found, got = [], 0
        while queue and got < rows:
            wrong, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                got += sizes[-1 - node]
                continue
            m = float(margins[node])
            for side, cost in ((0, m), (1, -m)):
                heapq.heappush(queue, (max(wrong, cost), int(self.children[node, side])))
        return found


def plant(x: np.ndarray, trees: int, leaf: int, seed: int = 7) -> Forest:
    """A forest over the sample ``x`` (may be empty: one leaf a tree)."""
    rng = np.random.default_rng(seed)
    splits, offsets, children, roots, leaves = [], [], [], [], 0
    dims = x.shape[1]

    for _ in range(trees):
        work: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
        while work:
            rows, parent, side = work.pop()
            me = None
            if len(rows) > leaf:
                for _ in range(3):
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    w = a - b
                    if (norm := np.linalg.norm(w)) > 0:
                        w = w / norm
                        p = x[rows] @ w
                        cut = float(np.median(p))
                        low = p <= cut
                        if 0 < low.sum() < len(rows):
                            me = len(splits)
                            splits.append(w), offsets.append(cut), children.append([0, 0])
                            work += [(rows[low], me, 0), (rows[~low], me, 1)]
                            break
            if me is None:
                leaves += 1
                me = -leaves
            if parent < 0:
                roots.append(me)
            else:
                children[parent][side] = me
    return Forest(np.array(splits).reshape(-1, dims), np.array(offsets, float), np.array(children, int).reshape(-1, 2), roots, leaves)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the rows that take part; floats stay floats, which halves what is
    moved, other numbers become doubles.  Distances are taken in doubles."""
    kind = df.schema[vec_col].dataType.elementType.typeName()
    v = F.col(vec_col) if kind == "float" else F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) < double('Infinity')) AND exists(v, x -> x <> 0)")
    return rows


def nearest(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
            trees: int = TREES, leaf: int = LEAF, probe: float = PROBE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, id, score): for the rows where ``queries`` (over column
    ``id``) holds, the ``k`` nearest other rows found, nearest first, ties to the
    smaller id; ``score`` is the Euclidean distance in double precision."""
    spark = df.sparkSession
    small_batches(spark)
    rows = write_table(usable(df, id_col, vec_col).distinct(), "ann-rows")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    dims = sizes["n"]
    rows = rows.where(F.size("v") == dims)
    # equal vectors: one entry, with the k + 1 smallest ids
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = write_table(numbered.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-entries")
    total = entries.count()
    sample = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(sample_rows).collect()
    forest = plant(np.array([r["v"] for r in sample], float).reshape(-1, dims), trees, leaf)
    shared = spark.sparkContext.broadcast(forest)

    def leaf_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.leaves(_matrix(batch.column(0), dims)).ravel())], names=["leaf"])

    counts = np.zeros(forest.n_leaves, np.int64)  # bounded by the sample
    for r in entries.select("v").mapInArrow(leaf_numbers, "leaf int").groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    blocks = spark.sparkContext.broadcast(np.maximum(1, -(-counts // BLOCK)))
    held = spark.sparkContext.broadcast(counts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = shared.value.leaves(_matrix(batch.column(0), dims)), batch.num_rows
            salt = batch.column(2).to_numpy(zero_copy_only=False)
            for t in range(at.shape[1]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[:, t]), pa.array((salt % blocks.value[at[:, t]]).astype(np.int32)),
                     pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int64()), batch.column(0), batch.column(1)],
                    names=["leaf", "block", "kind", "query_id", "v", "ids"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            for i in range(len(x)):
                leaf_no = np.array(shared.value.open(x[i], held.value, probe * total), np.int32)
                n = blocks.value[leaf_no]
                out_leaf = np.repeat(leaf_no, n)
                out_block = np.concatenate([np.arange(m) for m in n]) if len(n) else np.zeros(0)
                m = len(out_leaf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_leaf), pa.array(out_block.astype(np.int32)), pa.array(np.ones(m, np.int32)),
                     pa.array(np.full(m, batch.column(0)[i].as_py(), np.int64)),
                     batch.column(1).take(pa.array(np.full(m, i))), pa.nulls(m, pa.list_(pa.int64()))],
                    names=["leaf", "block", "kind", "query_id", "v", "ids"])

    schema = f"leaf int, block int, kind int, query_id long, v {rows.schema['v'].dataType.simpleString()}, ids array<long>"
    index = entries.select("v", "ids", F.abs(F.hash("v").cast("long")).alias("salt")).mapInArrow(deal, schema)
    # by number: a query's row is small, its search is not
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.where(queries).select("id", "v").repartition(tasks, "id").mapInArrow(search, schema)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, xs, ids = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf_no, block, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(np.concatenate([[True], (leaf_no[1:] != leaf_no[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])]))
            for s, e in zip(cuts, np.append(cuts[1:], len(leaf_no)), strict=True):
                here = (leaf_no[s], block[s])
                if here != at:
                    at, xs, ids = here, [], []
                x = _matrix(batch.column(4).slice(s, e - s), dims)
                if kind[s] == 0:
                    xs.append(x)
                    ids.extend(batch.column(5).slice(s, e - s).to_pylist())
                    continue
                if not xs:
                    continue
                xs = [np.concatenate(xs)] if len(xs) > 1 else xs
                asked_ids = batch.column(3).slice(s, e - s).to_pylist()
                for i, own in enumerate(asked_ids):
                    d = np.sqrt(((xs[0] - x[i]) ** 2).sum(axis=1))
                    near = np.argsort(d, kind="stable")[:k + 1] if len(d) <= k + 1 else _least(d, k + 1)
                    rows_out = [(own, j, float(d[p])) for p in near for j in ids[p] if j != own]
                    if rows_out:
                        q, j, dist = zip(*rows_out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(j, pa.int64()), pa.array(dist, pa.float64())],
                                                         names=["query_id", "id", "score"])

    both = index.union(asked).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind")
    near = both.mapInArrow(rerank, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return near.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _least(d: np.ndarray, n: int) -> np.ndarray:
    """All positions with one of the ``n`` least distances, ties included."""
    return np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
