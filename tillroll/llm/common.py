"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillroll.session import scratch_path, write_table

__all__ = ["read", "small_batches", "write_table", "scratch_path", "binary_values",
           "popcount", "UnionFind", "stream_groups"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold in a Python worker: whole texts can
    be long, so the bound is on bytes; a single row may still exceed it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def binary_values(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def popcount(x: np.ndarray) -> np.ndarray:
    """Set bits of each unsigned 64-bit value."""
    return np.bitwise_count(x)


class UnionFind:
    """Disjoint sets over hashable labels; the root is the smallest label."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = parent.setdefault(x, x)
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, bool]]:
    """Batches of rows sorted by ``keys`` (integer columns without nulls), cut
    at key changes.

    Yields ``(columns, starts, last_open)``: numpy columns of one batch, the row
    offsets where a new key begins (always 0 first), and whether the first
    group continues the previous batch's last one.  Nothing is carried over, so
    memory is one batch whatever the size of a group."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {name: batch.column(i).to_numpy(zero_copy_only=False)
                for i, name in enumerate(batch.schema.names)}
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        first = tuple(cols[k][0] for k in keys)
        continues = last is not None and first == last
        change[0] = True
        last = tuple(cols[k][-1] for k in keys)
        yield cols, np.flatnonzero(change), continues
