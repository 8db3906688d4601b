"""Upsert log of a stream: the newest row of each key, in a bounded number of files.

Batch ``b`` writes the keys it changed to ``log/batch=b``, with overwrite, so a
batch that runs again after a failure replaces its own output.  Every ``every``
batches the newest rows are folded into a snapshot:

1. a new folder ``snapshots/<b>-<random>`` takes the rows (and frames derived from
   them, such as totals);
2. the pointer file ``pointers/<b>`` is published by a rename, which is what makes
   the snapshot the current one: a crash before it leaves the old snapshot and all
   its later batches in place, and an unnamed folder;
3. what only snapshots before the previous one needed is deleted, so a reader that
   has taken the previous pointer can finish.

Readers take the greatest pointer, its snapshot, and the batches after it: at most
``2 * every`` batches lie in the log whatever the stream's age.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import file_system, publish, published

#: The batch that is there from the start, without rows.
EMPTY_BATCH = -1
COMPACT_EVERY = 50


class UpsertLog:
    """Rows of ``schema`` by ``key``.  ``keep`` is an SQL condition: newest rows that
    fail it are not carried into snapshots.  ``derived`` frames (functions of the
    newest rows) are stored with each snapshot."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: StructType, keep: str = "true",
                 derived: dict[str, Callable[[DataFrame], DataFrame]] | None = None, every: int = COMPACT_EVERY) -> None:
        self.spark, self.folder, self.key, self.schema = spark, folder.rstrip("/"), key, schema
        self.keep, self.derived, self.every = keep, derived or {}, every

    @property
    def _log(self) -> str:
        return f"{self.folder}/log"

    def start(self) -> None:
        """An empty batch: a stream that has seen no row reads as an empty one."""
        self.spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self._log}/batch={EMPTY_BATCH}")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self._log}/batch={batch_id}")
        if batch_id - self.snapshot()[0] >= self.every:
            self.compact(batch_id)

    def snapshot(self) -> tuple[int, str | None]:
        """(last batch in the current snapshot, its folder)."""
        number, name = published(self.spark, f"{self.folder}/pointers")
        return (EMPTY_BATCH, None) if name is None else (number, f"{self.folder}/snapshots/{name}")

    def changes(self, after: int) -> DataFrame:
        """The newest row of each key that a batch later than ``after`` changed."""
        rows = self.spark.read.schema(StructType([*self.schema.fields, StructField("batch", IntegerType())])).parquet(self._log)
        others = [c for c in self.schema.names if c != self.key]
        newest = rows.filter(F.col("batch") > after).groupBy(self.key).agg(F.max_by(F.struct(*others), "batch").alias("_row"))
        return newest.select(self.key, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*self.schema.names)

    def stored(self, folder: str | None, name: str = "rows") -> DataFrame | None:
        return None if folder is None else self.spark.read.parquet(f"{folder}/{name}")

    def rows(self) -> DataFrame:
        """The newest row of every key that meets ``keep``."""
        upto, folder = self.snapshot()
        changes = self.changes(upto)
        old = self.stored(folder)
        if old is not None:
            changes = old.join(changes.select(self.key), self.key, "left_anti").select(*self.schema.names).unionByName(changes)
        return changes.filter(self.keep)

    def compact(self, upto: int) -> None:
        """Fold all batches up to ``upto``, the last one written, into a new snapshot."""
        before, last = self.snapshot()
        name = f"{upto}-{uuid.uuid4().hex[:12]}"
        folder = f"{self.folder}/snapshots/{name}"
        self.rows().write.parquet(f"{folder}/rows")
        for part, make in self.derived.items():
            make(self.spark.read.parquet(f"{folder}/rows")).write.parquet(f"{folder}/{part}")
        if publish(self.spark, f"{self.folder}/pointers", upto, name):
            self._drop(before, last)

    def _drop(self, before: int, last: str | None) -> None:
        """Delete what readers of the snapshot that was current till now don't need."""
        fs, path = file_system(self.spark, self.folder)
        current = self.snapshot()[1]
        for status in fs.listStatus(path(self._log)):
            batch = status.getPath().getName().removeprefix("batch=")
            if batch.lstrip("-").isdigit() and EMPTY_BATCH < int(batch) <= before:
                fs.delete(status.getPath(), True)
        keep = {os.path.basename(f) for f in (current, last) if f}
        for status in fs.listStatus(path(f"{self.folder}/snapshots")):
            if status.getPath().getName() not in keep:
                fs.delete(status.getPath(), True)
