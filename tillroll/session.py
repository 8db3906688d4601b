"""Spark session settings the reports rely on.

The library never picks a master or a cluster size; it only sets the SQL
options whose values change results or plans:

* session time zone UTC, so wall-clock order dates are never shifted;
* adaptive execution (coalescing, skew-join splitting) on;
* ANSI mode left at its Spark 4 default (on) — text is coerced with
  ``try_cast`` so bad values never throw.

``checkpoint_dir`` returns the shared folder named by ``spark.checkpoint.dir``;
only a local-mode session without one gets a fresh temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a side is broadcast only when its measured size is under this bound
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # Spark's default; the query that joins items within their ranges of ids turns it off
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tillroll") -> SparkSession:
    """Session for tests, the bench and the driver smoke check."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # a report service runs dozens of query shapes: keep their compiled
        # whole-stage classes instead of recompiling evicted ones (default 100)
        .config("spark.sql.codegen.cache.maxEntries", "2000")
    )
    for key, value in SQL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


#: Temporary folders of local sessions without a checkpoint folder.
_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    Uses ``spark.checkpoint.dir`` when the cluster names one.  Only a local
    session (tests, bench) without it gets a private temporary folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a shared folder (HDFS/S3/...) "
            "before running streams or lineage cuts on a cluster")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="tillroll-ckpt-")
        spark.sparkContext.setCheckpointDir(_LOCAL_DIRS[application])
    return _LOCAL_DIRS[application]


_SCRATCH: list[str] = []
_REGISTRIES: list[dict] = []


def registry() -> dict:
    """A dict of frames kept for the session, emptied when their folders go."""
    _REGISTRIES.append({})
    return _REGISTRIES[-1]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders this process made, when their frames are no
    longer read; returns how many there were.  Works on any shared store.  Frames
    kept for the session are forgotten: the next report stores its own anew."""
    for registry in _REGISTRIES:
        registry.clear()
    gone = 0
    while _SCRATCH:
        folder = _SCRATCH.pop()
        fs, path = file_system(spark, folder)
        gone += bool(fs.delete(path(folder), True))
    return gone


def file_system(spark: SparkSession, folder: str):
    """(the store that holds ``folder``, the function that makes its paths)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _files(spark: SparkSession, paths: list[str]) -> list:
    """The status of each file of ``paths`` (files, or folders of them)."""
    found = []
    for name in paths:
        fs, path = file_system(spark, name)
        found += fs.listStatus(path(name))
    return found


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """The files of ``paths`` (files, or folders of them) with their sizes and times."""
    return "\n".join(sorted(f"{status.getPath().toString()} {status.getLen()} {status.getModificationTime()}"
                            for status in _files(spark, paths)))


def publish(spark: SparkSession, folder: str, number: int, text: str) -> bool:
    """Make ``text`` the pointer ``number`` of ``folder``: written aside, then put in
    place by one rename.  False if that number was published before."""
    fs, path = file_system(spark, folder)
    target, aside = path(f"{folder}/{number}"), path(f"{folder}/_{uuid.uuid4().hex}")
    if fs.exists(target):
        return False
    fs.mkdirs(path(folder))
    out = fs.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(aside, target):
        fs.delete(aside, False)
        return False
    return True


def published(spark: SparkSession, folder: str, number: int | None = None) -> tuple[int, str | None]:
    """(number, text) of pointer ``number`` of ``folder``, the greatest if not given;
    (-1, None) without one."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path(folder)):
        return -1, None
    names = [status.getPath().getName() for status in fs.listStatus(path(folder))]
    numbers = [int(name) for name in names if name.isdigit() and number in (None, int(name))]
    if not numbers:
        return -1, None
    source = fs.open(path(f"{folder}/{max(numbers)}"))
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    source.close()
    return max(numbers), text


def range_partitions(spark: SparkSession) -> int:
    """Range partitions of a written or ranked table: as many as a shuffle has
    (set ``spark.sql.shuffle.partitions`` to the data), one per core at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of source files behind a partition of the tables written from them (some
#: 700,000 order lines), so that a task sorts its rows in memory.
PART_BYTES = 8 << 20


def data_partitions(spark: SparkSession, paths: list[str]) -> int:
    """Partitions of the tables that are written from the files of ``paths``: in
    proportion to their bytes, ``range_partitions`` at least."""
    size = sum(status.getLen() for status in _files(spark, paths))
    return max(range_partitions(spark), -(-size // PART_BYTES))


@contextmanager
def sized(spark: SparkSession, partitions: int) -> Iterator[None]:
    """The jobs run inside shuffle into ``partitions`` partitions, at least as many as
    the session has, which adaptive execution merges to ``PART_BYTES`` at most, and read
    small splits: no task meets more rows than it can sort in memory, whatever the size of
    the whole.  A task that writes a few folders or buckets
    keeps them open together, so rows that are in order need no sorting for them."""
    put = {"spark.sql.shuffle.partitions": str(max(partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))),
           "spark.sql.files.maxPartitionBytes": str(2 * PART_BYTES),
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PART_BYTES),
           "spark.sql.maxConcurrentOutputFileWriters": "16"}
    before = {key: spark.conf.get(key) for key in put}
    for key, value in put.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def write_table(df, name: str):
    """Write ``df`` as parquet in the shared checkpoint folder and return a
    frame reading it: one job, lineage cut, and the rows survive the loss
    of any executor (unlike a cache or a local checkpoint)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
