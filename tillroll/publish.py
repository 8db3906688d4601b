"""Published report results: the last complete one stays readable.

A run writes its rows to a folder of its own and then publishes a pointer by one
rename (``session.publish``), keyed by report and parameters.  A run that is
interrupted leaves the earlier result in place; one that runs again publishes
again; readers take the greatest pointer.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from .model import Params
from .session import file_system, publish, published


def result_folder(folder: str, report: str, params: Params) -> str:
    """Where the results of ``report`` with ``params`` lie."""
    key = hashlib.sha256(repr(params).encode()).hexdigest()[:16]
    return f"{folder.rstrip('/')}/{report}/{key}"


def publish_report(result: DataFrame, folder: str, report: str, params: Params, keep: int = 2) -> int:
    """Write ``result`` and make it the current one; returns its number.  The last
    ``keep`` results stay for readers that are still at an earlier one."""
    spark, base = result.sparkSession, result_folder(folder, report, params)
    run = uuid.uuid4().hex
    result.write.parquet(f"{base}/runs/{run}")
    number = published(spark, f"{base}/pointers")[0] + 1
    while not publish(spark, f"{base}/pointers", number, run):  # another run was first: this one is later
        number += 1
    _drop(spark, base, keep)
    return number


def _drop(spark: SparkSession, base: str, keep: int) -> None:
    fs, path = file_system(spark, base)
    numbers = sorted(int(n) for s in fs.listStatus(path(f"{base}/pointers")) if (n := s.getPath().getName()).isdigit())
    for number in numbers[:-keep]:
        run = published(spark, f"{base}/pointers", number)[1]
        fs.delete(path(f"{base}/pointers/{number}"), False)
        fs.delete(path(f"{base}/runs/{os.path.basename(run)}"), True)


def read_report(spark: SparkSession, folder: str, report: str, params: Params) -> DataFrame | None:
    """The current result, or None when none was published."""
    base = result_folder(folder, report, params)
    run = published(spark, f"{base}/pointers")[1]
    return None if run is None else spark.read.parquet(f"{base}/runs/{run}")
