"""Embedding whitening by mixed-precision eigenvectors.

1. Vectors become fixed-point numbers, ``floor(scale * c) + offset``, so that sums
   and deviations are exact however the rows are partitioned.
2. Each task sums its vectors; the sums of all dimensions give the mean.
3. Each task sums the products of its centred vectors; tasks' matrices are added in
   two steps, a matrix at a time.  Only the covariance, at most ``MAX_DIMS`` squared,
   reaches the driver.
4. ``refined_eigen``: eigenvectors in float32, corrected by Ogita-Aishima iterations,
   which are matrix products in extended precision and double the correct digits
   each time.  Eigenvalues that lie too close for an iteration to part them form a
   cluster: its subspace is corrected as one, and the small matrix that the shifted
   covariance has in it is solved by the same procedure, in its own scale.
5. Tasks project their vectors; another pass over the whitened ones measures how far
   their covariance is from the identity.

Results for odd input: rows whose vector is null, empty, or holds null or non-finite
entries, and vectors of another length than most (ties: the shorter) take no part;
entries beyond 2**52 in magnitude after scaling count as that; repeated rows count
each time; rows without an id stay; a component without variance (rank below the
number of dimensions, equal vectors, a single row) has ``whitened`` null and is left
out of ``identity_error``; a deviation beyond 64 bits is null; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import small_batches

#: Largest number of dimensions: the covariance is solved on the driver.
MAX_DIMS = 1024
SCALE, OFFSET = 1024, 100_000
LIMIT = float(1 << 52)
High = np.longdouble


def _parted(values: np.ndarray, least: float) -> list[np.ndarray]:
    """Positions of ``values`` in clusters: neighbours by size at most ``least`` apart."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > least) + 1
    return np.split(order, cuts)


def refined_eigen(a: np.ndarray, depth: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by falling
    eigenvalue, in extended precision."""
    a = np.asarray(a, High)
    n = len(a)
    unit = np.eye(n, dtype=High)
    top = np.abs(a).max() if n else High(0)
    if n < 2 or top == 0:
        return np.diag(a).copy(), unit
    a = (a + a.T) / (2 * top)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(High)
    norm = float(np.linalg.norm(a.astype(float), 2))
    noise = 8 * n * float(np.finfo(High).eps) * norm
    for _ in range(12):
        r = unit - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = (s - np.diag(values)).astype(float)
        near = 2 * (np.linalg.norm(off, 2) + norm * np.linalg.norm(r.astype(float), 2))
        clusters = _parted(values, near)
        label = np.empty(n, int)
        for k, members in enumerate(clusters):
            label[members] = k
        gap = values[None, :] - values[:, None]
        same = label[:, None] == label[None, :]
        e = np.where(same, r / 2, (s + values[None, :] * r) / np.where(same, 1, gap))
        x = x + x @ e
        resolved = True
        for members in clusters:
            if len(members) < 2 or not depth:
                continue
            v = x[:, members]
            t = v.T @ (a @ v) - values[members].mean() * (v.T @ v)
            t = (t + t.T) / 2
            rest = np.abs(t - np.diag(np.diag(t))).max()
            if rest > noise:  # otherwise they are one eigenvalue: any basis will do
                x[:, members] = v @ refined_eigen(t, depth - 1)[1]
                resolved = False
        if resolved and np.abs(e).max() < 1e-12:
            break
    for _ in range(2):  # what rounding left between close eigenvalues: orthogonal to the last digit
        x = x + x @ (unit - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(n)])
    return values[order] * top, x * sign


def fixed_point(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x): the rows that take part, their entries as whole numbers."""
    v = F.col(vec_col)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * float(scale), F.lit(LIMIT)), F.lit(-LIMIT)))
                        .cast("long") + F.lit(offset).cast("long"))
    return df.where(usable).select(F.col(id_col).alias("id"), whole.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class Mean:
    """Exact sums of ``n`` vectors; ``whole`` is the mean, rounded, ``rest`` the difference."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([float(High(s - self.n * int(w)) / self.n) for s, w in zip(self.sums, self.whole, strict=True)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n * x - S) squared, if it has 63 bits."""
        near = x - self.whole
        rest = [s - self.n * int(w) for s, w in zip(self.sums, self.whole, strict=True)]
        most = self.n * int(np.abs(near).max(initial=0)) + max(map(abs, rest), default=0)
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * near - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in near.tolist()]
        return [d if d < 1 << 63 else None for d in exact]


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n += len(x)
            high, low = (x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()
            total = [t + (h << 26) + w for t, h, w in zip(total, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([str(t) for t in total])],
                names=["at", "n", "total"])

    return run


def mean_of(rows: DataFrame, dims: int) -> Mean:
    """The exact sums of all vectors."""
    parts = rows.select("x").mapInArrow(_sums(dims), "at int, n long, total string")
    got = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    got.sort(key=lambda r: r["at"])
    return Mean(got[0]["n"], [int(r["total"]) for r in got])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch.column(1):
            m = np.frombuffer(row.as_py())
            total = m.copy() if total is None else total + m
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "m"])


def _second_moment(columns: DataFrame, centred, width: int) -> np.ndarray:
    """Sum over all rows of the products of ``centred(batch)``, a (rows, width)
    matrix; with its column sums as one row more."""
    spark = columns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        rows = 0
        for batch in batches:
            z = centred(batch)
            rows += len(z)
            total[:width] += z.T @ z
            total[width] += z.sum(axis=0)
        if rows:
            part = TaskContext.get().partitionId() % parts
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "m"])

    schema = "part int, m binary"
    some = columns.mapInArrow(run, schema).repartition(parts, "part").mapInArrow(_add, schema)
    all_ = some.repartition(1).mapInArrow(_add, schema).first()
    return np.frombuffer(all_["m"]).reshape(width + 1, width)


def covariance(rows: DataFrame, mean: Mean) -> np.ndarray:
    """Covariance of all vectors, divisor n, centred before multiplying."""
    dims = len(mean.sums)
    total = _second_moment(rows.select("x"), lambda b: mean.centred(_matrix(b.column(0), dims)), dims)
    return total[:dims] / mean.n


@dataclass
class Whitening:
    mean: Mean
    values: np.ndarray     # leading eigenvalues, falling
    vectors: np.ndarray    # their eigenvectors as columns
    trace: float

    @property
    def live(self) -> np.ndarray:
        """Components that have variance."""
        least = len(self.mean.sums) * np.finfo(float).eps * max(float(self.values.max(initial=0)), 0)
        return self.values > least

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened vectors; components without variance are nan."""
        scale = np.where(self.live, np.sqrt(np.where(self.live, self.values, 1)), np.nan)
        return self.mean.centred(x) @ self.vectors / scale


def fit(rows: DataFrame, dims: int, components: int) -> Whitening:
    """The leading components of all vectors."""
    if dims > MAX_DIMS:
        raise ValueError(f"vectors have {dims} dimensions, more than {MAX_DIMS}")
    mean = mean_of(rows, dims)
    v = covariance(rows, mean)
    values, vectors = refined_eigen(v)
    return Whitening(mean, values[:components].astype(float), vectors[:, :components].astype(float), float(np.trace(v)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity."""
    dims, live = len(model.mean.sums), np.flatnonzero(model.live)
    if not len(live):
        return 0.0
    total = _second_moment(rows.select("x"), lambda b: model.project(_matrix(b.column(0), dims))[:, live], len(live))
    centre = total[-1] / model.mean.n
    return float(np.abs(total[:-1] / model.mean.n - np.outer(centre, centre) - np.eye(len(live))).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(``id_col``, component, n, deviation, whitened, explained, identity_error): a
    row per vector and component, components numbered from 1 by falling eigenvalue."""
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()
    rows = fixed_point(df, id_col, vec_col, scale, offset)
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    most = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if most is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dims = most["dims"]
    rows = rows.where(F.size("x") == dims)
    model = fit(rows, dims, min(components, dims))
    error = identity_error(rows, model)
    shared = spark.sparkContext.broadcast(model)  # components x dims numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        explained = m.values / m.trace if m.trace > 0 else np.zeros(k)
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            n = len(x)
            if not n:
                continue
            white = m.project(x).ravel()
            rows_at = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows_at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                 pa.array(np.full(n * k, m.mean.n)), pa.array(m.mean.deviations(x), pa.int64()).take(rows_at),
                 pa.array(white, mask=np.isnan(white)), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
