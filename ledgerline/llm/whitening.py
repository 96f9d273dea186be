"""Whitening of embeddings by a one-sided Jacobi SVD.

Vectors are read in fixed point (x = floor(256 * entry)); each different vector is fitted once. Sums over the fit list are exact,
so that rows can be centred exactly: n * x - S is an integer. Each task compresses its centred rows to an upper triangle
R by QR, a block of rows at a time; triangles meet in a tree of a few rounds (TSQR), of which none has more than FAN in a task. The last
R, as many rows and columns as the vectors have entries, comes to the driver, where plane rotations make its columns orthogonal. The accumulated
rotations are the components, and the lengths of the columns over the root of n their standard deviations: as the covariance itself is never
formed, small ones keep their accuracy.

Rows whose vector is null, empty or holds null or non-finite entries are left out. So are vectors of another length than the commonest one
(the longest of those, on ties), which have no place in the space. Entries whose fixed point passes 64 bits count as the nearest long, and a deviation of over 38 digits is null. Repeated
rows and null ids each give their rows. Components without variance (fewer different vectors than entries, or constant ones) have a null
`whitened` and an `explained` of 0; where nothing varies, `explained` and `identity_error` are null. Components with equal variances are any
orthogonal ones of their space. An empty table gives no rows. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialise, release, ship

UNIT = 256
#: Triangles that meet in one task, rows that a task compresses at once, sweeps over all pairs of columns at most.
FAN, BLOCK_ROWS, SWEEPS = 8, 4096, 100
_EPSILON = float(np.finfo(np.float64).eps)


def fixed_point(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and x (longs) of the rows whose vector has only finite entries."""
    v = F.col(vector_column).cast("array<double>")
    own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") > 0)
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return own.where(finite).select("vec_id", F.transform("v", lambda c: F.floor(c * UNIT)).alias("x"))


def blocks_of(column: pa.ListArray, width: int) -> Iterator[np.ndarray]:
    """Vectors of `width` longs as matrices of at most BLOCK_ROWS rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for i in range(0, len(flat), BLOCK_ROWS):
        yield flat[i : i + BLOCK_ROWS]


def times(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: in longs where that fits, else in Python's integers."""
    most = int(np.abs(x.astype(np.float64)).max(initial=0.0)) + 1
    if n * most + max((abs(s) for s in sums.tolist()), default=0) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def squares(numerators: np.ndarray) -> pa.Array:
    """The sum of squares of each row, exactly, as decimals; null where it has over 38 digits."""
    if numerators.dtype != object:
        most = int(np.abs(numerators).max(initial=0))
        if most * most * numerators.shape[1] < 1 << 63:
            return pa.array((numerators * numerators).sum(1)).cast(pa.decimal128(38, 0))
    sums = (sum(int(v) ** 2 for v in row) for row in numerators.tolist())
    return pa.array([Decimal(s) if s < 10**38 else None for s in sums], pa.decimal128(38, 0))


def triangle(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The R of rows under an R."""
    return np.linalg.qr(rows if r is None else np.vstack((r, rows)), mode="r")


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(V, lengths): rotations V after which the columns of r @ V are orthogonal, and their lengths, by falling length.

    Each sweep takes all pairs of columns, in rounds of pairs that have no column in common and so turn at once.
    """
    width = r.shape[1]
    scale = float(np.abs(r).max(initial=0.0)) or 1.0
    a, v = r / scale, np.eye(width)
    ring = np.arange(width + width % 2)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            real = (p < width) & (q < width)
            p, q = p[real], q[real]
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            wide = np.abs(gamma) > _EPSILON * np.sqrt(alpha * beta)
            if wide.any():
                p, q, alpha, beta, gamma = p[wide], q[wide], alpha[wide], beta[wide], gamma[wide]
                zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                for m in (a, v):
                    left, right = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * left - s * right, s * left + c * right
                turned = True
            ring = np.concatenate((ring[:1], ring[-1:], ring[1:-1]))
        if not turned:
            break
    lengths = np.sqrt((a * a).sum(0))
    order = np.argsort(-lengths, kind="stable")
    return v[:, order], lengths[order] * scale


@dataclass
class Fit:
    """What whitens a vector: its size is that of a matrix as wide as the vectors."""

    n: int
    sums: np.ndarray  # Python's integers
    components: np.ndarray  # a column for each component
    deviations: np.ndarray  # their standard deviations; 0 where nothing varies
    identity_error: float | None = None

    def whiten(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """n * x - sums, and x whitened on the first components; not a number where a component has no variance."""
        numerators = times(x, self.n, self.sums)
        centred = numerators.astype(np.float64) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return numerators, np.where(self.deviations[:most] > 0, centred @ self.components[:, :most] / self.deviations[:most], np.nan)


_SUMS = pa.schema([("dim", pa.int32()), ("s", pa.decimal128(38, 0))])
_TRIANGLES = pa.schema([("node", pa.int64()), ("r", pa.binary())])


def _triangles(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """The R of all centred rows of the fit list."""
    width = len(sums)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for x in blocks_of(batch.column(0), width):
                r = triangle(r, times(x, n, sums).astype(np.float64) / n)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], schema=_TRIANGLES)

    def meet(group: pa.Table) -> pa.Table:
        r = None
        for data in group.column("r").to_pylist():
            r = triangle(r, np.frombuffer(data).reshape(-1, width))
        return pa.table([group.column("node").slice(0, 1), pa.array([r.tobytes()], pa.binary())], schema=_TRIANGLES)

    now = materialise(fit.mapInArrow(compress, "node long, r binary"), "triangles")
    while now.count() > 1:
        groups = now.select(F.floor(F.col("node") / FAN).alias("node"), "r").groupBy("node")
        merged = materialise(groups.applyInArrow(meet, "node long, r binary"), "triangles")
        release(now)
        now = merged
    r = np.frombuffer(now.first()["r"]).reshape(-1, width)
    release(now)
    return r


def _sums(fit: DataFrame, width: int) -> np.ndarray:
    """The sum of each dimension over the fit list, exactly."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            for x in blocks_of(batch.column(0), width):
                small = np.abs(x.astype(np.float64)).max(initial=0.0) < 1 << 48
                total += x.sum(0).astype(object) if small else x.astype(object).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))], schema=_SUMS)

    found = fit.mapInArrow(add, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()  # a row for each dimension
    out = np.zeros(width, object)
    for row in found:
        out[row["dim"]] = int(row["s"])
    return out


def _identity_error(fit: DataFrame, model: Fit, most: int) -> float | None:
    """The largest absolute entry of the covariance of the whitened fit list, minus the identity; measured, over the components with variance."""
    k = int((model.deviations[:most] > 0).sum())
    if not k:
        return None
    width = len(model.sums)

    def totals(means: np.ndarray | None) -> np.ndarray:
        """The sums of the whitened components, or of the products of their centred values."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k if means is None else k * k)
            for batch in batches:
                for x in blocks_of(batch.column(0), width):
                    w = model.whiten(x, k)[1]
                    total += w.sum(0) if means is None else ((w - means).T @ (w - means)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "s"])

        rows = fit.mapInArrow(add, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()  # at most most * most rows
        return np.array([r["s"] for r in sorted(rows)])

    covariance = totals(totals(None) / model.n).reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def fit_of(fit: DataFrame, width: int, most: int) -> Fit:
    """The fit of a table of different vectors x of one length."""
    n = fit.count()
    sums = _sums(fit, width)
    r = _triangles(fit, n, sums)
    components, lengths = jacobi(np.vstack((r, np.zeros((max(0, width - len(r)), width)))))
    lengths = np.where(lengths > width * _EPSILON * lengths.max(initial=0.0), lengths, 0.0)
    model = Fit(n, sums, components, lengths / np.sqrt(n))
    model.identity_error = _identity_error(fit, model, most)
    return model


_OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each row that remains and each of the first components."""
    spark = vectors.sparkSession
    ship(spark)
    own = fixed_point(vectors, id_column, vector_column)
    different = materialise(own.select("x").distinct(), "fit")
    lengths = different.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return spark.createDataFrame([], _OUT)
    width = lengths["width"]
    most = min(components, width)
    model = fit_of(different.where(F.size("x") == width), width, most)
    release(different)
    trace = float((model.deviations**2).sum())
    explained = [float(d * d / trace) if trace else None for d in model.deviations[:most]]
    model.components = model.components[:, :most]  # what tasks need
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for x in blocks_of(batch.column(1), width):
                numerators, w = model.whiten(x, most)
                rows = len(x)
                each = np.repeat(np.arange(rows), most)
                arrays = [ids.slice(at, rows).take(pa.array(each)), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), rows)), pa.array(np.full(rows * most, model.n)), squares(numerators).take(pa.array(each)), pa.array(w.ravel(), from_pandas=True), pa.array(explained * rows, pa.float64()), pa.array([model.identity_error] * (rows * most), pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
                at += rows

    return own.where(F.size("x") == width).select("vec_id", "x").mapInArrow(run, _OUT)
