"""Whitening of embeddings: a distributed centred scatter, and its eigenvectors by cyclic Jacobi rotations.

Three passes over the vectors: their sums, the scatter about the mean, and the projection. What
reaches the driver is a matrix of width by width, whatever the number of rows. Jacobi
rotations keep small eigenvalues accurate relative to their own size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm.vectors import whole

SCALE, SHIFT = 1024, 100_000
#: Entries are below this size before the shift, so that a task's sums fit 64 bits up to 2^22 rows of the largest.
LIMIT = 1 << 40
#: An eigenvalue at or below this share of the largest counts as none: nothing varies there.
FLAT = 1e-13
MAX_SWEEPS = 60


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix; the largest entry of each vector is positive.

    Sweeps rotate every pair of axes whose off-diagonal entry is above rounding, until none is left.
    """
    a, d = np.array(a, np.float64), len(a)
    v = np.eye(d)
    for _ in range(MAX_SWEEPS):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                if abs(a[p, q]) <= 1e-17 * np.sqrt(abs(a[p, p] * a[q, q])) or a[p, q] == 0:
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                app, aqq, apq = a[p, p], a[q, q], a[p, q]
                rp, rq = a[p].copy(), a[q].copy()
                a[p], a[q] = c * rp - s * rq, s * rp + c * rq
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = app - t * apq, aqq + t * apq, 0.0, 0.0
                vp = v[:, p].copy()
                v[:, p], v[:, q] = c * vp - s * v[:, q], s * vp + c * v[:, q]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(d)]) if d else np.ones(0)
    return np.diag(a)[order], v * np.where(sign == 0, 1, sign)


def _matrix(batch: pa.RecordBatch, column: int, width: int, fill) -> np.ndarray:
    """Rows of a list column as a matrix; shorter ones end in ``fill``."""
    col = batch.column(column)
    values, size = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    if (size == width).all():
        return values.reshape(len(size), width)
    out = np.full((len(size), width), fill, values.dtype)
    out[np.arange(width) < size[:, None]] = values
    return out


def column_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension; each task sends a row a dimension."""

    def partial(batches):
        rows, filled, sums = 0, np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            col = batch.column(0)
            size = np.diff(col.offsets.to_numpy())
            width = max(len(sums), int(size.max(initial=0)))
            filled, sums = (np.concatenate([a, np.zeros(width - len(a), a.dtype)]) for a in (filled, sums))
            filled += (np.arange(width)[:, None] < size).sum(1)
            sums += _matrix(batch, 0, width, 0).sum(0).astype(object)
            rows += len(size)
        out = [[-1, *range(len(sums))], [rows, *filled.tolist()], [0, *sums.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64()))], ["pos", "filled", "sum"])

    parts = vectors.select("v").mapInArrow(partial, "pos int, filled long, sum long")
    found = {r.pos: r for r in parts.groupBy("pos").agg(F.sum("filled").alias("filled"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()}
    n = found.pop(-1).filled if found else 0
    return n, [int(found[p].sum) + (n - found[p].filled) * SHIFT for p in range(len(found))]


def scatter(vectors: DataFrame, transform, width: int, rows_in: int) -> np.ndarray:
    """Sum over all rows of y y', where ``transform`` turns a batch's matrix into the rows y; each task sends one partial sum."""

    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            y = transform(_matrix(batch, 0, rows_in, SHIFT))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "part"])

    parts = vectors.select("v").mapInArrow(partial, "row int, part array<double>")
    total = parts.groupBy("row").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("sum"))
    out = np.zeros((width, width))
    for r in total.collect():
        out[r.row] = r.sum
    return out


class Whitening:
    """Mean, eigenvalues and projection of a table's vectors."""

    def __init__(self, vectors: DataFrame, components: int):
        self.n, self.sums = column_sums(vectors)
        self.width = w = len(self.sums)
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(w)
        mean = self.mean
        cov = scatter(vectors, lambda x: x - mean, w, w) / max(self.n, 1)
        self.values, self.vectors = jacobi((cov + cov.T) / 2)
        self.trace = float(np.trace(cov))
        self.k = min(components, w)
        live = (self.values[: self.k] > FLAT * max(self.values.max(initial=0.0), 0.0)) & (self.values[: self.k] > 0)
        self.live = live
        self.projection = np.where(live, self.vectors[:, : self.k] / np.sqrt(np.where(live, self.values[: self.k], 1.0)), 0.0)
        project = self.projection
        white = scatter(vectors, lambda x: (x - mean) @ project, self.k, w) / max(self.n, 1)
        wrong = np.abs(white - np.eye(self.k))[np.ix_(live, live)]
        self.identity_error = float(wrong.max()) if wrong.size else None


def whiten(embeddings: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row a vector and component.

    Vectors that are null, or hold null, a number that is not finite or one of 2^30 or more, take
    no part; a shorter vector counts as ending in zeros. Equal rows count as often as they
    stand, a row without id is whitened like any other. A component along which nothing
    varies has whitened null and is left out of ``identity_error``, which is null if all are
    such; ``explained`` is null if nothing varies at all, ``deviation`` if it does not fit 64
    bits. An empty table gives an empty one; further columns are not read.
    """
    vectors = whole(embeddings, id_col, vec_col, SCALE, SHIFT, LIMIT)
    fit = Whitening(vectors, components)
    n, k, w, sums, mean, project = fit.n, fit.k, fit.width, fit.sums, fit.mean, fit.projection
    live, error = fit.live.tolist(), fit.identity_error
    explained = [float(v / fit.trace) if fit.trace > 0 else None for v in fit.values[:k]]
    as_long = w * (max([abs(s) for s in sums], default=0) + 1) ** 2 < 2**62

    def apply(batches):
        total = np.array(sums, np.int64 if as_long else object)
        for batch in batches:
            x = _matrix(batch, 1, w, SHIFT)
            # whole numbers without a limit unless 64 bits hold every step
            exact = as_long and len(x) and w and w * (n * float(np.abs(x).max()) + float(max(map(abs, sums)))) ** 2 < 2**62
            gap = (x if exact else x.astype(object)) * n - (total if exact else total.astype(object))
            deviation = [int(d) if d < 2**63 else None for d in (gap * gap).sum(axis=1)] if w else [0] * len(x)
            white = ((x - mean) @ project).reshape(-1)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                    pa.array([d for d in deviation for _ in range(k)], pa.int64()), pa.array(white, pa.float64(), mask=~np.tile(fit_live, m)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ],
                names,
            )

    fit_live = np.array(live, bool)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = T.StructType([T.StructField(c, t) for c, t in zip(names, (T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()))])
    return vectors.mapInArrow(apply, schema)


def op13_jacobi_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
