"""Principal components of wide vectors (thousands of elements), without a matrix of elements by elements.

A few passes of subspace iteration over an array column: each task multiplies its centred rows with a basis of `dim` and a
few more vectors and sends the products back, a matrix of basis by elements. These are added up in two steps; the driver
holds nothing but such matrices, whose size is set by the parameters, and does their QR and a small eigenproblem.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import BATCH, mapped, matrix

#: Groups of tasks whose sums are added first.
FIRST = 64


@contextmanager
def _batches(df: DataFrame, width: int):
    """While it is open, Arrow batches hold at most BATCH bytes of vectors."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(max(1, min(int(before), BATCH // (8 * width)))))
    try:
        yield
    finally:
        conf.set(name, before)


def _summed(rows: DataFrame, run, width: int) -> dict[int, np.ndarray]:
    """The sums of the arrays that `run` gives for each task, by their number; the arrays of a number have one length."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = list(run(batches))
        flat = np.concatenate([np.ravel(x) for x in parts])
        offs = np.concatenate([[0], np.cumsum([np.size(x) for x in parts])])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([TaskContext.get().partitionId() % FIRST] * len(parts), pa.int32()), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat))], ["i", "salt", "row"])

    def added(t: pa.Table) -> pa.Table:
        lists = t["row"].combine_chunks()
        s = lists.flatten().to_numpy().reshape(len(lists), -1).sum(0)
        return pa.table({"i": t["i"][:1], "salt": t["salt"][:1], "row": pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s))})

    schema = "i int, salt int, row array<double>"
    with _batches(rows, width):
        parts = rows.mapInArrow(tasks, schema).groupBy("i", "salt").applyInArrow(added, schema)
        return {r["i"]: np.array(r["row"]) for r in parts.groupBy("i").applyInArrow(added, schema).toLocalIterator()}


@dataclass
class LowRank:
    """Components (one a row, orthonormal, by falling variance) of vectors with a mean, and the scores' deviations."""

    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    total: float
    n: int

    @property
    def explained(self) -> float:
        """The share of the whole variance."""
        return float(self.variance.sum() / self.total) if self.total else 0.0

    @property
    def deviation(self) -> np.ndarray:
        """Of each score on the fitted rows (population); 1 for one without."""
        d = np.sqrt(self.variance * (self.n - 1) / max(self.n, 1))
        return np.where(d > 0, d, 1.0)

    def scores(self, df: DataFrame, vector: str, name: str, scaled: bool = True) -> DataFrame:
        """df with the vector's scores as an array column, in units of their deviations on the fitted rows, or not.

        A missing element counts as its mean. Arrow batches have as many rows as the session says: set
        spark.sql.execution.arrow.maxRecordsPerBatch for very wide vectors.
        """
        by = self.deviation if scaled else 1.0
        return mapped(df, vector, name, lambda x: np.nan_to_num(x - self.mean) @ self.components.T / by, len(self.mean))

    def inverse(self, df: DataFrame, scores: str, name: str, scaled: bool = True) -> DataFrame:
        """df with the vector that has these scores."""
        by = self.deviation if scaled else 1.0
        return mapped(df, scores, name, lambda z: (z * by) @ self.components + self.mean, len(self.variance))


def fit(train: DataFrame, vector: str, dim: int, more: int = 10, power: int = 3, seed: int = 0) -> LowRank:
    """The first `dim` components of an array column (fewer, if rows or elements are fewer), by `power` + 2 passes.

    Null vectors are left out; missing elements count as their mean. All vectors have one length.
    """
    rows = train.select(F.col(vector).cast("array<double>").alias("x")).filter("x is not null")
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no vectors")
    width = first["n"]

    def sums(batches):
        total, count, rows_ = np.zeros(width), np.zeros(width), 0
        for batch in batches:
            x = matrix(batch["x"], width)
            has = ~np.isnan(x)
            total, count, rows_ = total + np.where(has, x, 0).sum(0), count + has.sum(0), rows_ + len(x)
        yield from (total, count.astype(float), np.array([float(rows_)]))

    found = _summed(rows, sums, width)
    mean, n = np.where(found[1] > 0, found[0] / np.maximum(found[1], 1), 0.0), int(found[2][0])
    dim = max(1, min(dim, n - 1, width))
    size = min(dim + more, width)

    def products(basis: np.ndarray, whole: bool):
        def run(batches):
            outer, inner, total = np.zeros((size, width if whole else 0)), np.zeros((size, size)), 0.0
            for batch in batches:
                z = np.nan_to_num(matrix(batch["x"], width) - mean)
                y = z @ basis
                inner += y.T @ y
                total += float((z * z).sum())
                if whole:
                    outer += y.T @ z
            yield from (inner, np.array([total]), *(outer if whole else ()))

        return run

    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    for _ in range(power):
        found = _summed(rows, products(basis, True), width)
        basis = np.linalg.qr(np.stack([found[2 + k] for k in range(size)]).T)[0]
    found = _summed(rows, products(basis, False), width)
    values, turn = np.linalg.eigh(found[0].reshape(size, size) / max(n - 1, 1))
    order = np.argsort(-values)[:dim]
    parts = (basis @ turn[:, order]).T
    parts = parts * np.where(parts[np.arange(dim), np.abs(parts).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return LowRank(mean, parts, np.maximum(values[order], 0.0), float(found[1][0]) / max(n - 1, 1), n)
