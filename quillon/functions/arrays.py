"""Array columns as numpy matrices, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of vectors that are worked on at once.
BATCH = 1 << 25


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows; null and NaN elements are NaN, and another length is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    if column.null_count or (size != width).any():
        raise ValueError(f"vectors of other lengths than {width}")
    return column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)


def counted(df: DataFrame, column: str, width: int) -> DataFrame:
    """df with an array column of numbers of [0, width) replaced by how often each of them is in it; nothing is shuffled."""
    rest = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH // (8 * width))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                n, lists = part.num_rows, part[column]
                row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                times = np.bincount(row * width + lists.flatten().to_numpy(), minlength=n * width).astype(float)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in rest), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(times))], [*rest, column])

    return df.mapInArrow(run, df.select(*rest).schema.add(column, T.ArrayType(T.DoubleType())))


def mapped(df: DataFrame, column: str, name: str, f: Callable[[np.ndarray], np.ndarray], width: int) -> DataFrame:
    """df with another array column, in place of one of that name: f of the matrix of `column`, some rows at a time."""
    rest = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH // (8 * max(1, width)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                out = np.asarray(f(matrix(part[column], width)), float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in rest), lists], [*rest, name])

    return df.mapInArrow(run, df.select(*rest).schema.add(name, T.ArrayType(T.DoubleType())))
