"""Exact nearest neighbours below the square of the rows, by pivots, rings and the triangle inequality.

Rows belong to the nearest of some pivots, which are rows themselves, and lie in rings of about equal numbers around it.
The distances to the pivots bound what can be in a ring: |d(x, pivot) - d(y, pivot)| <= d(x, y). A row is sent to the
rings that its k nearest rows so far leave open, and to no other. Without any structure in the data all rings stay open,
and the result is the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import matrix
from ..sources.stored import written
from .draws import running
from .sampling import top_k

#: Pivots at most, rows of a ring, and rows that are compared with a ring in one task.
PIVOTS, RING, ROWS = 1024, 256, 16_384


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, row by row; added up by element, so that equal rows have a distance of exactly 0."""
    total = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        diff = x[:, None] - y[None, :]
        total += diff * diff
    return np.sqrt(total)


@dataclass
class Rings:
    """Rows (id, v, cell, dist, ring), the pivots, and of each ring its cell, number, extent and rows."""

    rows: DataFrame
    pivots: np.ndarray
    cell: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    n: int


def rings(points: DataFrame, pivots: int = PIVOTS, ring: int = RING) -> Rings:
    """points: id (unique) and v, an array of one length without missing elements."""
    points = written(points.select("id", "v"), "points")
    n = points.count()
    many = int(min(pivots, max(1, np.ceil(np.sqrt(n)))))
    found = points.orderBy(F.xxhash64("id"), "id").limit(many).collect()
    centers = np.array([r["v"] for r in found], float)
    width = centers.shape[1] if n else 0

    def assign(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                d = distances(matrix(part["v"], width), centers)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([part["id"], part["v"], pa.array(at, pa.int32()), pa.array(d[np.arange(len(d)), at])], ["id", "v", "cell", "dist"])

    schema = T.StructType([points.schema["id"], points.schema["v"], T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())])
    placed = written(points.mapInArrow(assign, schema), "cells")
    ranks = running(placed.select("id", "cell", "dist").withColumn("one", F.lit(1).cast("long")), ["cell"], "dist", ["id"], "one", "rank")
    ranks = ranks.select("id", F.expr(f"cast((rank - 1) div {ring} as int)").alias("ring"))
    rows = written(placed.join(ranks, "id"), "rings")
    about = rows.groupBy("cell", "ring").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("size")).orderBy("cell", "ring").toPandas()  # a row a ring
    return Rings(rows, centers, *(about[c].to_numpy() for c in ("cell", "ring", "low", "high", "size")), n)


def _best(ids: pa.Array, v: np.ndarray, others: pa.Array, w: np.ndarray, k: int, same: bool) -> pa.Table:
    """id, neighbour, distance: the k nearest of others for each id; of equal distances the lesser id is nearer."""
    order = pc.sort_indices(others).to_numpy()
    place = np.argsort(order)  # of each row among the sorted ones
    out = []
    for lo in range(0, len(v), 256):
        d = distances(v[lo : lo + 256], w[order])
        if same:
            d[np.arange(len(d)), place[lo : lo + len(d)]] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(d, best, 1)
        ok = np.isfinite(near)
        out.append((np.broadcast_to(np.arange(lo, lo + len(d))[:, None], ok.shape)[ok], order[best][ok], near[ok]))
    a, b, d = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pa.table({"id": ids.take(pa.array(a)), "neighbour": others.take(pa.array(b)), "distance": pa.array(d)})


def _schema(r: Rings) -> T.StructType:
    kind = r.rows.schema["id"].dataType
    return T.StructType([T.StructField("id", kind), T.StructField("neighbour", kind), T.StructField("distance", T.DoubleType())])


def _own(r: Rings, k: int) -> DataFrame:
    """The k nearest rows of each row in its ring."""
    width = r.pivots.shape[1]

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, v = t["id"].combine_chunks(), matrix(t["v"], width)
        return _best(ids, v, ids, v, k, True)

    return r.rows.groupBy("cell", "ring").applyInArrow(run, _schema(r))


def open_rings(r: Rings, own: DataFrame, k: int) -> DataFrame:
    """id, v, cell, ring: the other rings that may hold one of a row's k nearest rows, by what its own ring and the pivots tell."""
    width, pivots, cell, ring, low, high = r.pivots.shape[1], r.pivots, r.cell, r.ring, r.low, r.high
    bound = own.groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("bound"))
    rows = r.rows.join(bound, "id", "left").select("id", "v", F.col("cell").alias("c"), F.col("ring").alias("g"), "bound")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                d = distances(matrix(part["v"], width), pivots)
                bound = part["bound"].cast(pa.float64()).fill_null(np.inf).to_numpy(zero_copy_only=False)
                if len(pivots) > k:  # pivots are rows; one of them may be the row itself
                    bound = np.minimum(bound, np.partition(d, k, axis=1)[:, k])
                to = d[:, cell]
                least = np.maximum(np.maximum(low - to, to - high), (to - d.min(1)[:, None]) / 2)
                mine = (part["c"].to_numpy()[:, None] == cell) & (part["g"].to_numpy()[:, None] == ring)
                a, b = np.nonzero((least <= bound[:, None] * (1 + 1e-9) + 1e-12) & ~mine)
                at = pa.array(a)
                yield pa.RecordBatch.from_arrays([part["id"].take(at), part["v"].take(at), pa.array(cell[b], pa.int32()), pa.array(ring[b], pa.int32())], ["id", "v", "cell", "ring"])

    schema = T.StructType([r.rows.schema["id"], r.rows.schema["v"], T.StructField("cell", T.IntegerType()), T.StructField("ring", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def nearest(points: DataFrame, k: int, pivots: int = PIVOTS, ring: int = RING) -> DataFrame:
    """id, neighbour, distance: the k nearest other rows of each (all, if there are fewer), exactly.

    points: id (unique) and v, an array of one length without missing elements. Of equal distances the lesser id is nearer.
    """
    r = rings(points, pivots, ring)
    if r.n < 2:
        kind = points.schema["id"].dataType
        return points.sparkSession.createDataFrame([], T.StructType([T.StructField("id", kind), T.StructField("neighbour", kind), T.StructField("distance", T.DoubleType())]))
    own = written(_own(r, k), "own")
    salts, width = max(1, -(-r.n // ROWS)), r.pivots.shape[1]
    asked = open_rings(r, own, k).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    held = r.rows.select("id", "v", "cell", "ring", F.explode(F.array(*map(F.lit, range(salts)))).alias("salt"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _best(a["id"].combine_chunks()[:0], np.zeros((0, width)), b["id"].combine_chunks()[:0], np.zeros((0, width)), k, False)
        return _best(a["id"].combine_chunks(), matrix(a["v"], width), b["id"].combine_chunks(), matrix(b["v"], width), k, False)

    key = ["cell", "ring", "salt"]
    other = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(compare, _schema(r))
    return top_k(own.unionByName(other), ["id"], [F.col("distance"), F.col("neighbour")], k)
