"""Fitted transforms of feature columns: fit on the training rows, apply to any.

A fitted transform is a list of column names and one row of parameters; applying it is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.arrays import mapped
from ..functions.hashing import laplace, normal
from ..functions.scalars import gaussian_sigma, laplace_scale, null_if_nan
from .quantiles import quantiles

SCALED, CLIPPED = "_scaled", "_clipped"
METHODS = ("identity", "standard", "robust", "minmax", "quantization", "winsorization", "noise", "dp_gaussian_l2", "dp_laplace_l1", "pca", "random_projection")


@dataclass
class Fitted:
    method: str
    columns: list[str]
    center: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    median: list[float] = field(default_factory=list)
    low: list[float] = field(default_factory=list)
    high: list[float] = field(default_factory=list)
    matrix: np.ndarray | None = None
    options: dict = field(default_factory=dict)

    def imputed(self) -> list[Column]:
        return [F.coalesce(null_if_nan(F.col(c).cast("double")), F.lit(m)) for c, m in zip(self.columns, self.median)]

    def scaled(self) -> list[Column]:
        return [(x - m) / s for x, m, s in zip(self.imputed(), self.center, self.scale)]

    def expressions(self, key: str | None = None) -> list[Column]:
        """The new columns of a method that works by column; key is the column that noise is drawn by. The dp methods read the clipped vector of transform."""
        o = self.options
        if self.method == "identity":
            return [F.col(c) for c in self.columns]
        if self.method in ("standard", "robust", "minmax"):
            out = self.scaled()
        elif self.method == "quantization":
            out = [F.bround(x, o["decimals"]) for x in self.imputed()]
        elif self.method == "winsorization":
            out = [F.least(F.greatest(x, F.lit(a)), F.lit(b)) for x, a, b in zip(self.imputed(), self.low, self.high)]
        elif self.method == "noise":
            out = [x + o["scale"] * s * normal(key, F.lit(c), seed=o["seed"]) for x, s, c in zip(self.imputed(), self.scale, self.columns)]
        elif self.method in ("dp_gaussian_l2", "dp_laplace_l1"):
            draw = normal if self.method == "dp_gaussian_l2" else laplace
            out = [F.get(CLIPPED, F.lit(k)) + o["sigma"] * draw(key, F.lit(c), seed=o["seed"]) for k, c in enumerate(self.columns)]
        else:
            raise ValueError(f"{self.method} is a product of all columns: see transform")
        return [x.alias(c) for x, c in zip(out, self.columns)]

    def transform(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """df with the feature columns replaced; its other columns stay."""
        if self.method in ("noise", "dp_gaussian_l2", "dp_laplace_l1") and key is None:
            raise ValueError("noise needs the column that it is drawn by")
        rest = [c for c in df.columns if c not in self.columns]
        if self.method in ("pca", "random_projection"):
            new = mapped(df.select(*rest, F.array(*self.scaled()).alias(SCALED)), SCALED, SCALED, lambda x: x @ self.matrix.T, len(self.columns))
            return new.select(*rest, *(F.get(SCALED, F.lit(k)).alias(f"{'pca' if self.method == 'pca' else 'rp'}_{k:03d}") for k in range(len(self.matrix))))
        if self.method in ("dp_gaussian_l2", "dp_laplace_l1"):  # one vector, clipped once, for all its elements
            df = df.withColumn(SCALED, F.array(*self.scaled()))
            df = df.withColumn(CLIPPED, vectors.clip_norm(SCALED, self.options["clip"], "l2" if self.method == "dp_gaussian_l2" else "l1"))
        return df.select(*rest, *self.expressions(key))


def fit(train: DataFrame, columns: list[str], method: str, *, dim: int = 8, decimals: int = 2, low: float = 0.01, high: float = 0.99, scale: float = 0.1, epsilon: float = 50.0, delta: float = 1e-5, clip: float = 2.0, seed: int = 0) -> Fitted:
    """Every parameter is found in a few aggregates over train; quantiles are exact."""
    if method not in METHODS:
        raise ValueError(f"{method}: not one of {METHODS}")
    if not 0 <= low < high <= 1:
        raise ValueError("winsor bounds need 0 <= low < high <= 1")
    out = Fitted(method, list(columns), options={"decimals": decimals, "scale": scale, "clip": clip, "seed": seed})
    if method == "identity":
        return out
    x = [null_if_nan(F.col(c).cast("double")) for c in columns]
    levels = [0.5, 0.25, 0.75, low, high] if method in ("robust", "winsorization") else [0.5]
    q = [[0.0 if v is None else v for v in row] for row in quantiles(train, x, levels)]
    out.median = [v[0] for v in q]
    full = train.select(*(c.alias(f"x{k}") for k, c in enumerate(out.imputed())))
    one = lambda s: 1.0 if s is None or s == 0 else float(s)
    if method == "robust":
        out.center, out.scale = out.median, [one(v[2] - v[1]) for v in q]
    elif method == "winsorization":
        out.low, out.high = [v[3] for v in q], [v[4] for v in q]
    elif method == "minmax":
        row = train.agg(*(F.min(v).alias(f"a{k}") for k, v in enumerate(x)), *(F.max(v).alias(f"b{k}") for k, v in enumerate(x))).first()
        a, b = [row[f"a{k}"] or 0.0 for k in range(len(columns))], [row[f"b{k}"] or 0.0 for k in range(len(columns))]
        out.center, out.scale = a, [one(hi - lo) for lo, hi in zip(a, b)]
    else:
        m = full.agg(*(F.avg(f"x{k}").alias(f"m{k}") for k in range(len(columns))), *(F.stddev_pop(f"x{k}").alias(f"s{k}") for k in range(len(columns)))).first()
        out.center, out.scale = [m[f"m{k}"] or 0.0 for k in range(len(columns))], [one(m[f"s{k}"]) for k in range(len(columns))]
    if method == "dp_gaussian_l2":
        out.options["sigma"] = gaussian_sigma(epsilon, delta, clip)
    elif method == "dp_laplace_l1":
        out.options["sigma"] = laplace_scale(epsilon, clip)
    elif method == "pca":
        out.matrix = components(train.select(*(c.alias(f"x{k}") for k, c in enumerate(out.scaled()))), dim)
    elif method == "random_projection":
        out.matrix = np.random.default_rng(seed).normal(0, dim**-0.5, (dim, len(columns)))
    return out


@dataclass
class FittedVectors:
    """Imputing and scaling of an array column; applied in Arrow batches."""

    median: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def transform(self, df: DataFrame, vector: str, name: str) -> DataFrame:
        """df with the scaled vector as `name`, which may be the vector's own."""
        order = df.columns if name in df.columns else [*df.columns, name]
        temp = f"{name}_in"
        out = mapped(df.withColumn(temp, vectors.doubles(vector)), temp, temp, lambda x: (np.where(np.isfinite(x), x, self.median) - self.center) / self.scale, len(self.median))
        return out.select(*(F.col(temp).alias(c) if c == name else F.col(c) for c in order))


def fit_vectors(train: DataFrame, vector: str) -> FittedVectors:
    """Medians for what is missing or not finite, then population means and deviations, by element of an array column."""
    first = train.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    n = first["n"] if first else 0
    names = [f"x{k}" for k in range(n)]
    finite = lambda x: F.when(F.abs(x) < float("inf"), x)  # noqa: E731 (NaN is above every number)
    f = fit(train.select(*(finite(F.get(vector, F.lit(k)).cast("double")).alias(c) for k, c in enumerate(names))), names, "standard")
    return FittedVectors(np.array(f.median), np.array(f.center), np.array(f.scale))


def covariance(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population covariance of the columns, null rows left out.

    Each task sends its sums of products once, a row of the matrix at a time; these are added up by row.
    """
    p = len(columns)
    rows = df.select(F.array(*(F.col(c).cast("double") for c in columns)).alias("x")).filter(~F.exists("x", lambda v: v.isNull()))
    means = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.count("*").alias("n")).collect()  # a row a column
    mean = np.zeros(p)
    for r in means:
        mean[r["i"]] = r["m"]
    n = means[0]["n"] if means else 0

    def products(batches):
        total = np.zeros((p, p))
        for batch in batches:
            if batch.num_rows:
                z = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - mean
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(p + 1) * p, pa.int32()), pa.array(total.ravel()))], names=["i", "row"])

    def added(t: pa.Table) -> pa.Table:
        s = t["row"].combine_chunks().flatten().to_numpy().reshape(-1, p).sum(0)
        return pa.table({"i": t["i"][:1], "row": pa.ListArray.from_arrays(pa.array([0, p], pa.int32()), pa.array(s))})

    c = np.zeros((p, p))
    for r in rows.mapInArrow(products, "i int, row array<double>").groupBy("i").applyInArrow(added, "i int, row array<double>").toLocalIterator():
        c[r["i"]] = np.array(r["row"]) / max(n, 1)
    return n, mean, c


def components(df: DataFrame, dim: int) -> np.ndarray:
    """The first eigenvectors of the covariance of all columns, one a row, the largest entry of each positive."""
    _, _, c = covariance(df, df.columns)
    values, v = np.linalg.eigh(c)
    v = v[:, np.argsort(-values)][:, :dim].T
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]


def fit_split(train: DataFrame, test: DataFrame, columns: list[str], method: str, key: str | None = None, **options) -> tuple[DataFrame, DataFrame, Fitted]:
    """Both sides transformed by what the training side alone has fitted; the noise of the test side has a seed of its own."""
    fitted = fit(train, columns, method, **options)
    a = fitted.transform(train, key)
    other = Fitted(**{**fitted.__dict__, "options": {**fitted.options, "seed": fitted.options["seed"] + 10_000}})
    return a, other.transform(test, key), fitted


def top_features(df: DataFrame, ranking: DataFrame, name: str, order: str, k: int, keep: list[str]) -> DataFrame:
    """keep and the k first distinct ranked columns that df has."""
    names = [r[0] for r in ranking.groupBy(name).agg(F.min(order).alias("o")).filter(F.col(name).isin(df.columns)).orderBy("o", name).limit(k).collect()]
    return df.select(*keep, *names)


def feature_columns(df: DataFrame, metadata: list[str]) -> list[str]:
    return [c for c in df.columns if c not in metadata]
