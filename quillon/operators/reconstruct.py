"""Decoders of a released representation: how much of a target vector comes back."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import mapped
from ..functions.hashing import hash_52
from . import lowrank, models, sampling, transforms


def train_mean(train: DataFrame, y: list[str]) -> list[float]:
    """The reference that knows the training targets only: their mean."""
    row = train.agg(*(F.avg(c).alias(c) for c in y)).first()
    return [row[c] or 0.0 for c in y]


def pca_ceiling(train: DataFrame, test: DataFrame, y: list[str], dim: int, names: list[str]) -> DataFrame:
    """test with the targets after a round trip through `dim` components fitted on train: the best a decoder can do."""
    fitted = transforms.fit(train, y, "pca", dim=dim)
    m, center, scale = fitted.matrix, np.array(fitted.center), np.array(fitted.scale)

    rows = mapped(test.withColumn("_z", F.array(*fitted.imputed())), "_z", "_z", lambda v: (v - center) / scale @ m.T @ m * scale + center, len(y))
    return rows.select(*test.columns, *(F.get("_z", F.lit(k)).alias(n) for k, n in enumerate(names)))


def decode(train: DataFrame, test: DataFrame, x: list[str], y: list[str], names: list[str], kind: str = "ridge", key: str | None = None, rows: int = 20_000, seed: int = 0) -> DataFrame:
    """test with estimates of y from x. ridge uses every training row; mlp, trained in a task, a sample of at
    most `rows`, by hash of key."""
    if kind == "ridge":
        w, b = models.ridge(train, x, y)
        return models.ridge_predict(test, x, w, b, names)
    if kind != "mlp":
        raise ValueError(kind)
    fx, fy = transforms.fit(train, x, "standard"), transforms.fit(train, y, "standard")
    sample = sampling.sample(train, key, rows, seed)
    data = sample.select(F.array(*fx.scaled()).alias("x"), F.array(*fy.scaled()).alias("y"), hash_52(key, seed=seed).alias("o"), F.col(key).alias("k"))
    layers = models.in_one_task(data, lambda a, b: models.mlp(a, b, (256, 128), patience=10, seed=seed))
    center, scale = np.array(fy.center), np.array(fy.scale)

    def run(z: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(layers):
            z = z @ w + b
            z = np.maximum(z, 0) if k < len(layers) - 1 else z
        return z * scale + center

    out = mapped(test.withColumn("_z", F.array(*fx.scaled())), "_z", "_z", run, len(x))
    return out.select(*test.columns, *(F.get("_z", F.lit(k)).alias(n) for k, n in enumerate(names)))


def decode_vectors(train: DataFrame, test: DataFrame, x: list[str], target: str, name: str, dim: int, kind: str = "ridge", key: str | None = None, seed: int = 0, parts: lowrank.LowRank | None = None, **how) -> DataFrame:
    """test with `name`, an estimate of the array column `target`, of any width, from x.

    The decoder, fitted on imputed and scaled x, predicts the scaled scores of the targets' first `dim` components; both
    are fitted on train, unless the components are given as `parts`. Arrow batches of very wide targets should have few rows (see `lowrank`).
    """
    parts, fx = parts or lowrank.fit(train, target, dim, seed=seed), transforms.fit(train, x, "standard")
    inputs, scores, found = ([f"{p}{k}_" for k in range(n)] for p, n in (("x", len(x)), ("s", len(parts.variance)), ("p", len(parts.variance))))
    scaled = [c.alias(n) for c, n in zip(fx.scaled(), inputs)]
    own = parts.scores(train.filter(F.col(target).isNotNull()).select(*([key] if key else []), target, *scaled), target, "z_").select("*", *(F.get("z_", F.lit(k)).alias(n) for k, n in enumerate(scores)))
    out = decode(own.drop(target, "z_"), test.select("*", *scaled), inputs, scores, found, kind, key, seed=seed, **how)
    return parts.inverse(out.select(*test.columns, F.array(*found).alias("z_")), "z_", name).drop("z_")


def ceiling_vectors(train: DataFrame, test: DataFrame, target: str, name: str, dim: int, seed: int = 0, parts: lowrank.LowRank | None = None) -> DataFrame:
    """test with the target after a round trip through the components: the best that such a decoder can do."""
    parts = parts or lowrank.fit(train, target, dim, seed=seed)
    return parts.inverse(parts.scores(test, target, "z_"), "z_", name).drop("z_")


def error_table(df: DataFrame, y: list[str], names: list[str], by: list[str] = ()) -> DataFrame:
    """by, rmse and prd (percent of the root of the target's energy) over all targets."""
    e = sum(((F.col(a) - F.col(b)) ** 2 for a, b in zip(y, names)), F.lit(0.0))
    p = sum((F.col(a) ** 2 for a in y), F.lit(0.0))
    return df.groupBy(*by).agg(F.sqrt(F.avg(e) / len(y)).alias("rmse"), (100 * F.sqrt(F.try_divide(F.sum(e), F.sum(p)))).alias("prd"))


def vector_errors(df: DataFrame, target: str, estimate: str, by: list[str]) -> DataFrame:
    """by, n, rmse and prd (percent of the root of the targets' energy) of an array column, over all elements."""
    e = F.aggregate(F.zip_with(target, estimate, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    p = F.aggregate(target, F.lit(0.0), lambda s, x: s + x * x)
    return df.select(*by, e.alias("e_"), p.alias("p_"), F.size(target).alias("m_")).groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.sum("e_") / F.sum("m_")).alias("rmse"), (100 * F.sqrt(F.try_divide(F.sum("e_"), F.sum("p_")))).alias("prd"))


def under_conditions(known: dict[str, DataFrame], views: DataFrame, x: list[str], target: str, key: str, dim: int, kinds: tuple[str, ...] = ("ridge",), seed: int = 0, **how) -> DataFrame:
    """train_condition, condition, decoder, n, rmse, prd: how well `target` (an array) comes back from the views.

    known has the training rows (key, x and the target) of the decoders on single segments (`single`) and on whole groups
    (`oracle`). The first read the single views, the second those of the true, the linked and the random group. Beside
    each decoder stand train_mean, what the training targets alone tell, and pca_ceiling, the round trip of the true
    targets through the components. views: key, condition, x (an array) and the target.
    """
    rows = views.select(key, "condition", *(F.get("x", F.lit(k)).alias(c) for k, c in enumerate(x)), F.col(target).cast("array<double>").alias(target))
    out = []
    for t, conditions in models.ATTACKED.items():
        own, train = rows.filter(F.col("condition").isin(conditions)), known[t].withColumn(target, F.col(target).cast("array<double>"))
        parts = lowrank.fit(train, target, dim, seed=seed)
        found = {kind: decode_vectors(train, own, x, target, "estimate_", dim, kind, key, seed, parts, **how) for kind in kinds}
        found["train_mean"] = own.withColumn("estimate_", F.array(*(F.lit(float(m)) for m in parts.mean)))
        found["pca_ceiling"] = ceiling_vectors(train, own, target, "estimate_", dim, seed, parts)
        out += [vector_errors(d.select("condition", target, "estimate_"), target, "estimate_", ["condition"]).select(F.lit(t).alias("train_condition"), "condition", F.lit(n).alias("decoder"), "n", "rmse", "prd") for n, d in found.items()]
    return reduce(DataFrame.unionByName, out)
