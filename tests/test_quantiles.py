import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import quantiles, transforms


@pytest.mark.parametrize("most", [20_000, 60])
def test_quantiles_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "MOST", most)
    d = spark.range(30_000).select(F.rand(1).alias("a"), F.round(F.randn(2), 1).alias("b"), F.exp(F.randn(3) * 5).alias("c"), F.when(F.rand(5) < 0.001, F.rand(6)).alias("e"), F.lit(None).cast("double").alias("f"))
    p, levels = d.toPandas(), [0, 0.01, 0.25, 0.5, 0.999, 1]
    for c, got in zip("abcef", quantiles.quantiles(d, [F.col(c) for c in "abcef"], levels)):
        x = p[c].dropna().to_numpy(float)
        assert got == pytest.approx(list(np.quantile(x, levels)), rel=1e-12) if len(x) else got == [None] * len(levels)


def test_covariance_of_208_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 208)) @ rng.normal(size=(208, 208)) + 1000
    cols = [f"c{k}" for k in range(208)]
    df = spark.createDataFrame([[float(v) for v in r] for r in x], cols)
    n, mean, c = transforms.covariance(df, cols)
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(c, np.cov(x.T, bias=True), atol=1e-6)
    fitted = transforms.fit(df, cols, "pca", dim=3)
    z = (x - x.mean(0)) / x.std(0)
    top = np.linalg.eigh(np.cov(z.T, bias=True))[1][:, ::-1][:, :3].T
    assert np.allclose(np.abs(np.sum(top * fitted.matrix, 1)), 1, atol=1e-6)


@pytest.mark.parametrize("most", [20_000, 50])
def test_quantiles_of_keys_are_exact(spark, most):
    d = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 1000 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), (F.col("id") % 2).alias("j"), F.exp(F.randn(3) * 3).alias("a"))
    # Two values that hold nearly all rows, on both sides of the median; NaN and null are no values.
    d = d.withColumn("b", F.when(F.col("a") > 1, 7.0).when(F.col("a") < 0.001, float("nan")).otherwise(5.0)).withColumn("c", F.when(F.col("k") == "k3", None).otherwise(F.round("a", 1)))
    levels = [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1]
    p = d.toPandas()
    for c in "abc":
        got = {(r.k, r.j): r for r in quantiles.quantiles_by_key(d, ["k", "j"], c, levels, most).collect()}
        groups = {(None if isinstance(k[0], float) else k[0], k[1]): g for k, g in p.groupby(["k", "j"], dropna=False)}
        assert set(got) == set(groups)
        for k, g in groups.items():
            x = g[c].dropna().to_numpy(float)
            assert got[k].n == len(x)
            assert got[k].q == pytest.approx(list(np.quantile(x, levels)), rel=1e-12) if len(x) else not got[k].q or set(got[k].q) == {None}


def test_quantiles_of_a_few_frequent_values_end(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST", 100)
    d = spark.range(20_000).select(F.when(F.col("id") < 9_999, 1.0).otherwise(2.0).alias("x"), F.floor(F.col("id") / 4000).cast("double").alias("y"))
    levels = [0.49995, 0.5, 0.2]
    want = [np.quantile(np.repeat([1.0, 2.0], [9_999, 10_001]), levels), np.quantile(np.repeat(np.arange(5.0), 4000), levels)]
    assert np.allclose(quantiles.quantiles(d, [F.col("x"), F.col("y")], levels), want)
