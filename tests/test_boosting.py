"""Histogram boosting against a search over all splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import boosting


def grown(x, g, h, depth, rate, l2, least):
    """A tree by brute force, as a function of rows: every feature and every value is tried."""
    value = -rate * g.sum() / (h.sum() + l2)
    best = None
    if depth:
        for f in range(x.shape[1]):
            for v in sorted(set(x[:, f]))[:-1]:
                left = x[:, f] <= v
                if h[left].sum() < least or h[~left].sum() < least:
                    continue
                gain = 0.5 * (g[left].sum() ** 2 / (h[left].sum() + l2) + g[~left].sum() ** 2 / (h[~left].sum() + l2) - g.sum() ** 2 / (h.sum() + l2))
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, v
    if best is None:
        return lambda z: np.full(len(z), value)
    _, f, v = best
    left = x[:, f] <= v
    a, b = (grown(x[s], g[s], h[s], depth - 1, rate, l2, least) for s in (left, ~left))
    return lambda z: np.where(z[:, f] <= v, a(z), b(z))


def table(spark, x, y):
    return spark.createDataFrame([(k, [float(v) for v in r], float(t)) for k, (r, t) in enumerate(zip(x, y))], "k long, x array<double>, y double").repartition(3)


@pytest.mark.parametrize("classes", [True, False])
def test_equal_to_a_search_over_all_splits(spark, classes):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 5)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=90) > 0.4).astype(float) if classes else x[:, 0] ** 2 + x[:, 3]
    heavy = (90 - y.sum()) / y.sum()
    got = boosting.fit(table(spark, x, y), "x", "y", "k", classes=classes, trees=5, depth=3, rate=0.3, subsample=1.0, columns=1.0)
    m = np.full(90, 0.0 if classes else y.mean())  # the classes are in balance
    for _ in range(5):
        p = 1 / (1 + np.exp(-m))
        w = np.where(y == 1, heavy, 1.0)
        g, h = ((p - y) * w, p * (1 - p) * w) if classes else (m - y, np.ones(90))
        m = m + grown(x, g, h, 3, 0.3, 1.0, 1.0)(x)
    assert np.allclose(got.margin(x), m, atol=1e-9)
    scores = {r.k: r.score for r in got.predict(table(spark, x, y), "x").collect()}
    want = 1 / (1 + np.exp(-m)) if classes else m
    assert np.allclose([scores[k] for k in range(90)], want, atol=1e-9)
    assert got.importance().sum() == pytest.approx(1) and got.importance()[0] > 0.1


def test_samples_of_rows_and_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 40))
    y = (x[:, 7] - x[:, 33] > 0).astype(float)
    d = table(spark, x, y)
    fit = lambda df: boosting.fit(df.filter("k < 2000"), "x", "y", "k", trees=8, rate=0.5, seed=5)
    one, two = fit(d), fit(d.repartition(5))
    assert np.allclose(one.margin(x[:50]), two.margin(x[:50]))
    assert ((one.margin(x[2000:]) > 0) == (y[2000:] == 1)).mean() > 0.85
    tops = {t.feature[0] for t in one.trees}
    assert {7, 33} & tops and len(tops) > 1  # a tree that doesn't see the best column takes another
    share = boosting._drawn(np.arange(10**5), 3, 1, 0.8)
    assert abs(share.mean() - 0.8) < 0.01 and (boosting._drawn(np.arange(10**5), 4, 1, 0.8) != share).any()


def test_missing_values_and_one_class(spark):
    rows = [(k, [None if k % 3 == 0 else float(k), 1.0], float(k % 3 == 0)) for k in range(60)]
    d = spark.createDataFrame(rows, "k long, x array<double>, y double")
    got = boosting.fit(d, "x", "y", "k", trees=4, rate=0.9, subsample=1.0, columns=1.0).predict(d, "x")
    assert got.filter((F.col("score") > 0.5) == (F.col("y") == 1)).count() == 60
    same = boosting.fit(d.withColumn("y", F.lit(1)), "x", "y", "k", trees=2).predict(d, "x")
    assert same.agg(F.min("score")).first()[0] > 0.9
    with pytest.raises(ValueError):
        boosting.fit(d.limit(0), "x", "y", "k")
