import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import stats


@pytest.fixture(scope="module")
def rows(spark):
    n = {"a": 1000, "b": 37, None: 1}
    rng = np.random.default_rng(0)
    out = [(g, f"{g}{k}", int(rng.random() < 0.5), float(k)) for g, m in n.items() for k in range(m)]
    return spark.createDataFrame(out, "g string, k string, y int, x double").repartition(4)


@pytest.mark.parametrize("cell", [1 << 15, 20])
def test_draws_are_n_of_n_in_every_replicate(rows, cell):
    got = stats.bootstrap_sums(rows, "g", "k", [F.lit(1.0), F.col("x"), F.when(F.col("y") == 1, 1)], 50, 3, cell).collect()
    sizes = {r.g: r["count"] for r in rows.groupBy("g").count().collect()}
    assert len(got) == 150 and {r.rep for r in got} == set(range(1, 51))
    assert all(r.draws == r.s[0] == sizes[r.g] for r in got)
    again = stats.bootstrap_sums(rows.repartition(9), "g", "k", [F.lit(1.0), F.col("x"), F.when(F.col("y") == 1, 1)], 50, 3, cell).collect()
    assert sorted((str(r.g), r.rep, r.s) for r in got) == sorted((str(r.g), r.rep, r.s) for r in again)


@pytest.mark.parametrize("cell", [1 << 15, 100])
def test_sums_vary_as_those_of_a_resample(rows, cell):
    """Mean and deviation of the resampled mean: those of the sample and its standard error."""
    a = rows.filter("g = 'a'")
    x = np.arange(1000.0)
    got = np.array([r.s[0] / 1000 for r in stats.bootstrap_sums(a, "g", "k", [F.col("x")], 2000, 1, cell).collect()])
    error = x.std() / np.sqrt(1000)
    assert abs(got.mean() - x.mean()) < 5 * error / np.sqrt(2000) and abs(got.std() / error - 1) < 0.07


def test_interval_is_that_of_numpy(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 600)
    base, comp = (np.where(rng.random(600) < p, y, 1 - y) for p in (0.55, 0.7))
    df = spark.createDataFrame([(k % 2, k, int(a), int(b), int(c)) for k, (a, b, c) in enumerate(zip(y, base, comp))], "seed int, k int, y int, base int, comp int")

    def effect(at):
        acc = lambda p: (np.mean(p[at][y[at] == 1] == 1) + np.mean(p[at][y[at] == 0] == 0)) / 2
        return acc(comp) - acc(base)

    sides = [np.arange(s, 600, 2) for s in (0, 1)]
    want = [np.mean([effect(rng.choice(s, len(s))) for s in sides]) for _ in range(3000)]
    got = stats.bootstrap_effect(df, "seed", "k", "classes", "y", "base", "comp", 1500).first()
    assert got.effect == pytest.approx(np.mean([effect(s) for s in sides]))
    assert got.low == pytest.approx(np.quantile(want, 0.025), abs=0.012) and got.high == pytest.approx(np.quantile(want, 0.975), abs=0.012)
    number = df.selectExpr("seed", "k", "k * 1.0 as y", "k + 2.0 as base", "k - 1.0 as comp")
    assert tuple(stats.bootstrap_effect(number, "seed", "k", "regression", "y", "base", "comp", 20).first()) == (1.0, 1.0, 1.0)
