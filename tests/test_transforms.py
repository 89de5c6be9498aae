import numpy as np
import pytest

from quillon.functions.scalars import gaussian_sigma, parse_pairs
from quillon.operators import models, transforms


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (60, 3))
    x[:, 2] = 5.0
    rows = [(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(x)]
    rows[3] = (3, float("nan"), None, 5.0)
    return spark.createDataFrame(rows, "k long, a double, b double, c double")


COLS = ["a", "b", "c"]


@pytest.mark.parametrize("method", transforms.METHODS)
def test_every_method_runs_and_keeps_rows(frame, method):
    out = transforms.fit(frame, COLS, method, dim=2).transform(frame, "k").toPandas()
    assert len(out) == 60
    if method != "identity":
        assert np.isfinite(out.drop(columns="k").to_numpy()).all()


def test_population_scaling_and_constants(frame):
    out = transforms.fit(frame, COLS, "standard").transform(frame).toPandas()
    assert out.a.mean() == pytest.approx(0, abs=1e-9) and out.a.std(ddof=0) == pytest.approx(1) and (out.c == 0).all()


def test_pca_matches_numpy(frame):
    fitted = transforms.fit(frame, COLS, "pca", dim=2)
    x = transforms.fit(frame, COLS, "standard").transform(frame).toPandas()[COLS].to_numpy()
    got = fitted.transform(frame).orderBy("k").toPandas()[["pca_000", "pca_001"]].to_numpy()
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(x @ v[:2].T), atol=1e-8)


def test_noise_is_repeatable_and_sides_differ(frame):
    a, b, fitted = transforms.fit_split(frame, frame, COLS, "dp_gaussian_l2", "k", clip=2.0)
    again, _, _ = transforms.fit_split(frame.repartition(7), frame, COLS, "dp_gaussian_l2", "k", clip=2.0)
    x, y, z = (d.orderBy("k").toPandas() for d in (a, b, again))
    assert np.allclose(x, z) and not np.allclose(x.a, y.a)
    assert fitted.options["sigma"] == pytest.approx(0.387584, abs=1e-6) == gaussian_sigma(50, 1e-5, 2)
    with pytest.raises(ValueError):
        fitted.transform(frame)


def test_bad_settings():
    with pytest.raises(ValueError):
        parse_pairs(["50"])
    assert parse_pairs(["50:2"]) == [("50", "2")]


def test_ridge_matches_closed_form(frame):
    df = frame.dropna().filter("k <> 3")
    w, b = models.ridge(df, ["a"], ["b", "c"])
    p = df.toPandas()
    x, y = p[["a"]].to_numpy() - p.a.mean(), p[["b", "c"]].to_numpy()
    want = np.linalg.solve(x.T @ x + 1, x.T @ (y - y.mean(0))).T
    assert np.allclose(w, want) and np.allclose(b, y.mean(0) - want @ [p.a.mean()])


def test_regressor_network_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = np.column_stack([x[:, 0] * 2, np.abs(x[:, 1])])
    layers = models.mlp(x, y, (64, 32), epochs=80, rate=3e-3)
    z = x
    for i, (w, b) in enumerate(layers):
        z = z @ w + b
        z = np.maximum(z, 0) if i < len(layers) - 1 else z
    assert ((z - y) ** 2).mean() < 0.1 * y.var()
