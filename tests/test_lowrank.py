import numpy as np
import pandas as pd
import pytest

from quillon.operators import lowrank, reconstruct


def made(spark, n, width, rank, noise, seed=0):
    """n vectors near a subspace of `rank`, made in tasks, and the same in numpy."""
    basis = np.random.default_rng(seed).normal(size=(rank, width))

    def rows(k):
        rng = np.random.default_rng([seed, k])
        a = rng.normal(size=rank) * (10.0 / np.arange(1, rank + 1))
        return a, a @ basis / np.sqrt(width) + noise * rng.normal(size=width) + 3

    def run(batches):
        for b in batches:
            got = [rows(int(k)) for k in b["id"]]
            yield pd.DataFrame({"id": b["id"], "a": [list(a) for a, _ in got], "v": [list(v) for _, v in got]})

    df = spark.range(n, numPartitions=4).mapInPandas(run, "id long, a array<double>, v array<double>")
    return df, np.stack([rows(k)[0] for k in range(n)]), np.stack([rows(k)[1] for k in range(n)])


def test_components_of_12000_elements(spark):
    df, _, x = made(spark, 240, 12_000, 6, 0.002)
    got = lowrank.fit(df, "v", 6)
    z = x - x.mean(0)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    assert got.components.shape == (6, 12_000) and np.allclose(got.mean, x.mean(0))
    assert np.allclose(got.components @ got.components.T, np.eye(6), atol=1e-9)
    # Cosines of the angles between both subspaces.
    assert np.linalg.svd(got.components @ v[:6].T)[1].min() > 1 - 1e-8
    assert np.allclose(got.variance, s[:6] ** 2 / 239, rtol=1e-6) and got.explained == pytest.approx((s[:6] ** 2).sum() / (s**2).sum(), rel=1e-6)


def test_scores_and_inverse(spark):
    df, _, x = made(spark, 60, 40, 3, 0.05, seed=2)
    got = lowrank.fit(df, "v", 5)
    p = got.inverse(got.scores(df, "v", "z"), "z", "w").toPandas().sort_values("id")
    z = np.stack(p.z)
    assert np.allclose(z.mean(0), 0, atol=1e-9) and np.allclose(z.std(0), 1)
    want = (x - x.mean(0)) @ got.components.T @ got.components + x.mean(0)
    assert np.allclose(np.stack(p.w), want)
    assert lowrank.fit(df.limit(3), "v", 9).components.shape == (2, 40)  # no more than rows allow
    with pytest.raises(ValueError):
        lowrank.fit(df.limit(0), "v", 2)


def test_missing_elements_count_as_the_mean(spark):
    rows = [([1.0, None, 2.0],), ([3.0, 4.0, float("nan")],), ([5.0, 6.0, 7.0],), (None,)]
    got = lowrank.fit(spark.createDataFrame(rows, "v array<double>"), "v", 2)
    assert np.allclose(got.mean, [3, 5, 4.5]) and got.n == 3


@pytest.mark.parametrize("kind", ["ridge", "mlp"])
def test_decoders_predict_scores(spark, kind):
    df, a, x = made(spark, 300, 500, 4, 0.01, seed=5)
    df = df.select("id", *(df.a[k].alias(f"a{k}") for k in range(4)), "v")
    train, test = df.filter("id < 240"), df.filter("id >= 240")
    out = reconstruct.decode_vectors(train, test, [f"a{k}" for k in range(4)], "v", "w", 4, kind, "id")
    assert out.columns == [*test.columns, "w"]
    p = out.toPandas().sort_values("id")
    error, plain = ((np.stack(p.w) - x[240:]) ** 2).mean(), ((x[:240].mean(0) - x[240:]) ** 2).mean()
    best = reconstruct.ceiling_vectors(train, test, "v", "w", 4).toPandas().sort_values("id")
    assert error < 0.05 * plain and ((np.stack(best.w) - x[240:]) ** 2).mean() <= error + 1e-12


def test_word_vectors_in_one_scan(spark, tmp_path):
    """Counts by bucket as they are by definition, stored once and without a shuffle; each pass reads the table."""
    from quillon.plans import people

    texts = [(1, "a b a", 5), (2, "", 0), (3, None, 0), (4, " ".join(f"w{k % 700}" for k in range(3000)), 9), (None, "a", 1)]
    spark.createDataFrame(texts, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    d = people.word_vectors(spark, str(tmp_path), 16)
    assert hasattr(d, "stored_at") and "Exchange" not in d._jdf.queryExecution().toString()
    got = {r.doc_id: list(r.v) for r in d.collect()}
    assert sorted(got) == [1, 2, 4]  # without a text or a doc_id there is no vector
    words = {k: t.split(" ") for k, t, _ in texts if k in got}
    every = sorted({w for v in words.values() for w in v})
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in every], "w string").selectExpr("w", "pmod(xxhash64(w), 16) AS b").collect()}
    assert got == {k: [float(sum(bucket[w] == b for w in v)) for b in range(16)] for k, v in words.items()}


def test_conditions_fit_components_once_a_training_side(spark, monkeypatch):
    from quillon.operators import reconstruct

    fits, fit = [], lowrank.fit
    monkeypatch.setattr(lowrank, "fit", lambda *a, **k: fits.append(1) or fit(*a, **k))
    rows = [(k, float(k), [float(k), float(k % 3), 1.0 - k]) for k in range(12)]
    train = spark.createDataFrame(rows, "query int, x0 double, target array<double>")
    views = spark.createDataFrame([(q, c, [x], t) for q, x, t in rows for c in ("single", "oracle")], "query int, condition string, x array<double>, target array<double>")
    out = reconstruct.under_conditions({"single": train, "oracle": train}, views, ["x0"], "target", "query", 2)
    assert len(fits) == 2 and out.columns == ["train_condition", "condition", "decoder", "n", "rmse", "prd"]
