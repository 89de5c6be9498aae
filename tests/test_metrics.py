import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import gallery, metrics, stats


def brute(y, s):
    y, s = np.array(y), np.array(s)
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    ap, eer, last = 0.0, [], 0
    for t in sorted(set(s), reverse=True):
        tp, fp = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum()
        ap += (tp - last) / len(pos) * tp / (tp + fp)
        last = tp
        eer.append((abs(int(fp) * len(pos) - (len(pos) - int(tp)) * len(neg)), -t, (fp / len(neg) + 1 - tp / len(pos)) / 2))
    return auc, ap, min(eer)[2]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-5, 5)), min_size=4, max_size=40).filter(lambda x: len({a for a, _ in x}) == 2))
def test_curves_match_brute_force(spark, rows):
    df = spark.createDataFrame([(y, float(s) / 4) for y, s in rows], "label int, score double")
    got = metrics.curve_metrics(df).first()
    want = brute([y for y, _ in rows], [s / 4 for _, s in rows])
    assert np.allclose([got.roc_auc, got.average_precision, got.eer], want)


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.5)], "label int, score double")
    assert metrics.curve_metrics(df).first().roc_auc is None


def test_ranking(spark):
    rows = [(1, "t", 1, 0.9), (1, "a", 0, 0.95), (2, "t", 1, 0.5), (2, "u", 0, 0.5), (3, "x", 0, 0.4), (4, "a", 1, 0.1), (4, "b", 1, 0.2)]
    df = spark.createDataFrame(rows, "query long, candidate string, label int, score double")
    got = gallery.ranking_metrics(df, (1, 2)).first()
    assert (got.queries, got.mrr, got.recall_at_1, got.recall_at_2) == (2, 0.75, 0.5, 1.0)


def test_effects_have_the_sign_of_the_improvement(spark):
    c = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 1, 1)], "y int, b int, i int")
    assert c.agg(stats.metric_effect("classes", "y", "b", "i")).first()[0] > 0
    a = spark.createDataFrame([(20.0, 30.0, 22.0), (40.0, 50.0, 42.0), (60.0, 70.0, 62.0)], "y double, b double, i double")
    assert a.agg(stats.metric_effect("regression", "y", "b", "i")).first()[0] > 0


def test_t_interval_and_pairing(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 6.0), ("b", 1, 1.0), ("b", 2, 2.0), ("b", 3, 3.0)], "c string, seed int, m double")
    got = stats.paired_contrast(df, "c", "a", "b", "seed", ["m"]).first()
    assert (got.n, got.mean) == (3, 2.0) and got.high - got.mean == pytest.approx(4.302652729911275 / 3**0.5)
    with pytest.raises(ValueError):
        stats.paired_contrast(df.filter("not (c = 'b' and seed = 3)"), "c", "a", "b", "seed", ["m"])


def test_rollup_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 2.0)], "k string, m double")
    got = {r.k: (r.n_seeds, r.m_mean) for r in stats.rollup(df, ["k"], ["m"]).collect()}
    assert got == {None: (2, 2.0), "x": (1, 2.0)}


def test_spearman_and_regression(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (3.0, 9.0), (3.0, 16.0)], "a double, b double")
    assert metrics.spearman(df, "a", "b").first()[0] == pytest.approx(0.9486832980505138)
    assert metrics.regression(df.withColumn("c", F.lit(1.0)), "c", "a").first().r2 is None
