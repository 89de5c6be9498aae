import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import nearest, pairs


def truth(v, k):
    d = nearest.distances(v, v)
    np.fill_diagonal(d, np.inf)
    return {(a, b): d[a, b] for a in range(len(v)) for b in sorted(range(len(v)), key=lambda b: (d[a, b], b))[:k] if b != a}


def points(spark, v):
    return spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "id long, v array<double>").repartition(3)


@pytest.mark.parametrize("how", [{}, {"pivots": 5, "ring": 3}, {"pivots": 1, "ring": 1000}])
def test_nearest_is_exact(spark, how):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(70, 4)), 1)
    v[10:16] = v[9]  # ties
    got = {(r.id, r.neighbour): r.distance for r in nearest.nearest(points(spark, v), 4, **how).collect()}
    want = truth(v, 4)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_few_rows(spark):
    assert nearest.nearest(points(spark, np.zeros((1, 3))), 2).count() == 0
    assert {(r.id, r.neighbour) for r in nearest.nearest(points(spark, np.eye(3)), 5).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}


def test_few_pairs_are_compared_where_rows_cluster(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 6))[rng.integers(0, 40, 3000)] * 20 + rng.normal(size=(3000, 6)) * 0.1
    r = nearest.rings(points(spark, v), ring=64)
    own = nearest._own(r, 5)
    sizes = {(int(c), int(g)): int(n) for c, g, n in zip(r.cell, r.ring, r.size)}
    asked = nearest.open_rings(r, own, 5).groupBy("cell", "ring").count().collect()
    compared = sum(x * x for x in sizes.values()) + sum(a["count"] * sizes[a.cell, a.ring] for a in asked)
    assert sum(sizes.values()) == 3000 and compared < 0.1 * 3000**2
    got = {(r.id, r.neighbour) for r in nearest.nearest(points(spark, v), 5, ring=64).collect()}
    assert got == set(truth(v, 5))


def test_records_are_imputed_and_scaled(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(30, 3)) * [1, 1000, 0.001]
    rows = [(f"r{k:02}", k, [float(a), float(b), None if k == 4 else float(c)]) for k, (a, b, c) in enumerate(v)]
    seg = spark.createDataFrame(rows, "record string, key long, v array<double>")
    filled = v.copy()
    filled[4, 2] = np.median(np.delete(v[:, 2], 4))
    z = (filled - filled.mean(0)) / filled.std(0)
    got = {(int(r.record[1:]), int(r.neighbour[1:])) for r in pairs.nearest_records(seg, "record", "v", 3).collect()}
    assert got == set(truth(z, 3))
    hard = [tuple(r) for r in pairs.hard_negatives(seg, "key", "record", "v", 500, 2).collect()]
    near, three = truth(z, 1), truth(z, 3)
    pool = {tuple(sorted(p)) for p in three if p not in near}
    assert len(hard) == len(set(hard)) and set(hard) == pool  # each record has one segment


def test_hard_negatives_take_turns(spark):
    seg = spark.range(400).select(F.col("id").alias("key"), (F.col("id") % 8).alias("record"), F.array((F.col("id") % 8).cast("double")).alias("v"))
    got = [tuple(r) for r in pairs.hard_negatives(seg, "key", "record", "v", 100, 2).collect()]
    assert len(got) == len(set(got)) == 100 and all(a % 8 != b % 8 and a < b for a, b in got)


def test_a_utility_run_stores_its_split(spark, monkeypatch):
    """Fits read one stored table of the split, not the joins that made it."""
    from quillon.operators import models

    names, stored = [], models.written
    monkeypatch.setattr(models, "written", lambda d, name: names.append(name) or stored(d, name))
    d = spark.range(200).selectExpr("id % 20 AS record", "cast(id % 2 AS string) AS label", "cast(id % 7 + id % 2 * 3 AS double) AS x")
    assert models.utility(d, "record", ["x"], "label").count() == 1
    assert names.count("split") == 1 and names.count("scored") == 2


def test_ordered_pairs_of_one_record_are_spread_over_tasks(spark):
    """Blocks against brute force, with repeated refs and nulls; no task has most of a record's pairs."""
    rows = [("hot", r) for r in [*range(300), 7, 7]] + [("few", 5), ("few", 9), ("one", 3), (None, 1), (None, 9), ("few", None)]
    seg = spark.createDataFrame(rows, "record string, ref long").repartition(3)
    for gap in (0, 40):
        out = pairs.ordered_pairs(seg, "record", "ref", gap, size=16)
        got = sorted(tuple(r) for r in out.collect())
        assert got == sorted((a, x, y) for a, x in rows for b, y in rows if a == b and None not in (a, x, y) and x != y and abs(x - y) >= gap)
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) > 1 and max(tasks) < 0.6 * len(got)
    assert pairs.ordered_pairs(seg.limit(0), "record", "ref", 1).count() == 0
