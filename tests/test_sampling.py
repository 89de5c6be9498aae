import pytest
from pyspark.sql import functions as F

from quillon.operators import pairs, sampling, views


@pytest.fixture(scope="module")
def segments(spark):
    rows = [(f"R{i}", s, "Atrial" if i % 2 == 0 else "NonAtrial", i + 0.1 * s, i % 2 + 0.2 * s) for i in range(10) for s in range(3)]
    return spark.createDataFrame(rows, "patient_id string, segment_ref int, utility_label string, feature_a double, feature_b double")


def test_holdout_is_disjoint_and_whole(segments):
    for seed in (0, 1, 42):
        held = sampling.group_holdout(segments, "patient_id", 0.2, seed)
        assert held.count() == 10 and held.filter("is_test").count() == 2
    a = segments.join(held.filter("is_test"), "patient_id")
    b = segments.join(held.filter("not is_test"), "patient_id")
    sampling.assert_disjoint(a, b, "patient_id")


def test_overlap_raises(segments):
    with pytest.raises(ValueError, match="both sides"):
        sampling.assert_disjoint(segments.limit(2), segments.limit(3), "patient_id")


def test_stratified_holdout_has_both_labels_and_falls_back(spark, segments):
    held = sampling.stratified_group_holdout(segments, "patient_id", "utility_label", 0.2, 7)
    assert {tuple(r) for r in held.filter("is_test").groupBy("utility_label").count().collect()} == {("Atrial", 1), ("NonAtrial", 1)}
    one = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "patient_id string, utility_label string")
    assert sampling.stratified_group_holdout(one, "patient_id", "utility_label", 0.5).filter("is_test").count() == 2


def test_three_parts_cover_all(segments):
    got = dict(tuple(r) for r in sampling.three_way_split(segments, "patient_id", 0.2, 0.2, 3).groupBy("part").count().collect())
    assert got == {"test": 2, "val": 2, "train": 6}


def test_split_does_not_depend_on_partitions(segments):
    same = [sorted(map(tuple, sampling.group_holdout(segments.repartition(n), "patient_id", 0.3, 5).collect())) for n in (1, 8)]
    assert same[0] == same[1]


def test_sample_sizes_and_empty(spark, segments):
    key = F.concat_ws("-", "patient_id", "segment_ref").alias("key")
    keyed = segments.select(key, "utility_label")
    assert sampling.sample(keyed, "key", 7).count() == 7
    assert sampling.sample(keyed, "key", 99).count() == 30
    assert sampling.sample_replaced(keyed, "key", 50).count() == 50
    assert sampling.sample(keyed.limit(0), "key", 5).count() == 0
    got = dict(tuple(r) for r in sampling.balanced_sample(keyed, "key", "utility_label", 11, 2, 1).groupBy("utility_label").count().collect())
    assert sum(got.values()) == 11 and min(got.values()) >= 5


def test_pairs_keep_gap_and_records(segments):
    pos = pairs.positive_pairs(segments, "patient_id", "segment_ref", gap=2)
    assert {(r.ref_a, r.ref_b) for r in pos.collect()} == {(0, 2)} and pos.count() == 10
    both = pairs.ordered_pairs(segments, "patient_id", "segment_ref", 1)
    assert both.count() == 60
    keyed = segments.withColumn("key", F.concat_ws("-", "patient_id", "segment_ref"))
    neg = pairs.random_negatives(keyed, "key", "patient_id", 40, seed=1).collect()
    assert len(neg) == 40 and len({tuple(r) for r in neg}) == 40
    assert all(r.key_a.split("-")[0] != r.key_b.split("-")[0] and r.key_a < r.key_b for r in neg)
    same = pairs.random_negatives(keyed, "key", "patient_id", 40, seed=1, label="utility_label").collect()
    assert all(int(r.key_a[1]) % 2 == int(r.key_b[1]) % 2 for r in same)
    table = pairs.pair_table(keyed, "key", "patient_id", "segment_ref", 12, seed=2)
    assert dict(tuple(r) for r in table.groupBy("pair_label").count().collect()) == {1: 12, 0: 12}


def test_incomplete_records_leave_the_view(spark):
    df = spark.createDataFrame([("A", 0, "Atrial", 1.0), ("A", 4, "Atrial", 3.0), ("B", 0, "Non-Atrial", 10.0)], "patient_id string, segment_ref int, utility_label string, feature double")
    assert [tuple(r) for r in views.complete_view(df, "patient_id", "segment_ref", [0, 4], ["feature"], "utility_label").collect()] == [("A", "Atrial", 2.0)]


def test_checked_joins(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    with pytest.raises(KeyError):
        views.aligned(df, df.filter("k = 1").select("k", F.lit(1).alias("t")), "k")
    with pytest.raises(ValueError, match="more than one"):
        views.exactly_one(df, F.col("k") > 0)
    new = spark.createDataFrame([(2, 9.0)], "k long, v double")
    assert sorted(map(tuple, views.updated(df, new, ["k"], ["v"]).collect())) == [(1, 1.0), (2, 9.0)]
