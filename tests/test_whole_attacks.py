"""The attacks on people read every pair of known records and ask for every complete test record."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import models, pairs
from quillon.plans import people

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides(spark):
    known, test = people._sides(spark, SF)
    return known.toPandas(), test.toPandas()


@pytest.fixture
def trained_on(monkeypatch):
    """The sizes of the tables that pair attackers are fitted on, by label."""
    seen, own = [], models.PairAttacker.__init__

    def init(self, train_pairs, *how, **more):
        seen.append({r.pair_label: r["count"] for r in train_pairs.groupBy("pair_label").count().collect()})
        own(self, train_pairs, *how, **more)

    monkeypatch.setattr(models.PairAttacker, "__init__", init)
    return seen


def all_pairs(known) -> int:
    n = known.groupby("record").size()
    return int((n * (n - 1) // 2).sum())


def complete(test) -> set[int]:
    n = test[test["ref"] < 4].groupby("record").size()
    return set(n[n == 4].index.tolist())


def test_link_selection_is_whole(spark, sides, trained_on):
    got = people.link_selection(spark, SF).first()
    assert got.queries == len(complete(sides[1])) > 40
    assert trained_on == [{1: all_pairs(sides[0]), 0: all_pairs(sides[0])}]


def test_attribute_conditions_is_whole(spark, sides, trained_on):
    got = people.attribute_conditions(spark, SF).collect()
    assert len(complete(sides[1])) > 100
    assert {r.tp + r.fp + r.fn + r.tn for r in got} == {len(complete(sides[1]))} and len(got) == 4
    assert trained_on == [{1: all_pairs(sides[0]), 0: all_pairs(sides[0])}]


def test_reconstruction_conditions_is_whole(spark, sides, trained_on):
    got = people.reconstruction_conditions(spark, SF).collect()
    assert {r.n for r in got} == {len(complete(sides[1]))} and len(got) == 12
    assert trained_on == [{1: all_pairs(sides[0]), 0: all_pairs(sides[0])}]


def test_negatives_beyond_a_heap_are_the_first_draws(spark, monkeypatch):
    df = spark.range(600).select(F.col("id").alias("key"), (F.col("id") % 30).alias("record"))
    few = pairs.random_negatives(df, "key", "record", 5000, 3).collect()
    monkeypatch.setattr(pairs, "FIRST", 10)
    many = pairs.random_negatives(df, "key", "record", 5000, 3).collect()
    assert len(many) == 5000 and {tuple(r) for r in many} == {tuple(r) for r in few}
    # All pairs there are, though fewer than asked for.
    small = df.filter("key < 4")
    assert {tuple(r) for r in pairs.random_negatives(small, "key", "record", 50, 3).collect()} == {(a, b) for b in range(4) for a in range(b)}


def test_all_pairs_of_a_record_and_as_many_of_strangers(spark):
    rows = [(10 * r + k, r, k) for r in range(6) for k in range(r)]
    df = spark.createDataFrame(rows, "key long, record long, ref int")
    got = pairs.pair_table(df, "key", "record", "ref", None, 2, seed=1).collect()
    want = {(a, b) for a, r, i in rows for b, q, j in rows if r == q and j - i >= 2}
    assert {(r.key_a, r.key_b) for r in got if r.pair_label} == want and sum(r.pair_label for r in got) == len(want)
    wrong = {(r.key_a, r.key_b) for r in got if not r.pair_label}
    assert len(wrong) == len(want) and all(a // 10 != b // 10 for a, b in wrong)
