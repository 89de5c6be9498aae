"""Draws of partners: whoever has one gets one, and each valid partner is as likely as any other."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import draws, gallery, pairs


def segments(spark, records: int, each: int):
    return spark.range(records * each).select(F.col("id").alias("key"), (F.col("id") % records).alias("record"), F.floor(F.col("id") / records).alias("ref"))


def test_every_segment_with_a_mate_gets_one(spark):
    # Of nine refs 0 to 8 at a gap of 5 only the middle one, 4, has no mate.
    got = draws.mates(segments(spark, 400, 9), "key", "record", "ref", 5).collect()
    assert len(got) == len({r.key for r in got}) == 3200
    assert all(r.key % 400 == r.mate % 400 == r.record and abs(r.key // 400 - r.mate // 400) >= 5 for r in got)


def test_every_segment_gets_a_stranger_beside_a_large_record(spark):
    rows = spark.range(1000).select(F.col("id").alias("key"), F.when(F.col("id") < 950, 0).otherwise(F.col("id") % 7 + 1).alias("record"))
    got = draws.strangers(rows, "key", "record").collect()
    of = {r.key: r.record for r in rows.collect()}
    assert len(got) == len({r.key for r in got}) == 1000 and all(of[r.stranger] != r.record == of[r.key] for r in got)
    assert draws.strangers(rows.filter("record = 0"), "key", "record").count() == 0


def test_pairs_at_a_gap_that_few_have(spark):
    one = segments(spark, 1, 2000)
    got = pairs.positive_pairs(one, "record", "ref", 1950, per_record=30).collect()
    assert len(got) == len({(r.ref_a, r.ref_b) for r in got}) == 30 and all(r.ref_b - r.ref_a >= 1950 for r in got)
    every = pairs.positive_pairs(one, "record", "ref", 1950, per_record=5000)
    assert every.count() == every.distinct().count() == 1275
    assert every.exceptAll(pairs.positive_pairs(one, "record", "ref", 1950)).count() == 0


@pytest.mark.parametrize("gap", [0, 1, 2.5, 40])
def test_places_are_counts(spark, gap):
    rng = np.random.default_rng(1)
    rows = [(k, f"r{int(r)}" if r else None, None if k == 7 else float(x)) for k, (r, x) in enumerate(zip(rng.integers(0, 4, 300), rng.permutation(300) / 2))]
    df = spark.createDataFrame(rows, "key long, record string, ref double")
    got = {r.key: r for r in draws.places(df, "key", "record", "ref", gap).collect()}
    known = [r for r in rows if r[1] and r[2] is not None]
    assert set(got) == {r[0] for r in known}
    for key, record, ref in known:
        refs = sorted(x for _, r, x in known if r == record)
        place = got[key]
        assert (place["rank"], place.total) == (refs.index(ref) + 1, len(refs))
        if gap:
            assert (place.lo, place.hi) == (sum(x <= ref - gap for x in refs), sum(x < ref + gap for x in refs))
    mates = draws.mates(df, "key", "record", "ref", gap, k=3).collect()
    at = {k: (r, x) for k, r, x in known}
    assert all(at[m.key][0] == at[m.mate][0] and m.key != m.mate and abs(at[m.key][1] - at[m.mate][1]) >= gap for m in mates)
    for key, n in Counter((m.key) for m in mates).items():
        assert n == min(3, sum(k != key and r == at[key][0] and abs(x - at[key][1]) >= gap for k, (r, x) in at.items()))
    assert len({(m.key, m.mate) for m in mates}) == len(mates)


def test_draws_are_even(spark):
    many = spark.range(2400).select(F.explode(draws.distinct_numbers(F.lit(6), 3, "id", seed=1)).alias("x")).groupBy("x").count().collect()
    assert len(many) == 6 and all(abs(r["count"] - 1200) < 120 for r in many)
    got = Counter((r.ref_a, r.ref_b) for r in draws.drawn_pairs(segments(spark, 720, 5), "record", "ref", 1, 2).collect())
    assert len(got) == 10 and all(abs(n - 144) < 45 for n in got.values())
    got = Counter((r.key // 300, r.mate // 300) for r in draws.mates(segments(spark, 300, 8), "key", "record", "ref", 3).collect())
    for ref in range(8):
        valid = [x for x in range(8) if abs(x - ref) >= 3]
        assert {x for r, x in got if r == ref} == set(valid) and all(abs(got[ref, x] - 300 / len(valid)) < 60 for x in valid)


def test_gallery_of_one_and_many(spark):
    seg = segments(spark, 150, 4)
    got = gallery.gallery(seg, "key", "record", "ref", 20, 99, 1, 3, trues=3).collect()
    for q in {r.query for r in got}:
        own = [r for r in got if r.query == q]
        assert sum(r.label for r in own) == 3 == len({r.candidate for r in own if r.label})
        assert all(r.candidate % 150 == q % 150 and r.candidate != q for r in own if r.label)
        others = [r.candidate % 150 for r in own if not r.label]
        assert len(others) == len(set(others)) == 99 and q % 150 not in others
    assert len({r.query for r in got}) == 20


def test_a_bounded_draw_of_all_pairs_lists_none(spark):
    """`most` of all pairs: distinct, at the gap, even over records by their pairs, and no plan that joins a record to itself."""
    segs = spark.createDataFrame([(r, k, r * 1000 + k) for r, n in ((0, 300), (1, 150), (2, 1), (3, 2)) for k in range(n)], "record int, ref int, key int")
    plan = pairs.positive_pairs(segs, "record", "ref", gap=2, most=400, seed=3)
    got = [(r.record, r.ref_a, r.ref_b) for r in plan.collect()]
    assert len(got) == len(set(got)) == 400 and all(b - a >= 2 for _, a, b in got)
    share = sum(r == 0 for r, _, _ in got) / 400
    want = 299 * 298 / (299 * 298 + 149 * 148)
    assert abs(share - want) < 0.1 and len({a for r, a, _ in got if r == 0}) > 100
    text = plan._jdf.queryExecution().analyzed().toString().replace("\n", " ")
    assert "ref_b" in text and not re.search(r"ref_b#\d+ - ref_a#\d+\) >=", text)
    again = pairs.positive_pairs(segs.repartition(7), "record", "ref", gap=2, most=400, seed=3).collect()
    assert set(got) == {(r.record, r.ref_a, r.ref_b) for r in again}
    few = pairs.positive_pairs(segs.filter("record = 3"), "record", "ref", gap=0, most=400)
    assert [(r.ref_a, r.ref_b) for r in few.collect()] == [(0, 1)]


@pytest.mark.parametrize("gap", [0, 2.5])
def test_small_records_give_the_same_pairs_in_one_shuffle(spark, gap):
    rng = np.random.default_rng(4)
    rows = [(None if k == 3 else f"r{int(r)}", None if k == 9 else float(x)) for k, (r, x) in enumerate(zip(rng.integers(0, 9, 240) ** 2 // 9, rng.permutation(240) / 2))]
    df = spark.createDataFrame(rows, "record string, ref double").repartition(3)
    ranged, mixed, alone = (draws.drawn_pairs(df, "record", "ref", gap, 7, 5, small=n) for n in (0, 30, 400))
    want = sorted(map(tuple, ranged.collect()))
    assert want == sorted(map(tuple, mixed.collect())) == sorted(map(tuple, alone.collect())) and len(want) > 20
    assert all(b > a and b - a >= gap for _, a, b in want)
    first = pairs.positive_pairs(df, "record", "ref", gap, per_record=7, most=11, seed=5)
    order = pairs.ranked(ranged, pairs.hash_52("record", "ref_a", "ref_b", seed=5)).filter("rank_ <= 11").select("record", "ref_a", "ref_b")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, order.collect()))
    few = pairs.positive_pairs(segments(spark, 20, 5), "record", "ref", gap, per_record=7, most=11)
    assert few._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
