"""Draws of partners without rejection: a hash picks a number among the valid ones, and ranks say who that is.

What is valid is counted, not tried: of a segment of a record those below and above its refs' gap are two runs of ranks,
and all segments but those of a record are all ranks but one run. So whoever has a partner gets one. Ranks and counts
come from running sums inside ranges of values and then over the ranges; no task holds a whole record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import TWO_52, hash_52
from ..sources.stored import written
from .quantiles import in_ranges
from .sampling import CELLS, ranked

#: Segments of a record that drawn_pairs holds in an array.
SMALL = 64


def distinct_numbers(n: Column, k: int, *keys: str | Column, seed: int | str = 0) -> Column:
    """An array of min(n, k) distinct numbers of [0, n), every set of so many equally likely (Floyd's method); n > 0."""
    n = n.cast("long")
    least = F.least(n, F.lit(k).cast("long"))
    last = lambda i: n - least + i
    step = lambda i: F.struct(F.pmod(hash_52(*keys, i, seed=seed), last(i) + 1).alias("t"), last(i).alias("j"))
    if k == 1:
        return F.array(F.pmod(hash_52(*keys, F.lit(0), seed=seed), n))
    steps = F.transform(F.sequence(F.lit(0).cast("long"), least - 1), step)
    return F.aggregate(steps, F.array().cast("array<bigint>"), lambda acc, s: F.array_append(acc, F.when(F.array_contains(acc, s["t"]), s["j"]).otherwise(s["t"])))


def running(rows: DataFrame, by: list[str], value: str, order: list[str], add: str, name: str, ranges: int = 128) -> DataFrame:
    """rows with `name`, the running sum of `add` in each group by value and then `order` (the row itself included),
    name_all, the group's sum, and part_, the range of values that the row is in."""
    rows = in_ranges(rows, value, "part_", ranges)
    cells = rows.groupBy(*by, "part_").agg(F.sum(add).alias("n_"))
    group = Window.partitionBy(*by)  # at most a row a range
    cells = cells.select(*(F.col(c).alias(f"{c}_of") for c in by), F.col("part_").alias("part_of"), (F.sum("n_").over(group.orderBy("part_")) - F.col("n_")).alias("before_"), F.sum("n_").over(group).alias(f"{name}_all"))
    on = rows["part_"] == cells["part_of"]
    for c in by:
        on = on & rows[c].eqNullSafe(cells[f"{c}_of"])
    out = rows.join(cells, on).drop("part_of", *(f"{c}_of" for c in by))
    own = Window.partitionBy(*by, "part_").orderBy(value, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn(name, F.sum(add).over(own) + F.col("before_")).drop("before_")


def places(segments: DataFrame, key: str, record: str, ref: str, gap: float) -> DataFrame:
    """key, record, ref, rank (from 1, by ref and key), total, lo and hi: of the record's ranks those up to lo and those
    above hi are at least `gap` away from the segment; with a gap of 0 all but its own are.

    Segments without a record or ref are left out. Keys are unique in a record.
    """
    seg = segments.select(F.col(key).alias("key_"), F.col(record).alias("record_"), F.col(ref).cast("double").alias("ref_")).dropna(subset=["record_", "ref_"])
    # At one value first comes the search for what is below it, then the segments, then the search for what is not above.
    at = lambda x, kind: seg.select("key_", "record_", x.alias("at_"), F.lit(kind).alias("kind_"), F.lit(int(kind == 1)).cast("long").alias("one_"))
    rows = at(F.col("ref_"), 1)
    if gap > 0:
        rows = rows.unionByName(at(F.col("ref_") + gap, 0)).unionByName(at(F.col("ref_") - gap, 2))
    rows = running(rows, ["record_"], "at_", ["kind_", "key_"], "one_", "rank")
    of = lambda kind, x: F.max(F.when(F.col("kind_") == kind, F.col(x)))
    out = rows.groupBy("record_", "key_").agg(of(1, "rank").alias("rank"), F.max("rank_all").alias("total"), of(2, "rank").alias("lo"), of(0, "rank").alias("hi"), of(1, "at_").alias("ref_"))
    lo, hi = (F.col("lo"), F.col("hi")) if gap > 0 else (F.col("rank") - 1, F.col("rank"))
    return out.select(F.col("key_").alias(key), F.col("record_").alias(record), F.col("ref_"), "rank", "total", lo.alias("lo"), hi.alias("hi"))


def mates(segments: DataFrame, key: str, record: str, ref: str, gap: float, k: int = 1, seed: int | str = 0) -> DataFrame:
    """key, record, mate: for every segment min(k, as many as there are) others of its record at the gap, each set alike."""
    seg = places(segments, key, record, ref, gap)
    valid = F.col("lo") + F.col("total") - F.col("hi")
    pick = F.explode(distinct_numbers(valid, k, key, seed=seed)).alias("j")
    drawn = seg.filter(valid > 0).select(key, record, "lo", "hi", pick)
    drawn = drawn.select(key, record, F.when(F.col("j") < F.col("lo"), F.col("j") + 1).otherwise(F.col("hi") + 1 + F.col("j") - F.col("lo")).alias("rank"))
    return drawn.join(seg.select(record, "rank", F.col(key).alias("mate")), [record, "rank"]).select(key, record, "mate")


def drawn_pairs(segments: DataFrame, record: str, ref: str, gap: float, k: int, seed: int | str = 0, small: int = SMALL) -> DataFrame:
    """record, ref_a, ref_b: of every record min(k, as many as there are) unordered pairs at the gap, each set alike.

    Refs are unique in a record. A record's pairs are numbered by their lower segment and then the other one: the number
    that is drawn falls to the segment whose run of pairs holds it, and what is left of it is the other one's place.
    Records of at most `small` segments are numbered in their own rows, others by running sums over ranges.
    """
    numbers = lambda pairs: pairs.select(record, F.explode(distinct_numbers(F.col("pairs"), k, record, seed=seed)).alias("j"))
    kind = segments.schema[ref].dataType
    large = written(segments.groupBy(record).count().filter(F.col("count") > small).select(record), "large")  # records, few if any
    if large.isEmpty():
        return _pairs_of_small(segments, record, ref, gap, kind, k, seed)
    of_large = segments.join(large, record, "left_semi")
    seg = places(of_large, ref, record, ref, gap).withColumn("later", F.col("total") - F.col("hi"))
    return _pairs_of_small(segments.join(large, record, "left_anti"), record, ref, gap, kind, k, seed).unionByName(_numbered_pairs(seg, record, ref, kind, numbers))


def _pairs_of_small(segments: DataFrame, record: str, ref: str, gap: float, kind, k: int, seed: int | str) -> DataFrame:
    """drawn_pairs of records whose segments an array may hold: all in one shuffle by record."""
    seg = segments.select(F.col(record), F.struct(F.col(ref).cast("double").alias("at"), F.col(ref).alias("ref")).alias("s_")).filter(F.col(record).isNotNull() & F.col("s_.at").isNotNull() & ~F.isnan("s_.at"))
    rows = seg.groupBy(record).agg(F.array_sort(F.collect_list("s_")).alias("all_"))
    later = lambda s, i: F.size(F.filter("all_", lambda x: x["at"] >= s["at"] + gap)) if gap > 0 else F.size("all_") - 1 - i
    rows = rows.select(record, "all_", F.transform("all_", later).alias("later_"))
    ends = F.aggregate("later_", F.array().cast("array<bigint>"), lambda acc, n: F.array_append(acc, n + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long"))))
    rows = rows.select(record, "all_", ends.alias("ends_")).filter(F.element_at("ends_", -1) > 0)
    rows = rows.select(record, "all_", "ends_", F.explode(distinct_numbers(F.element_at("ends_", -1), k, record, seed=seed)).alias("j"))
    at = F.size(F.filter("ends_", lambda e: e <= F.col("j")))  # the first segment whose run of pairs ends after the number
    rows = rows.withColumn("at_", at).withColumn("a_", F.get("all_", F.col("at_")))
    # Of the segments of its run, the last `later` ones of the record, the one at the number's place in the run.
    other = F.size("all_") - (F.get("ends_", F.col("at_")) - F.col("j"))
    return rows.select(record, F.col("a_.ref").cast(kind).alias("ref_a"), F.get("all_", other.cast("int"))["ref"].cast(kind).alias("ref_b"))


def drawn_of_all(segments: DataFrame, record: str, ref: str, gap: float, most: int, seed: int | str = 0) -> DataFrame | None:
    """record, ref_a, ref_b: `most` of the unordered pairs at the gap of all records, each set alike, without listing the
    pairs; None if there are no more than four times as many. Refs are unique in a record.

    Pairs are numbered by record and then as in drawn_pairs. Twice as many numbers are drawn; the first distinct ones stay.
    """
    seg = written(places(segments, ref, record, ref, gap).withColumn("later", F.col("total") - F.col("hi")), "places")
    cell = F.floor(hash_52(record, seed=seed) / F.lit(TWO_52 / CELLS)).cast("int").alias("cell_")
    sizes = seg.groupBy(record).agg(F.sum("later").alias("n_")).filter("n_ > 0").select(record, cell, "n_")
    cells = written(sizes.groupBy("cell_").agg(F.sum("n_").alias("n_")), "cells")  # CELLS at most
    total = cells.agg(F.sum("n_")).first()[0] or 0
    if total <= 4 * most:
        return None
    cells = cells.select(F.col("cell_").alias("at_"), (F.sum("n_").over(Window.partitionBy(F.lit(0)).orderBy("cell_")) - F.col("n_")).alias("first_"), "n_")
    draws = segments.sparkSession.range(2 * most + 64).select("id", F.pmod(hash_52("id", seed=f"{seed}all"), F.lit(total)).alias("j"))
    draws = draws.groupBy("j").agg(F.min("id").alias("id")).orderBy("id").limit(most).select("j")
    draws = written(draws.join(F.broadcast(cells), F.expr("j >= first_ and j < first_ + n_")).select("at_", (F.col("j") - F.col("first_")).alias("j")), "draws")
    ends = sizes.withColumn("end_", F.sum("n_").over(Window.partitionBy("cell_").orderBy(record)))
    own = draws.join(ends, F.expr("at_ = cell_ and j >= end_ - n_ and j < end_")).select(F.col(record), (F.col("j") - F.col("end_") + F.col("n_")).alias("j"))
    return _numbered_pairs(seg, record, ref, segments.schema[ref].dataType, lambda pairs: own)


def _numbered_pairs(seg: DataFrame, record: str, ref: str, kind, numbers) -> DataFrame:
    """record, ref_a, ref_b: of the places with `later` the pairs of each record whose numbers (record, j) are given."""
    # Each segment's run of pairs: those of the segments before it end where it starts.
    seg = running(seg, [record], "ref_", [ref], "later", "end").withColumn("start", F.col("end") - F.col("later"))
    parts = seg.groupBy(record, "part_").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.max("end_all").alias("pairs"))
    draws = numbers(parts.filter("pairs > 0").groupBy(record).agg(F.max("pairs").alias("pairs")))
    draws = draws.join(parts.filter("last > first").select(record, "part_", "first", "last"), record).filter("j >= first and j < last")  # a range a draw
    rows = seg.filter("later > 0").select(record, "part_", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct(F.col(ref).alias("ref"), "start", "hi").alias("low"))
    rows = rows.unionByName(draws.select(record, "part_", F.col("j").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["low"].dataType).alias("low")))
    found = F.last("low", ignorenulls=True).over(Window.partitionBy(record, "part_").orderBy("at", "kind"))
    rows = rows.withColumn("low", found).filter("kind = 1").select(record, F.col("low.ref").alias("ref_a"), (F.col("low.hi") + 1 + F.col("at") - F.col("low.start")).alias("rank"))
    return rows.join(seg.select(record, "rank", F.col(ref).alias("ref_b")), [record, "rank"]).select(record, F.col("ref_a").cast(kind).alias("ref_a"), F.col("ref_b").cast(kind).alias("ref_b"))


def strangers(segments: DataFrame, key: str, record: str, seed: int | str = 0) -> DataFrame:
    """key, record, stranger: for every segment one of all segments of other records, each alike; none if there is no other record.

    Records are runs of ranks, in the order of a hash; the number drawn skips the segment's own run.
    """
    seg = ranked(segments.select(key, record).dropna(), hash_52(key, seed=seed), by=[record], ties=[key])
    sizes = seg.groupBy(record).agg(F.max("total_").alias("size"))
    order = hash_52(record, seed=seed)
    cell = F.floor(order / F.lit(TWO_52 / CELLS)).cast("int")
    sizes = sizes.withColumn("order_", order).withColumn("cell_", cell)
    cells = sizes.groupBy("cell_").agg(F.sum("size").alias("n_"))  # CELLS at most
    all_ = Window.partitionBy(F.lit(0))
    cells = cells.select("cell_", (F.sum("n_").over(all_.orderBy("cell_")) - F.col("n_")).alias("before_"), F.sum("n_").over(all_).alias("all_"))
    own = Window.partitionBy("cell_").orderBy("order_", record).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.join(F.broadcast(cells), "cell_").select(record, "size", "all_", (F.sum("size").over(own) - F.col("size") + F.col("before_")).alias("start"))
    rows = seg.join(starts, record).select(key, record, "size", "all_", "start", (F.col("start") + F.col("rank_") - 1).alias("at"))
    j = F.pmod(hash_52(key, F.lit(0), seed=seed), F.col("all_") - F.col("size"))
    drawn = rows.filter("all_ > size").select(key, record, F.when(j < F.col("start"), j).otherwise(j + F.col("size")).alias("at"))
    return drawn.join(rows.select("at", F.col(key).alias("stranger")), "at").select(key, record, "stranger")
