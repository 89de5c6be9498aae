"""Samples and splits by keyed hash: exact sizes, no leakage between groups, the same on every rerun.

The rank that decides membership is found from a histogram of the hash, so that no task ever sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import TWO_52, hash_52
from ..sources.stored import written

#: Cells of the histogram.
CELLS = 4096


def ranked(df: DataFrame, order: Column, by: list[str] = (), ties: list[str] = ()) -> DataFrame:
    """df with rank_ (1, 2, ... by order, a number in [0, 2^52), then ties) and total_ in each group of `by`."""
    by, cell = list(by), F.floor(order / F.lit(TWO_52 / CELLS)).cast("int")
    df = df.withColumn("_order", order).withColumn("_cell", cell)
    cells = df.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    cells = cells.withColumn("_before", F.sum("_n").over(group.orderBy("_cell")) - F.col("_n")).withColumn("total_", F.sum("_n").over(group)).drop("_n")
    for c in by:
        cells = cells.withColumnRenamed(c, f"_{c}")
    cells = cells.withColumnRenamed("_cell", "_at")
    on = df["_cell"] == cells["_at"]
    for c in by:
        on = on & df[c].eqNullSafe(cells[f"_{c}"])
    out = df.join(cells, on).drop("_at", *(f"_{c}" for c in by))
    own = Window.partitionBy(*by, "_cell").orderBy("_order", *ties)
    return out.withColumn("rank_", F.row_number().over(own) + F.col("_before")).drop("_order", "_cell", "_before")


def in_order(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with a column `name`: the place of the row, from 1, in `order`, which tells all rows apart.

    Rows are sorted by ranges; a place is the number of rows in the ranges before and the place in its own, so that no
    task holds more than a range. The driver gets one count a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "order")
    rows = rows.withColumn("part_", F.shiftright(name, 33)).withColumn(name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))
    before, total = [], 0
    for k, x in sorted(tuple(r) for r in rows.groupBy("part_").agg(F.count("*")).collect()):
        before.append((k, total))
        total += x
    starts = df.sparkSession.createDataFrame(before, "part_ long, start_ long")
    return rows.join(F.broadcast(starts), "part_").withColumn(name, F.col(name) + F.col("start_") + 1).drop("part_", "start_")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement (all, if there are fewer), by the hash of key."""
    return ranked(df, hash_52(key, seed=seed), ties=[key]).filter(F.col("rank_") <= n).drop("rank_", "total_")


def sample_replaced(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement: draw (0, 1, ...) and the row drawn."""
    rows = ranked(df, hash_52(key, seed=seed), ties=[key])
    size = rows.agg(F.max("total_").alias("m_"))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(size))  # the size is one row
    draws = draws.withColumn("pick_", F.pmod(hash_52("draw", seed=seed), F.col("m_")) + 1).filter("m_ > 0")
    return draws.join(rows, draws["pick_"] == rows["rank_"]).drop("m_", "pick_", "rank_", "total_")


def balanced_sample(df: DataFrame, key: str, label: str, n: int, classes: int, seed: int = 0) -> DataFrame:
    """n rows, as evenly over the labels as they allow; what a small label lacks is filled from the rest by hash."""
    share = n // classes
    rows = ranked(df, hash_52(key, seed=seed), by=[label], ties=[key])
    rows = rows.withColumn("_first", F.col("rank_") <= share).drop("rank_", "total_")
    # First the shares of the labels, then the others.
    order = hash_52(key, seed=f"{seed}fill")
    rows = ranked(rows, F.when(F.col("_first"), F.floor(order / 2)).otherwise(F.floor(order / 2) + int(TWO_52 / 2)).cast("long"), ties=[key])
    return rows.filter(F.col("rank_") <= n).drop("_first", "rank_", "total_")


def group_holdout(df: DataFrame, group: str, test: float = 0.2, seed: int = 0) -> DataFrame:
    """group and is_test: ceil(groups * test) whole groups are held out."""
    rows = ranked(df.select(group).distinct(), hash_52(group, seed=seed), ties=[group])
    return rows.select(group, (F.col("rank_") <= F.ceil(F.col("total_") * test)).alias("is_test"))


def stratified_group_holdout(df: DataFrame, group: str, label: str, test: float = 0.2, seed: int = 0) -> DataFrame:
    """Like group_holdout, within each label; a group has the least of its labels. Falls back to it if a label has one group or there is one label."""
    groups = df.groupBy(group).agg(F.min(label).alias(label))
    rows = ranked(groups, hash_52(group, seed=seed), by=[label], ties=[group])
    plain = ranked(groups, hash_52(group, seed=seed), ties=[group]).select(group, (F.col("rank_") <= F.ceil(F.col("total_") * test)).alias("plain_"))
    small = groups.groupBy(label).count().agg((F.coalesce(F.min("count"), F.lit(0)) < 2).alias("a"), (F.count("*") < 2).alias("b")).select((F.col("a") | F.col("b")).alias("fall_"))
    out = rows.join(plain, group).crossJoin(F.broadcast(small))  # one row
    return out.select(group, label, F.when(F.col("fall_"), F.col("plain_")).otherwise(F.col("rank_") <= F.ceil(F.col("total_") * test)).alias("is_test"))


def three_way_split(df: DataFrame, group: str, test: float = 0.2, val: float = 0.2, seed: int = 0) -> DataFrame:
    """group and part: test, then val/(1 - test) of the rest by seed + 1 as val, the others train."""
    first = group_holdout(df, group, test, seed)
    rest = group_holdout(first.filter(~F.col("is_test")), group, val / (1 - test), seed + 1)
    return first.filter("is_test").select(group, F.lit("test").alias("part")).unionByName(rest.select(group, F.when(F.col("is_test"), "val").otherwise("train").alias("part")))


def overlap(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Groups that are in both; a split without leakage has none."""
    return a.select(group).distinct().join(b.select(group).distinct(), group, "left_semi")


def assert_disjoint(a: DataFrame, b: DataFrame, group: str, context: str = "split") -> None:
    if found := overlap(a, b, group).take(5):
        raise ValueError(f"{context}: groups on both sides, such as {[r[0] for r in found]}")


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, with the side they are on; equal sets give none."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts the groups before the shuffle."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank_") <= k).drop("rank_")


def keep_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, key, order, 1)
