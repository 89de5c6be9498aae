"""Views of a record from chosen segments, and joins that are checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(segments: DataFrame, record: str, ref: str, refs: list) -> DataFrame:
    """The segments with a chosen ref, of records that have all of them."""
    rows = segments.filter(F.col(ref).isin(refs))
    whole = rows.groupBy(record).agg(F.count_distinct(ref).alias("n_")).filter(F.col("n_") == len(set(refs))).select(record)
    return rows.join(whole, record, "left_semi")


def complete_view(segments: DataFrame, record: str, ref: str, refs: list, features: list[str], label: str | None = None) -> DataFrame:
    """One row per complete record: its first non-null label by ref, and the mean of each feature over the refs."""
    first = [F.min_by(label, F.when(F.col(label).isNotNull(), F.col(ref))).alias(label)] if label else []
    return complete(segments, record, ref, refs).groupBy(record).agg(*first, *(F.avg(c).alias(c) for c in features))


def utility_only_view(segments: DataFrame, record: str, label: str, positive: str) -> DataFrame:
    """One row per record: 1.0 if its label is the positive one, else 0.0."""
    return segments.groupBy(record).agg(F.max((F.col(label) == positive).cast("double")).alias("utility"))


def query_records(segments: DataFrame, record: str, ref: str, refs: list, known: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n complete records, by hash, of those that are in `known`."""
    from .sampling import sample

    return sample(complete(segments, record, ref, refs).select(record).distinct().join(known.select(record).distinct(), record, "left_semi"), record, n, seed)


def missing_keys(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted and not yet cached."""
    return wanted.select(key).distinct().join(cached.select(key), key, "left_anti")


def refreshed(cached: DataFrame, fresh: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key of both."""
    from .sampling import top_k

    return top_k(cached.unionByName(fresh), [key], [F.col(version).desc_nulls_last()], 1)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and how many have each column."""
    return df.agg(F.count("*").alias("rows"), *(F.count(c).alias(f"{c}_known") for c in columns))


def exactly_one(df: DataFrame, condition: Column, what: str = "row") -> DataFrame:
    """The row that meets the condition; an error unless there is exactly one."""
    rows = df.filter(condition)
    if (n := len(rows.take(2))) != 1:
        raise ValueError(f"{what}: {'no row' if not n else 'more than one row'}")
    return rows


def aligned(df: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """df joined with the targets of its keys; an error if a key has none."""
    lost = df.select(key).distinct().join(targets.select(key), key, "left_anti").take(3)
    if lost:
        raise KeyError(f"no target for {[r[0] for r in lost]}")
    return df.join(targets, key)


def updated(df: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """df with the columns taken from changes where these have the key; a null change leaves the old value."""
    new = changes.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
    return df.join(new, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns))


def constant_in_group(df: DataFrame, group: str, column: str) -> DataFrame:
    """Groups with more than one value of the column; none, if it is a property of the group."""
    return df.groupBy(group).agg(F.count_distinct(column).alias("values")).filter("values > 1")


def in_order(wanted: DataFrame, order: str, df: DataFrame, key: str) -> DataFrame:
    """The rows of df for wanted keys, in the wanted order."""
    return wanted.select(key, F.col(order).alias("_order")).join(df, key).orderBy("_order").drop("_order")
