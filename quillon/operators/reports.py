"""Tables of results: runs put together, checked and turned for print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .views import updated


def consolidated(runs: dict[str, DataFrame], keys: list[str], metrics: list[str], seeds: str, expected_seeds: list[int], expected: DataFrame | None = None) -> DataFrame:
    """keys, n_seeds, and mean and deviation of the metrics over all runs.

    An error unless every configuration has exactly the expected seeds once, and unless the configurations are the
    expected ones.
    """
    rows = stats.union_runs(runs)
    per = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(seeds).cast("int"))).alias("s_"))
    if bad := per.filter(F.col("s_") != F.array(*map(F.lit, sorted(expected_seeds)))).take(3):
        raise ValueError(f"other seeds than {expected_seeds}: {[tuple(r) for r in bad]}")
    if expected is not None and not (d := per.select(*keys).exceptAll(expected.select(*keys)).unionByName(expected.select(*keys).exceptAll(per.select(*keys)))).isEmpty():
        raise ValueError(f"configurations on one side only: {[tuple(r) for r in d.take(3)]}")
    return stats.rollup(rows, keys, metrics, seeds)


def labelled(df: DataFrame, names: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """df with the printable names of its keys; an error for a key without one, unless not strict."""
    out = df.join(names, key, "left")
    name = next(c for c in names.columns if c != key)
    if strict and (lost := out.filter(F.col(name).isNull()).select(key).distinct().take(3)):
        raise ValueError(f"no name for {[r[0] for r in lost]}")
    return out


def broad_table(parts: dict[str, DataFrame], names: DataFrame, key: str, measured: DataFrame | None = None, columns: list[str] = ()) -> DataFrame:
    """evidence_scope, the columns of all parts (null where a part lacks one), the printable name of each key, and
    noise_multiplier, sigma over the clipping norm.

    measured: results by printable name, of one gallery; they fill the columns given, wherever they have a value. An
    error for a key without a name.
    """
    rows = labelled(stats.union_runs(parts, "evidence_scope"), names, key)
    if {"dp_noise_sigma", "dp_clip_norm"} <= set(rows.columns):
        rows = rows.withColumn("noise_multiplier", F.try_divide("dp_noise_sigma", "dp_clip_norm"))
    if measured is None:
        return rows
    name = next(c for c in names.columns if c != key)
    rows = rows.select("*", *(F.lit(None).cast(measured.schema[c].dataType).alias(c) for c in columns if c not in rows.columns))
    return updated(rows, measured, [name], list(columns))


def multiseed_table(runs: DataFrame, keys: list[str], metrics: list[str], seeds: str, names: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Printable name, keys, n_seeds, and mean, deviation and 95 % interval of each metric, of configurations with at least
    `least` seeds."""
    rows = stats.rollup(runs, keys, metrics, seeds).filter(F.col("n_seeds") >= least)
    for m in metrics:
        one = stats.t_interval(runs, keys, m).select(*keys, F.col("low").alias(f"{m}_low"), F.col("high").alias(f"{m}_high"))
        rows = rows.join(one, keys)
    return labelled(rows, names, key)


def attribute_table(summary: DataFrame, conditions: list[str], metric: str) -> DataFrame:
    """task, representation, and mean and deviation of the metric under each condition."""
    return stats.conditional_wide(summary, ["task", "representation"], "condition", conditions, metric)


def selection_evidence(screens: dict[str, DataFrame], config: str, metrics: list[str], retained: dict[str, list[str]]) -> DataFrame:
    """screen, configuration, role (retained or comparison), n_seeds and the metrics' means."""
    out = None
    for name, df in screens.items():
        t = df.groupBy(F.col(config).alias("configuration")).agg(F.count("*").alias("n_seeds"), *(F.avg(m).alias(m) for m in metrics if m in df.columns))
        t = t.select(F.lit(name).alias("screen"), "*", F.when(F.col("configuration").isin(retained.get(name, [])), "retained").otherwise("comparison").alias("role"))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def protocol_rows(settings: DataFrame, scope: str, columns: list[str]) -> DataFrame:
    """scope, parameter, value: a table of settings, one row a scope, as rows; nulls are left out."""
    rows = settings.select(F.col(scope).cast("string").alias("scope"), *(F.col(c).cast("string").alias(c) for c in columns))
    return rows.unpivot(["scope"], columns, "parameter", "value").filter("value is not null")


def in_given_order(column: str, order: list[str], *then: str) -> list[Column]:
    """Sort keys: the place of the column's value in order (unknown values last), then other columns."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return [F.when(place > 0, place).asc_nulls_last(), *(F.col(c).asc() for c in then)]


def ordered(df: DataFrame, column: str, order: list[str], *then: str) -> DataFrame:
    """Rows by the place of the column's value in order (unknown values last), then by other columns."""
    return df.orderBy(*in_given_order(column, order, *then))
