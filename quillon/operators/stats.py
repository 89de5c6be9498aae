"""Summaries over seeds and paired comparisons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import joined, quantiles, quantiles_by_key

# Quantiles 0.975 of Student's t by degrees of freedom.
T_975 = {1: 12.706204736432095, 2: 4.302652729911275, 3: 3.182446305284263, 4: 2.7764451051977987, 5: 2.5705818366147395, 6: 2.4469118487916806, 7: 2.3646242510102993, 8: 2.3060041350333704, 9: 2.2621571627409915}


def rollup(df: DataFrame, keys: list[str], metrics: list[str], seeds: str | None = None) -> DataFrame:
    """keys, n_seeds, and the mean and sample deviation of each metric; null keys are groups too."""
    count = F.count_distinct(seeds) if seeds else F.count("*")
    return df.groupBy(*keys).agg(count.alias("n_seeds"), *(f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))))


def t_quantile(freedom: Column, z: float = 1.959963984540054) -> Column:
    """The quantile 0.975 of Student's t for ten and more degrees of freedom, by the expansion around the normal one
    (to 1/freedom^4; within 1e-5)."""
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return F.when(freedom >= 10, sum((F.lit(c) / F.pow(freedom, F.lit(k)) for k, c in enumerate(terms, 1)), F.lit(z)))


def t_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, low, high: the 95 % interval of Student's t; null limits for n = 1."""
    s = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s_"))
    t = F.create_map(*(F.lit(x) for k, v in T_975.items() for x in (k + 1, v)))
    half = F.coalesce(F.try_element_at(t, F.col("n").cast("int")), t_quantile(F.col("n") - 1)) * F.col("s_") / F.sqrt("n")
    return s.select(*keys, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def same_targets(a: DataFrame, b: DataFrame, keys: list[str], target: str, within: float = 0.0) -> DataFrame:
    """The paired rows of both predictions (b's columns as <name>_b); an error unless both have the same keys, once each,
    and the same targets."""
    for d, name in ((a, "first"), (b, "second")):
        if twice := d.groupBy(*keys).count().filter("count > 1").take(3):
            raise ValueError(f"{name}: keys more than once, such as {[tuple(r) for r in twice]}")
    if lost := a.join(b.select(*keys), keys, "left_anti").select(*keys).unionByName(b.join(a.select(*keys), keys, "left_anti").select(*keys)).take(3):
        raise ValueError(f"on one side only: {[tuple(r) for r in lost]}")
    both = a.join(b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys)), keys)
    unlike = ~(F.abs(F.col(target).cast("double") - F.col(f"{target}_b").cast("double")) <= within)
    if bad := both.filter(F.coalesce(unlike, F.lit(True))).select(*keys).take(3):
        raise ValueError(f"other targets for {[tuple(r) for r in bad]}")
    return both


def paired_contrast(df: DataFrame, config: str, candidate: str, reference: str, pair: str, metrics: list[str]) -> DataFrame:
    """metric, n, mean, low, high of candidate minus reference, paired by seed; an error where seeds don't match."""
    a, b = df.filter(F.col(config) == candidate), df.filter(F.col(config) == reference)
    if not a.select(pair).exceptAll(b.select(pair)).unionByName(b.select(pair).exceptAll(a.select(pair))).isEmpty():
        raise ValueError("candidate and reference have other seeds")
    long = lambda d, v: d.select(pair, F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))))).alias("metric", v))
    both = long(a, "x").join(long(b, "y"), [pair, "metric"]).withColumn("d", F.col("x") - F.col("y"))
    return t_interval(both, ["metric"], "d")


def metric_effect(task: str, y: str, baseline: str, comparison: str):
    """The gain of an attack: in balanced accuracy for classes, in reduced mean absolute error for numbers."""
    if task == "regression":
        return F.avg(F.abs(F.col(y) - F.col(baseline))) - F.avg(F.abs(F.col(y) - F.col(comparison)))
    share = lambda c, k: F.avg(F.when(F.col(y) == k, (F.col(c) == k).cast("double")))
    return (share(comparison, 1) + share(comparison, 0)) / 2 - (share(baseline, 1) + share(baseline, 0)) / 2


def bootstrap_sums(df: DataFrame, group: str, key: str, values: list[Column], replicates: int = 200, seed: int = 0, cell: int = 1 << 15) -> DataFrame:
    """group, rep (from 1), draws and s, an array of the sums of the values over n rows drawn with replacement of the
    group's n, for each replicate. Null values count as 0.

    Rows lie in cells of about `cell`, by hash of key. The draws are halved down to a cell: at each step one binomial a
    replicate says what the left half gets, from a generator seeded by the place, so that all cells see the same
    splits. In a cell they fall on rows by one multinomial a replicate. A task sends sums, so that what is shuffled is
    each row once, and a row a cell and replicate. The sums are a function of keys, seed and cell size.
    """
    rows = df.select(F.col(group).alias("g_"), F.col(key).cast("string").alias("k_"), F.array(*(F.coalesce(v.cast("double"), F.lit(0.0)) for v in values)).alias("v_"))
    sizes = rows.groupBy("g_").agg(F.count("*").alias("n_"))
    kind = df.schema[group].dataType
    right = sizes.select(F.col("g_").alias("of_"), "n_", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_") / cell))).cast("int").alias("b_"), F.xxhash64("g_").alias("h_"))
    placed = rows.join(right, rows["g_"].eqNullSafe(right["of_"])).withColumn("c_", F.expr("pmod(xxhash64(k_), shiftleft(1L, b_))"))
    counts = placed.groupBy("g_", "c_").agg(F.count("*").alias("m_"), *(F.max(c).alias(c) for c in ("h_", "n_", "b_")))
    # Rows in each half of each level: level 0 is the group, level b_ its cells.
    halves = counts.select("h_", "c_", "b_", "m_", F.explode(F.expr("sequence(0, b_)")).alias("level"))
    nodes = halves.groupBy("h_", "level", F.expr("shiftright(c_, b_ - level)").alias("node")).agg(F.sum("m_").alias("size"))
    steps = halves.filter("level < b_").withColumn("node", F.expr("shiftright(c_, b_ - level)")).join(nodes, ["h_", "level", "node"])
    left = nodes.select("h_", (F.col("level") - 1).alias("level"), F.expr("shiftright(node, 1)").alias("node"), F.col("size").alias("left"), (F.col("node") % 2).alias("odd")).filter("odd = 0").drop("odd")
    steps = steps.join(left, ["h_", "level", "node"], "left").groupBy("h_", "c_").agg(F.array_sort(F.collect_list(F.struct("level", "node", "size", F.coalesce("left", F.lit(0)).alias("left")))).alias("path_"))
    jobs = counts.join(steps, ["h_", "c_"], "left").select(F.col("g_").alias("of_"), F.col("c_").alias("in_"), "h_", "n_", "b_", "path_")
    width = len(values)

    def run(job: pa.Table, own: pa.Table) -> pa.Table:
        j = job.to_pylist()[0]
        base, n = [seed, j["h_"] & 0xFFFFFFFF, (j["h_"] >> 32) & 0xFFFFFFFF], np.full(replicates, j["n_"], np.int64)
        for x in j["path_"] or []:
            left = np.random.default_rng([*base, x["level"], x["node"]]).binomial(n, x["left"] / x["size"])
            n = n - left if (j["in_"] >> (j["b_"] - x["level"] - 1)) & 1 else left
        own = own.sort_by("k_")
        v = own["v_"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        rng, even = np.random.default_rng([*base, 64, j["in_"]]), np.full(len(v), 1 / len(v))
        sums = np.stack([rng.multinomial(m, even) @ v for m in n])
        offs = pa.array(np.arange(replicates + 1) * width, pa.int32())
        return pa.table({"g": pa.array([j["of_"]] * replicates, own.schema.field("g_").type), "rep": pa.array(np.arange(1, replicates + 1), pa.int32()), "draws": pa.array(n), "s": pa.ListArray.from_arrays(offs, pa.array(sums.ravel()))})

    schema = T.StructType([T.StructField("g", kind), T.StructField("rep", T.IntegerType()), T.StructField("draws", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType()))])
    parts = jobs.groupBy("of_", "in_").cogroup(placed.select("g_", "c_", "k_", "v_").groupBy("g_", "c_")).applyInArrow(run, schema)
    sums = parts.groupBy("g", "rep").agg(F.sum("draws").alias("draws"), *(F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(width)))
    return sums.select(F.col("g").alias(group), "rep", "draws", F.array(*(f"s{k}" for k in range(width))).alias("s"))


def bootstrap_effect(df: DataFrame, seed_col: str, key: str, task: str, y: str, baseline: str, comparison: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """effect and its 2.5 and 97.5 % quantiles over replicates that draw the n rows of each seed n times, paired.

    A replicate without one of the classes has no effect for that seed and is left out of the mean over seeds.
    """
    one = F.lit(1.0)
    if task == "regression":
        values = [one, F.abs(F.col(y) - F.col(baseline)) - F.abs(F.col(y) - F.col(comparison))]
    else:
        values = [F.when(x, one) for k in (1, 0) for x in (F.col(y) == k, (F.col(y) == k) & (F.col(comparison) == k), (F.col(y) == k) & (F.col(baseline) == k))]
    s = lambda k: F.get("s", F.lit(k))
    ratio = lambda a, b: F.try_divide(s(a), s(b))
    effect = ratio(1, 0) if task == "regression" else (ratio(1, 0) + ratio(4, 3)) / 2 - (ratio(2, 0) + ratio(5, 3)) / 2
    reps = bootstrap_sums(df, seed_col, key, values, replicates, seed).select("rep", effect.alias("e")).groupBy("rep").agg(F.avg("e").alias("e"))
    whole = df.groupBy(seed_col).agg(metric_effect(task, y, baseline, comparison).alias("e")).agg(F.avg("e").alias("effect"))
    q = reps.agg(F.percentile("e", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))  # a number a replicate
    return whole.crossJoin(q).select("effect", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))  # one row each


def excess(df: DataFrame, config: str, baseline: str, metrics: list[str]) -> DataFrame:
    """Each configuration's metrics minus those of the baseline's one row."""
    base = df.filter(F.col(config) == baseline).select(*(F.col(m).alias(f"_{m}") for m in metrics)).limit(1)
    return df.crossJoin(F.broadcast(base)).select(config, *((F.col(m) - F.col(f"_{m}")).alias(f"{m}_excess") for m in metrics))  # one row


def pivoted(df: DataFrame, key: str, column: str, values: list, metric: str) -> DataFrame:
    return df.groupBy(key).pivot(column, values).agg(F.avg(metric))


def conditional_wide(df: DataFrame, keys: list[str], column: str, values: list, metric: str) -> DataFrame:
    """keys, and the mean and sample deviation of the metric for each value of the column."""
    return df.groupBy(*keys).agg(*(f for v in values for f in (F.avg(F.when(F.col(column) == v, F.col(metric))).alias(f"{v}_mean"), F.stddev_samp(F.when(F.col(column) == v, F.col(metric))).alias(f"{v}_std"))))


def unpivoted_quartiles(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """keys, name, n, mean, q25, median, q75 of each column; exact quantiles.

    They are found in several scans: no aggregate holds the values of a column or of a key (`operators/quantiles`).
    """
    if not keys:
        q = quantiles(df, [F.col(c) for c in columns], [0.25, 0.5, 0.75])
        m = df.agg(*(F.count(c).alias(f"n{k}") for k, c in enumerate(columns)), *(F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)))
        rows = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"n{k}").alias("n"), F.col(f"m{k}").alias("mean"), *(F.lit(v).cast("double").alias(a) for a, v in zip(("q25", "median", "q75"), q[k]))) for k, c in enumerate(columns)))
        return m.select(F.explode(rows).alias("r")).select("r.*")
    long = df.unpivot(list(keys), columns, "name", "x")
    q = quantiles_by_key(long, [*keys, "name"], "x", [0.25, 0.5, 0.75])
    means = long.groupBy(*keys, "name").agg(F.avg("x").alias("mean"))
    return joined(means, q, [*keys, "name"]).select(*keys, "name", "n", "mean", *(F.get("q", F.lit(k)).alias(a) for k, a in enumerate(("q25", "median", "q75"))))


def drift(df: DataFrame, expected: DataFrame, key: list[str], value: str, within: float = 5e-5) -> DataFrame:
    """Rows whose value is not within the tolerance of what is expected, or that only one side has."""
    e = expected.select(*key, F.col(value).alias("expected"))
    return df.select(*key, value).join(e, key, "full").filter(F.coalesce(F.abs(F.col(value) - F.col("expected")) >= within, F.lit(True)))


def union_runs(runs: dict[str, DataFrame], name: str = "run_name") -> DataFrame:
    """All runs, each row with the name of its run; columns that a run lacks are null."""
    out = None
    for k, d in runs.items():
        d = d.withColumn(name, F.lit(k))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def assert_counts(df: DataFrame, keys: list[str], n: int) -> None:
    """An error unless every key has n rows."""
    if bad := df.groupBy(*keys).count().filter(F.col("count") != n).take(3):
        raise ValueError(f"not {n} rows: {[tuple(r) for r in bad]}")
