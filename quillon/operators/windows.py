"""Windows over ordered samples and features of them; a signal is long rows (record, idx, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def indexed(df: DataFrame, record: str, order: list[str], value: str) -> DataFrame:
    """record, idx (0, 1, ... in order), value."""
    w = Window.partitionBy(record).orderBy(*order)
    return df.select(F.col(record).alias("record"), (F.row_number().over(w) - 1).alias("idx"), F.col(value).alias("value"))


def window_size(seconds: float, fs: float) -> int:
    """Whole samples of a duration, truncated."""
    return int(seconds * fs)


def sliding(samples: DataFrame, size: int, step: int) -> DataFrame:
    """record, segment, start, idx (in the segment), value: complete windows only; a record shorter than one has none."""
    n = samples.groupBy("record").agg((F.max("idx") + 1).alias("n"))
    first, last = F.greatest(F.ceil((F.col("idx") - size + 1) / step), F.lit(0)), F.floor(F.least(F.col("idx"), F.col("n") - size) / step)
    rows = samples.join(n, "record").filter((F.col("n") >= size) & (first <= last))
    rows = rows.select("record", "idx", "value", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("segment"))
    return rows.select("record", "segment", (F.col("segment") * step).alias("start"), (F.col("idx") - F.col("segment") * step).alias("idx"), "value")


def segment_ranges(records: DataFrame, n: str, size: int, step: int) -> DataFrame:
    """record, segment, start_sample, end_sample of each complete window of a record of n samples."""
    rows = records.filter(F.col(n) >= size).select("record", F.posexplode(F.sequence(F.lit(0), (F.col(n) - size).cast("int"), F.lit(step))).alias("segment", "start_sample"))
    return rows.withColumn("end_sample", F.col("start_sample") + size)


def array_windows(signal: Column, size: int, step: int) -> Column:
    """The complete windows of an array, as an array of arrays."""
    at = F.when(F.size(signal) >= size, F.sequence(F.lit(0), F.size(signal) - size, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda s: F.slice(signal, s + 1, F.lit(size)))


def zscore(samples: DataFrame, by: list[str] = ("record",)) -> DataFrame:
    """samples with z, by the mean and population deviation of the whole record; a deviation of 0 counts as 1."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop("value").over(w)
    return samples.withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.when(sd == 0, 1.0).otherwise(sd))


def lag_features(samples: DataFrame, by: list[str], order: str = "idx") -> DataFrame:
    """n_intervals, mean, sd (population), rmssd and change in successive differences: null with fewer than two samples."""
    w = Window.partitionBy(*by).orderBy(order)
    d = samples.withColumn("d", F.col("value") - F.lag("value").over(w))
    d = d.withColumn("dd", F.col("d") - F.lag("d").over(w))
    return d.groupBy(*by).agg(F.count("d").alias("n_intervals"), F.avg("d").alias("mean_interval"), F.stddev_pop("d").alias("sd_interval"), F.sqrt(F.avg(F.col("dd") * F.col("dd"))).alias("rmssd"), (60.0 / F.nullif(F.avg("d"), F.lit(0.0))).alias("rate"))


def zero_crossings(samples: DataFrame, by: list[str], order: str = "idx") -> DataFrame:
    """Mean number of changes of the sign bit between neighbours; -0.0 has it, 0.0 has not. 0 for a single sample."""
    w = Window.partitionBy(*by).orderBy(order)
    # Only the text of a zero tells its sign.
    signed = samples.withColumn("s_", (F.col("value") < 0) | ((F.col("value") == 0) & F.startswith(F.col("value").cast("string"), F.lit("-"))))
    rows = signed.withColumn("c", (F.col("s_") != F.lag("s_").over(w)).cast("double"))
    return rows.groupBy(*by).agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("zero_crossing_rate"))


def statistics(x: str = "value") -> list[Column]:
    """mean, sd (population), min, max, amplitude, energy, and the bias-corrected skewness and excess kurtosis.

    Both of the last are 0 for a constant, and null for too few samples.
    """
    n, g1, g2 = F.count(x), F.skewness(x), F.kurtosis(x)
    flat = F.stddev_pop(x) == 0
    skew = F.when(flat, 0.0).when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2))
    kurt = F.when(flat, 0.0).when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2.0) * (n - 3)))
    return [F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("amplitude"), F.sum(F.col(x) * F.col(x)).alias("energy"), skew.alias("skewness"), kurt.alias("kurtosis")]


def shape(x: str = "value", order: str = "idx") -> list[Column]:
    """area (trapezoids of unit spacing), mean of absolute values and root mean square."""
    ends = (F.min_by(x, order) + F.max_by(x, order)) / 2
    return [(F.sum(x) - ends).alias("area"), F.avg(F.abs(x)).alias("abs_mean"), F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms")]


def segment_features(segments: DataFrame, by: list[str]) -> DataFrame:
    """The statistics, shape and zero-crossing rate of each segment."""
    return segments.groupBy(*by).agg(*statistics(), *shape()).join(zero_crossings(segments, by), by)


def across(features: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Mean, population deviation, min and max of each feature over the channels of a segment."""
    forms = (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
    return features.groupBy(*by).agg(*(f(c).alias(f"global_{how}_{c}") for c in names for how, f in forms))


def wide(features: DataFrame, by: list[str], channel: str, channels: list, names: list[str]) -> DataFrame:
    """One row per segment, columns lead_<channel>_<name>; the channels are given, so that no job finds them."""
    out = features.groupBy(*by).pivot(channel, channels).agg(*(F.first(c, ignorenulls=True).alias(c) for c in names))
    return out.select(*by, *(F.col(f"`{ch}_{c}`" if len(names) > 1 else f"`{ch}`").alias(f"lead_{ch}_{c}") for ch in channels for c in names))


def summary(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """label, rows and missing values in the columns."""
    return df.groupBy(label).agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in columns))


def correlation(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pearson correlation in each group; 0 where a side is (nearly) constant."""
    flat = (F.var_pop(a) * F.count("*") <= 1e-24) | (F.var_pop(b) * F.count("*") <= 1e-24)
    return df.groupBy(*by).agg(F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))).alias("correlation"))


def max_lag_correlation(a: DataFrame, b: DataFrame, by: list[str], most: int) -> DataFrame:
    """The greatest correlation of value in a and b over shifts of -most to most samples; at least -1."""
    lags = a.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("at", F.col("idx") + F.col("lag"))
    pairs = lags.select(*by, "lag", F.col("at").alias("idx"), F.col("value").alias("x")).join(b.select(*by, "idx", F.col("value").alias("y")), [*by, "idx"])
    return correlation(pairs, [*by, "lag"], "x", "y").groupBy(*by).agg(F.greatest(F.max("correlation"), F.lit(-1.0)).alias("max_lag_correlation"))


def quality(samples: DataFrame, fs: float, expected_fs: float = 500.0, seconds: float = 10.0, leads: list[str] | None = None) -> DataFrame:
    """record and checks: rate and duration as expected, and no NaN, infinity or null among the values.

    Samples with a column `lead` are judged by lead and record, and leads_ok says whether a record has all `leads`.
    """
    if leads is not None:
        own = quality(samples.withColumn("record", F.struct("record", "lead")), fs, expected_fs, seconds).select(F.col("record.record").alias("record"), F.col("record.lead").alias("lead"), "samples", "rate_ok", "duration_ok", "finite")
        whole = own.groupBy("record").agg(F.max("samples").alias("samples"), F.bool_and("rate_ok").alias("rate_ok"), F.bool_and("duration_ok").alias("duration_ok"), F.bool_and("finite").alias("finite"), F.array_sort(F.collect_set("lead")).alias("l_"))
        return whole.withColumn("leads_ok", F.col("l_") == F.array_sort(F.array(*map(F.lit, leads)))).drop("l_")
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return samples.groupBy("record").agg(F.count("*").alias("samples"), F.lit(abs(fs - expected_fs) < 1e-6).alias("rate_ok"), (F.abs(F.count("*") / fs - seconds) < 1e-6).alias("duration_ok"), (F.count_if(bad) == 0).alias("finite"))
