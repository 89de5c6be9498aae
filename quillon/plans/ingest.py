"""From recordings to segment features: filter, scale, window, describe each lead, and put the leads side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import code_match
from ..operators import sampling, windows
from ..operators import signal as sig

#: The thirteen features of a lead in a segment.
FEATURES = ["mean", "std", "min", "max", "amplitude", "energy", "skewness", "kurtosis", "area", "abs_mean", "rms", "zero_crossing_rate", "n_peaks"]


def samples(signals: DataFrame, fs: float, low: float = 0.5, high: float = 40.0, order: int = 4) -> DataFrame:
    """record_id, lead, signal -> record (both), idx, value: filtered without phase shift, scaled by the whole recording."""
    clean = sig.bandpass(signals.select("record_id", "lead", F.col("signal").cast("array<double>").alias("signal")), low, high, fs, order)
    long = clean.select(F.struct("record_id", "lead").alias("record"), F.posexplode("signal").alias("idx", "value"))
    return windows.zscore(long).select("record", "idx", F.col("z").alias("value"))


def lead_features(signals: DataFrame, fs: float, window: float = 2.0, step: float = 1.0, **how) -> DataFrame:
    """record_id, lead, segment and FEATURES of every complete window; a recording shorter than one has none."""
    parts = windows.sliding(samples(signals, fs, **how), windows.window_size(window, fs), windows.window_size(step, fs))
    return described(parts, ["record", "segment"], fs).select("record.record_id", "record.lead", "segment", *FEATURES)


def described(parts: DataFrame, by: list[str], fs: float) -> DataFrame:
    """by and FEATURES of each group of samples."""
    found = sig.peaks(sig.as_arrays(parts, by), fs).select(*by, F.size("peaks").cast("double").alias("n_peaks"))
    return windows.segment_features(parts, by).join(found, by)


def _labelled(heads: DataFrame, positive: list[str], labels: tuple[str, str]) -> DataFrame:
    return heads.filter("error is null").select("record_id", F.col("diagnosis").alias("label"), code_match(F.col("diagnosis"), positive, *labels).alias("utility_label"))


def segment_table(signals: DataFrame, heads: DataFrame, fs: float, leads: list[str], positive: list[str], window: float = 2.0, step: float = 1.0, labels: tuple[str, str] = ("Atrial", "Non-Atrial"), **how) -> DataFrame:
    """One row per segment: ids, label, sample range, 13 columns a lead and 52 over the leads."""
    by = ["record_id", "segment"]
    rows = lead_features(signals, fs, window, step, **how)
    wide = windows.wide(rows, by, "lead", leads, FEATURES).join(windows.across(rows, by, FEATURES), by)
    known = _labelled(heads, positive, labels)
    size, hop = windows.window_size(window, fs), windows.window_size(step, fs)
    out = wide.join(known, "record_id").withColumn("start_sample", F.col("segment") * hop).withColumn("end_sample", F.col("segment") * hop + size)
    features = [c for c in wide.columns if c not in by]
    return out.select(F.col("record_id").alias("patient_id"), F.format_string("%s_%04d", "record_id", "segment").alias("segment_id"), "label", "utility_label", F.col("segment").alias("segment_ref"), "start_sample", "end_sample", *features)


def record_table(signals: DataFrame, heads: DataFrame, fs: float, leads: list[str], positive: list[str], rr_lead: str = "II", labels: tuple[str, str] = ("Atrial", "Non-Atrial"), **how) -> DataFrame:
    """One row per recording: ids, label, 13 columns a lead, 52 over the leads, and the intervals between beats.

    Beats are those of rr_lead, or of the first lead where the recordings have no such lead.
    """
    whole = samples(signals, fs, **how)
    rows = described(whole, ["record"], fs).select("record.record_id", "record.lead", *FEATURES)
    wide = windows.wide(rows, ["record_id"], "lead", leads, FEATURES).join(windows.across(rows, ["record_id"], FEATURES), "record_id")
    beat = sig.as_arrays(whole.filter(F.col("record.lead") == (rr_lead if rr_lead in leads else leads[0])))
    rr = sig.rr_features(sig.peaks(beat, fs, 0.25, 0.6), fs)
    rr = rr.select("record.record_id", F.col("n_peaks").alias("n_r_peaks"), F.col("rr_mean").alias("mean_rr"), F.col("rr_std").alias("std_rr"), F.col("rr_rmssd").alias("rmssd"), F.col("heart_rate").alias("mean_hr_bpm"))
    out = wide.join(_labelled(heads, positive, labels), "record_id").join(rr, "record_id", "left")
    return out.select(F.col("record_id").alias("patient_id"), "*")


def targets(signals: DataFrame, fs: int, target_fs: int, leads: list[str], segment: int = 0, window: float = 2.0, step: float = 1.0, **how) -> DataFrame:
    """record_id, target, error: one segment of each recording at target_fs, all of a lead before the next lead.

    A recording without the segment, or without one of the leads, has an error and no target.
    """
    size, hop = windows.window_size(window, fs), windows.window_size(step, fs)
    part = samples(signals, fs, **how).filter(F.col("idx").between(segment * hop, segment * hop + size - 1))
    rows = sig.resampled(sig.as_arrays(part).filter(F.size("signal") == size), fs, target_fs)
    rows = rows.groupBy("record.record_id").agg(F.map_from_entries(F.collect_list(F.struct("record.lead", "signal"))).alias("m_"))
    out = signals.select("record_id").distinct().join(rows, "record_id", "left")
    every = F.array(*(F.col("m_")[lead] for lead in leads))
    missing = F.when(F.col("m_").isNull(), F.lit(f"segment {segment} is unavailable")).when(F.exists(every, lambda x: x.isNull()), F.lit("a lead is missing"))
    return out.select("record_id", F.when(missing.isNull(), F.flatten(every).cast("array<float>")).alias("target"), missing.alias("error"))


def cohort(features: DataFrame, signals: DataFrame, n: int, fs: int, target_fs: int, leads: list[str], segment: int = 0, seed: int = 0, **how) -> tuple[DataFrame, DataFrame]:
    """(patient_id, target) of n recordings, by hash, that have features of the segment (all of them if n is 0), and
    (patient_id, error) of those whose target can't be had. `sources.files.cached` stores the first by its parameters.
    """
    ids = features.filter(F.col("segment_ref") == segment).select("patient_id").distinct()
    ids = sampling.sample(ids, "patient_id", n, seed).select("patient_id") if n else ids
    own = signals.join(ids, signals["record_id"] == ids["patient_id"], "left_semi")
    rows = ids.join(targets(own, fs, target_fs, leads, segment, **how).withColumnRenamed("record_id", "patient_id").withColumn("found_", F.lit(True)), "patient_id", "left")
    rows = rows.withColumn("error", F.when(F.col("found_").isNull(), "recording not found").otherwise(F.col("error")))
    return rows.filter("error is null").select("patient_id", "target"), rows.filter("error is not null").select("patient_id", "error")
