"""Recordings on disk: text headers and binary matrices, read in parallel from any store that Spark reads."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import FEMALE, MALE

HEADER = "record_id string, path string, fs double, n_samples int, n_leads int, lead_names array<string>, adc_gains array<double>, baselines array<double>, files array<string>, formats array<string>, segments array<string>, age double, sex string, diagnosis string"


def parse_header(text: str) -> dict:
    """The fields of a header. A gain is `gain(baseline)/unit`; 0 counts as 1, and the fifth field stands in for a baseline.

    files and formats (`212`, or `16+24` with an offset in bytes) say where a lead's samples are. A recording of several
    segments has these, as `name samples` in their order, and no leads of its own.
    """
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    top = lines[0].split()
    n_leads = int(top[1])
    out = {"fs": float(top[2].split("/")[0]), "n_samples": int(top[3]), "n_leads": n_leads, "lead_names": [], "adc_gains": [], "baselines": [], "files": [], "formats": [], "segments": [], "age": None, "sex": None, "diagnosis": None}
    if "/" in top[0]:
        n_leads = int(top[0].split("/")[1])
        out["segments"] = [" ".join(line.split()[:2]) for line in lines[1 : n_leads + 1]]
    for line in lines[1 : n_leads + 1] if not out["segments"] else ():
        part = line.split()
        out["files"].append(part[0])
        out["formats"].append(part[1])
        gain = part[2].split("/")[0]
        amount, _, base = gain.partition("(")
        out["adc_gains"].append(float(amount) or 1.0)
        out["baselines"].append(float(base.rstrip(")")) if base else float(part[4]) if len(part) > 4 else 0.0)
        out["lead_names"].append(part[-1])
    for line in lines[n_leads + 1 :]:
        name, _, value = line.lstrip("# ").partition(":")
        value = value.strip()
        if name == "Dx":
            out["diagnosis"] = value
        elif name == "Age":
            try:
                out["age"] = float(value) if 0 <= float(value) <= 120 else None
            except ValueError:
                out["age"] = None
        elif name == "Sex":
            out["sex"] = "Male" if value.lower() in MALE else "Female" if value.lower() in FEMALE else None
    return out


def headers(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row per .hea file under path, in the order of ids if limited; a bad file has nulls and an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.hea").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.hea$", 1).alias("record_id"), "path", F.col("content").cast("string").alias("text"))
    if limit is not None:
        files = files.orderBy("record_id").limit(limit)
    names = [x.split()[0] for x in HEADER.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                try:
                    rows.append({"record_id": r.record_id, "path": r.path, **parse_header(r.text), "error": None})
                except Exception as e:  # reported as data
                    rows.append({**dict.fromkeys(names), "record_id": r.record_id, "path": r.path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[*names, "error"], dtype=object)

    return files.mapInPandas(run, f"{HEADER}, error string")


def read_mat4(data: bytes, name: str = "val") -> np.ndarray:
    """A real matrix of a level 4 file, by its name."""
    kinds = {0: "f8", 1: "f4", 2: "i4", 3: "i2", 4: "u2", 5: "u1"}
    at = 0
    while at < len(data):
        kind, rows, cols, imaginary, size = struct.unpack_from("<5i", data, at)
        at += 20
        found = data[at : at + size].rstrip(b"\0").decode()
        at += size
        dtype = np.dtype("<" + kinds[kind // 10 % 10])
        count = rows * cols * (2 if imaginary else 1)
        if found == name:
            return np.frombuffer(data, dtype, rows * cols, at).reshape(cols, rows).T
        at += count * dtype.itemsize
    raise ValueError(f"no matrix {name!r}")


def write_mat4(x: np.ndarray, name: str = "val") -> bytes:
    """A 16-bit matrix as a level 4 file."""
    x = np.asarray(x, "<i2")
    return struct.pack("<5i", 30, *x.shape, 0, len(name) + 1) + name.encode() + b"\0" + x.T.tobytes()


def signals(spark: SparkSession, path: str, heads: DataFrame, physical: bool = True) -> DataFrame:
    """record_id, lead, signal (floats, in physical units): a row per lead of every recording with a header."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mat").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.mat$", 1).alias("record_id"), "content")
    rows = files.join(heads.filter("error is null").select("record_id", "lead_names", "adc_gains", "baselines"), "record_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                x = read_mat4(bytes(r.content)).astype(np.float32)
                if physical:
                    x = (x - np.asarray(r.baselines, np.float32)[:, None]) / np.asarray(r.adc_gains, np.float32)[:, None]
                yield pd.DataFrame({"record_id": r.record_id, "lead": list(r.lead_names), "signal": list(x)})

    return rows.mapInPandas(run, "record_id string, lead string, signal array<float>")


def decoded(data: bytes, kind: int, n: int, offset: int = 0) -> np.ndarray:
    """n samples of a packed file: kind 16 and 61 are two bytes, little or big end first, 80 is a byte with an offset of 128,
    212 is two samples in three bytes. The least value of a kind stands for a missing sample: NaN."""
    if kind in (16, 61):
        x, lost = np.frombuffer(data, "<i2" if kind == 16 else ">i2", n, offset).astype(np.int32), -(1 << 15)
    elif kind == 80:
        x, lost = np.frombuffer(data, np.uint8, n, offset).astype(np.int32) - 128, -128
    elif kind == 212:
        size = n // 2 * 3 + 2 * (n % 2)
        b = np.concatenate([np.frombuffer(data, np.uint8, size, offset), np.zeros(-size % 3, np.uint8)]).reshape(-1, 3).astype(np.int32)
        both = np.stack([b[:, 0] | (b[:, 1] & 0x0F) << 8, b[:, 2] | (b[:, 1] & 0xF0) << 4], axis=1).ravel()[:n]
        x, lost = np.where(both >= 2048, both - 4096, both), -2048
    else:
        raise ValueError(f"format {kind} is not known")
    return np.where(x == lost, np.nan, x)


def packed_signals(spark: SparkSession, path: str, heads: DataFrame, physical: bool = True) -> DataFrame:
    """record_id, lead, signal (floats, in physical units): a row per lead of every recording whose samples are in packed
    files (`decoded`), each with the leads of its recording that share it, a sample of each in turn.

    A recording of several segments has them joined, lead by lead; where a segment lacks a lead, or is a gap (`~`), its
    samples are NaN. Files are found beside their header; one that is missing is an error.
    """
    folder = lambda c: F.regexp_replace(c, r"[^/]+$", "")
    good = heads.filter("error is null").withColumn("folder", folder(F.col("path")))
    leads = good.filter(F.size("files") > 0).select("folder", "record_id", "n_samples", F.posexplode(F.arrays_zip("files", "formats", "lead_names", "adc_gains", "baselines")).alias("at", "x"))
    leads = leads.filter(~F.col("x.files").endswith(".mat")).groupBy("folder", "record_id", "n_samples", F.col("x.files").alias("file")).agg(F.array_sort(F.collect_list(F.struct("at", "x.formats", "x.lead_names", "x.adc_gains", "x.baselines"))).alias("leads"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dat").load(path)
    rows = leads.join(files.select(folder(F.col("path")).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content"), ["folder", "file"], "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                if r.content is None:
                    raise FileNotFoundError(f"{r.folder}{r.file}")
                kinds = {x["formats"] for x in r.leads}
                if len(kinds) > 1 or not kinds <= {k for k in kinds if k.replace("+", "").isdigit()}:
                    raise ValueError(f"{r.record_id}: formats {sorted(kinds)} in one file")
                kind, _, offset = kinds.pop().partition("+")
                x = decoded(bytes(r.content), int(kind), r.n_samples * len(r.leads), int(offset or 0)).reshape(-1, len(r.leads)).T
                if physical:
                    x = (x - np.array([v["baselines"] for v in r.leads])[:, None]) / np.array([v["adc_gains"] for v in r.leads])[:, None]
                yield pd.DataFrame({"folder": r.folder, "record_id": r.record_id, "lead": [v["lead_names"] for v in r.leads], "signal": list(x.astype(np.float32))})

    one = rows.mapInPandas(run, "folder string, record_id string, lead string, signal array<float>")
    parts = good.filter(F.size("segments") > 0).select("folder", F.col("record_id").alias("whole"), F.posexplode("segments").alias("at", "s"))
    parts = parts.select("folder", "whole", "at", F.split("s", " ")[0].alias("record_id"), F.split("s", " ")[1].cast("int").alias("n"))
    named = parts.join(one, ["folder", "record_id"])
    names = named.select("folder", "whole", "lead").distinct()
    slots = parts.join(names, ["folder", "whole"]).join(named.select("folder", "whole", "at", "lead", "signal"), ["folder", "whole", "at", "lead"], "left")
    gap = F.array_repeat(F.lit(float("nan")).cast("float"), F.col("n"))
    joined = slots.groupBy("folder", "whole", "lead").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("signal", gap).alias("signal")))).alias("all"))
    joined = joined.select(F.col("whole").alias("record_id"), "lead", F.flatten(F.transform("all", lambda v: v["signal"])).alias("signal"))
    own = one.join(parts.select("folder", "record_id").distinct(), ["folder", "record_id"], "left_anti")
    return own.select("record_id", "lead", "signal").unionByName(joined)


def record_summary(signal: DataFrame) -> DataFrame:
    """record_id, samples, and mean, deviation, min and max over all leads."""
    long = signal.select("record_id", F.explode("signal").alias("x"))
    return long.groupBy("record_id").agg(F.count("x").alias("samples"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
