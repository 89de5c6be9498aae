"""Sinks and checked reads: chunked tables with a manifest, required files, public copies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that name a person or a recording.
IDENTIFIERS = ("patient_id", "record_id", "segment_id", "query_id", "path", "record_path")
MANIFEST = "name string, rows long, parts long, parameters map<string,string>"


def write_chunks(df: DataFrame, path: str, parameters: dict[str, object], rows_per_file: int = 1_000_000) -> dict:
    """df as Parquet in files of bounded rows under path/data, and a manifest of rows and parameters as JSON."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/data")
    back = spark.read.parquet(f"{path}/data")
    row = back.select(F.input_file_name().alias("f")).groupBy("f").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("p")).first()
    manifest = {"name": path.rstrip("/").rpartition("/")[2], "rows": row["n"] or 0, "parts": row["p"], "parameters": {k: str(v) for k, v in parameters.items()}}
    spark.createDataFrame([(manifest["name"], manifest["rows"], manifest["parts"], manifest["parameters"])], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def read_chunks(spark: SparkSession, path: str, schema: T.StructType | str | None = None, parameters: dict[str, object] | None = None, chunks: int | None = None) -> DataFrame:
    """The table of a manifest, or its first `chunks` files; an error if rows are missing or it was written otherwise."""
    found = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    reader = spark.read.schema(schema) if schema else spark.read
    if parameters is not None and (found["parameters"] or {}) != {k: str(v) for k, v in parameters.items()}:
        raise ValueError("written with other parameters")
    df = reader.parquet(f"{path}/data")
    if chunks is not None:
        return reader.parquet(*sorted(df.inputFiles())[:chunks]) if chunks else df.limit(0)
    if (n := df.count()) != found["rows"]:
        raise ValueError(f"{n} rows; the manifest says {found['rows']}")
    return df


def cached(spark: SparkSession, path: str, parameters: dict[str, object], make) -> DataFrame:
    """The table that make() gives, stored under a name that has all parameters, so that no stale one is read."""
    key = re.sub(r"[^A-Za-z0-9.=-]+", "_", ",".join(f"{k}={v}" for k, v in sorted(parameters.items())))
    where = f"{path}/{key}"
    try:
        return read_chunks(spark, where, parameters=parameters)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    write_chunks(make(), where, parameters)
    return read_chunks(spark, where, parameters=parameters)


def appended(df: DataFrame, path: str, configuration: str) -> None:
    """Results of one configuration as a partition of their own; a rerun replaces just that."""
    df.withColumn("configuration", F.lit(configuration)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("configuration").parquet(path)


def required(spark: SparkSession, paths: list[str], fmt: str = "parquet", **options) -> DataFrame:
    """All paths as one table; an error if one is missing."""
    return spark.read.format(fmt).options(**options).load(paths)


#: Formats of exported tables: Spark's writer and its options.
EXPORTS = {"csv": ("csv", {"header": "true"}), "csv.gz": ("csv", {"header": "true", "compression": "gzip"}), "json": ("json", {"ignoreNullFields": "false"}), "parquet": ("parquet", {})}


def exported(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Metrics, summaries or predictions for other tools, as a folder of files of one kind; what was there is replaced.

    In csv, arrays and maps are written as JSON, since csv has no such types.
    """
    if kind not in EXPORTS:
        raise ValueError(f"{kind}: not one of {sorted(EXPORTS)}")
    fmt, options = EXPORTS[kind]
    if fmt == "csv":
        df = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))
    df.write.mode("overwrite").format(fmt).options(**options).save(path)


def public_copy(df: DataFrame, path: str, columns: list[str]) -> None:
    """The allowed columns as CSV; an error if one identifies someone or isn't there."""
    if bad := [c for c in columns if c in IDENTIFIERS or c not in df.columns]:
        raise ValueError(f"not for publication: {bad}")
    df.select(*columns).write.mode("overwrite").option("header", "true").csv(path)


def protocol_rows(spark: SparkSession, model, scope: str, name: str) -> DataFrame:
    """scope, model, step, parameter, value of an estimator, a model or a pipeline of them."""
    steps = model.getStages() if hasattr(model, "getStages") else getattr(model, "stages", [model])
    rows = [(scope, name, type(s).__name__, p.name, str(v)) for s in steps for p, v in s.extractParamMap().items()]
    return spark.createDataFrame(sorted(rows), "scope string, model string, step string, parameter string, value string")
