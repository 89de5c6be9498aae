"""The driver's tables as the record-and-segment concepts that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.hashing import uniform
from ..operators import gallery, pairs, windows


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a user is a record, its events in time are the samples."""
    return windows.indexed(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def vector_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: a label is a record, vec_id is key and ref."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("vec_id").alias("ref"), vectors.doubles("embedding").alias("v"))


def link_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with one of its label and one of another, with cosine scores rounded to 6 digits."""
    seg = vector_segments(spark, sf_dir)
    return pairs.with_vectors(pairs.matched_pairs(seg, "vec_id", "label", "ref", gap=5, seed=42), seg, "vec_id", "v", ("score", F.round(vectors.cosine("a", "b"), 6))).select("key_a", "key_b", "label", "score")


def gallery_scores(spark: SparkSession, sf_dir: str, queries: int | None = None, others: int = 9, trues: int = 1) -> DataFrame:
    seg = vector_segments(spark, sf_dir)
    rows = gallery.gallery(seg, "vec_id", "label", "ref", queries, others, gap=5, seed=42, trues=trues)
    return gallery.scored(rows, seg, "vec_id", "v").withColumn("score", F.round("score", 6))


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, label (a purchase), score (a uniform, in thousandths, so that it ties)."""
    return read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "purchase").cast("int").alias("label"), F.round(uniform("event_id", seed=1), 3).alias("score"))
