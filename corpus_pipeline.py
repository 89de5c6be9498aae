"""A corpus clean-up over `documents`: each stage works on all that its predecessor kept.

Toxic documents go, then exact copies, then near copies (five-word shingles, similarity of 0.8 or more; one document of
each group stays), then documents with a passage of the benchmark; the rest is mixed to the sources' target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, exact_dedup, mixing, near_dedup
from quillon.llm import toxicity as toxic
from quillon.llm.common import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among docs, does not reject.

    Each row is judged by its own text, read whole; null counts as empty, and an empty text by the bias alone. Rows with
    null or repeated doc_ids are rows each. Without labels every score is 0.5, and all rows go; other columns stay.
    """
    return toxic.harmless(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null counts as empty, and of rows alike in both one stays.

    A null doc_id is below all others. Texts are compared whole, at any length; other columns stay.
    """
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id (null last) of each group of near copies; texts without words stay.

    Rows that share a doc_id are told apart by number; texts of any length are read whole; other columns stay.
    """
    # 48 bands of 6 coordinates miss a link at similarity 0.8 with probability 5e-7.
    return near_dedup.kept_documents(docs, percent=80, count=48, rows=6)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text has no window of a benchmark item.

    A null or empty text has no words, and stays. Rows with null or repeated doc_ids, and repeated rows, are judged one by
    one; texts of any length are read whole; other columns stay. Without items all rows stay.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document left: doc_id, size, source_size, target, taken, source.

    A null text has size 0; a null source is one like others, the last in order. Repeated rows are rows each; other
    columns end here.
    """
    return mixing.op9(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmark), ("mixing", mix)]
#: Trained, sketched and sampled stages are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; each result but the last is stored and read again.

    Rows with null or repeated doc_ids are decided one by one. Columns beyond those of documents pass through all stages
    but the last, whatever their names. Empty tables give an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
