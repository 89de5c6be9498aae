"""Galleries: one true candidate of a query among others, and how high it ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.hashing import hash_52
from .draws import distinct_numbers, mates
from .sampling import ranked, top_k


def gallery(segments: DataFrame, key: str, record: str, ref: str, queries: int | None, others: int, gap: int = 1, seed: int = 0, trues: int = 1) -> DataFrame:
    """query, candidate, label: each query's true candidates (`trues` at most) and segments of `others` distinct other records.

    A query is any segment with a mate of its record at the gap; `queries` of them by hash, or all. The true candidates
    and the other records are drawn for the query, each set of so many alike, or all if there are no more; of each other
    record a segment is drawn for the query. All are equi-joins on ranks, without a list of all pairs.
    """
    segs = segments.select(key, record, ref)
    true = mates(segs, key, record, ref, gap, trues, f"{seed}mate").select(F.col(key).alias("query"), record, F.col("mate").alias("candidate"))
    asked = true.select("query", record).distinct()
    if queries is not None:
        asked = ranked(asked, hash_52("query", seed=seed), ties=["query"]).filter(F.col("rank_") <= queries).drop("rank_", "total_")
        true = true.join(asked.select("query"), "query", "left_semi")
    circle = ranked(segs.select(record).distinct(), hash_52(record, seed=seed), ties=[record])
    one = circle.select(F.col(record).alias("other"), (F.col("rank_") - 1).alias("at"))
    own, j = F.col("rank_") - 1, F.col("j")
    wanted = asked.join(circle, record).filter("total_ > 1").select("query", "rank_", F.explode(distinct_numbers(F.col("total_") - 1, others, "query", seed=f"{seed}others")).alias("j"))
    wanted = wanted.select("query", F.when(j < own, j).otherwise(j + 1).alias("at"))
    rows = ranked(segs, hash_52(key, seed=f"{seed}pick"), by=[record], ties=[key])
    counts = rows.groupBy(record).agg(F.max("total_").alias("m_")).withColumnRenamed(record, "other")
    drawn = wanted.join(one, "at").join(counts, "other").select("query", "other", (F.pmod(hash_52("query", "other", seed=f"{seed}pick"), F.col("m_")) + 1).alias("k_"))
    wrong = drawn.join(rows.select(F.col(record).alias("other"), F.col("rank_").alias("k_"), F.col(key).alias("candidate")), ["other", "k_"]).select("query", "candidate", F.lit(0).alias("label"))
    return true.select("query", "candidate", F.lit(1).alias("label")).unionByName(wrong)


def scored(pairs: DataFrame, segments: DataFrame, key: str, vector: str, metric: str = "cosine") -> DataFrame:
    v = segments.select(F.col(key), vectors.doubles(vector).alias("v"))
    both = pairs.join(v.select(F.col(key).alias("query"), F.col("v").alias("a")), "query").join(v.select(F.col(key).alias("candidate"), F.col("v").alias("b")), "candidate")
    score = vectors.cosine("a", "b") if metric == "cosine" else vectors.negative_euclidean("a", "b")
    return both.select("query", "candidate", "label", score.alias("score"))


def true_ranks(pairs: DataFrame) -> DataFrame:
    """query, rank of its true candidate by score (ties by candidate); queries without exactly one true are left out."""
    w = Window.partitionBy("query")
    rows = pairs.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "candidate"))).withColumn("trues", F.sum("label").over(w))
    return rows.filter("trues = 1 and label = 1").select("query", F.col("rank").cast("long").alias("rank"))


def ranking_metrics(pairs: DataFrame, at: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: queries, mrr and recall_at_k."""
    return true_ranks(pairs).agg(F.count("*").alias("queries"), F.avg(1 / F.col("rank")).alias("mrr"), *(F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_at_{k}") for k in at))


def selected(pairs: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query, with their rank."""
    rows = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate")))
    return rows.filter(F.col("rank") <= k)


def selection_quality(pairs: DataFrame, k: int) -> DataFrame:
    """One row: precision, recall and multi-positive reciprocal rank of selecting k of each query's candidates."""
    w = Window.partitionBy("query")
    rows = pairs.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "candidate")))
    per = rows.groupBy("query").agg(F.sum("label").alias("trues"), F.sum(F.when(F.col("rank") <= k, F.col("label")).otherwise(0)).alias("hits"), F.avg(F.when(F.col("label") == 1, 1 / F.col("rank"))).alias("rr"))
    return per.agg(F.avg(F.col("hits") / k).alias("precision"), F.avg(F.col("hits") / F.greatest("trues", F.lit(1))).alias("recall"), F.avg("rr").alias("mean_reciprocal_rank"))


def linked_views(pairs: DataFrame, segments: DataFrame, key: str, vector: str, k: int = 3, seed: int = 0) -> DataFrame:
    """query, condition, view: the mean of the anchor's vector and of k others.

    single: the anchor alone; oracle: with its true candidates; link_selected: with the k of best score; random: with k
    of the wrong candidates, by hash.
    """
    best = selected(pairs, k).select("query", "candidate", F.lit("link_selected").alias("condition"))
    true = pairs.filter("label = 1").select("query", "candidate", F.lit("oracle").alias("condition"))
    wrong = top_k(pairs.filter("label = 0"), ["query"], [hash_52("query", "candidate", seed=seed), F.col("candidate")], k).select("query", "candidate", F.lit("random").alias("condition"))
    anchor = pairs.select("query").distinct()
    own = anchor.withColumn("condition", F.explode(F.array(*map(F.lit, ("single", "oracle", "link_selected", "random"))))).select("query", F.col("query").alias("candidate"), "condition")
    rows = best.unionByName(true).unionByName(wrong).unionByName(own)
    long = rows.join(segments.select(F.col(key).alias("candidate"), F.posexplode(vectors.doubles(vector)).alias("i", "x")), "candidate")
    mean = long.groupBy("query", "condition", "i").agg(F.avg("x").alias("x"))
    return mean.groupBy("query", "condition").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("view"))
