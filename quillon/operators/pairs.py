"""Pairs of segments: same record or different records, without cross joins or row positions."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.hashing import TWO_52, hash_52
from ..sources.stored import discard, written
from . import nearest, transforms
from .draws import drawn_of_all, drawn_pairs, mates, strangers
from .sampling import in_order, ranked, top_k

#: Refs of a block of ordered_pairs, and about how many pairs a task of it gives.
BLOCK, TASK = 2048, 20_000_000
#: So many first pairs by hash are found by a heap in each task, more of them by ranks.
FIRST = 10_000


def positive_pairs(segments: DataFrame, record: str, ref: str, gap: float = 0, per_record: int | None = None, most: int | None = None, seed: int = 0) -> DataFrame:
    """record, ref_a, ref_b: unordered pairs of a record whose refs are at least `gap` apart.

    At most `per_record` pairs of a record, drawn without listing its pairs, and then `most` in all are kept, by hash.
    `most` alone is drawn among all pairs without listing them, if there are more than four times as many.
    """
    if per_record is None and most is not None and (out := drawn_of_all(segments, record, ref, gap, most, seed)) is not None:
        return out
    out = _all_pairs(segments, record, ref, gap) if per_record is None else drawn_pairs(segments, record, ref, gap, per_record, seed)
    if most is not None:
        order = [hash_52(record, "ref_a", "ref_b", seed=seed), F.col(record), F.col("ref_a"), F.col("ref_b")]
        if most <= FIRST:
            return out.orderBy(*order).limit(most)
        out = ranked(written(out, "drawn"), order[0], ties=[record, "ref_a", "ref_b"]).filter(F.col("rank_") <= most).drop("rank_", "total_")
    return out


def _all_pairs(segments: DataFrame, record: str, ref: str, gap: float, key: str | None = None) -> DataFrame:
    """record, ref_a, ref_b of all pairs; with `key` also key_a and key_b."""
    end = lambda s: [F.col(ref).alias(f"ref_{s}"), *([F.col(key).alias(f"key_{s}")] if key else [])]
    a = segments.select(F.col(record), *end("a"))
    b = segments.select(F.col(record).alias("_r"), *end("b"))
    # With a gap of 0 the order of refs still keeps one of both directions.
    return a.join(b, (a[record] == b["_r"]) & (F.col("ref_a") < F.col("ref_b")) & (F.col("ref_b") - F.col("ref_a") >= gap)).drop("_r")


def matched_pairs(segments: DataFrame, key: str, record: str, ref: str, gap: int = 1, seed: int = 0) -> DataFrame:
    """key_a, key_b, label: every segment with a mate (1) and with a stranger (0), each unordered pair once.

    The number of pairs grows with the segments.
    """
    both = mates(segments, key, record, ref, gap, seed=f"{seed}mate").select(key, F.col("mate").alias("o_"), F.lit(1).alias("label"))
    both = both.unionByName(strangers(segments, key, record, f"{seed}other").select(key, F.col("stranger").alias("o_"), F.lit(0).alias("label")))
    return both.select(F.least(key, "o_").alias("key_a"), F.greatest(key, "o_").alias("key_b"), "label").distinct()


def pair_counts(segments: DataFrame, record: str, ref: str, gap: int = 1) -> DataFrame:
    """record, n_pairs: how many pairs ordered_pairs gives for integer refs that are unique in a record, without listing
    them; records without a pair are left out."""
    later = Window.partitionBy(record).orderBy(ref).rangeBetween(max(gap, 1), Window.unboundedFollowing)
    counts = segments.select(record, F.count("*").over(later).alias("n_")).groupBy(record).agg((2 * F.sum("n_")).alias("n_pairs"))
    return counts.filter("n_pairs > 0")


def ordered_pairs(segments: DataFrame, record: str, ref: str, gap: int = 1, size: int = BLOCK) -> DataFrame:
    """record, ref_a, ref_b in both directions, refs at least `gap` apart.

    A record's refs are cut in blocks of at most `size` in their order. Every two blocks meet in a task by their hash and
    are joined there row by row, so that a record of any size is spread over tasks, whose number goes with the pairs.
    """
    rows = in_order(segments.select(F.col(record).alias("record_"), F.col(ref).alias("ref_")).dropna(), [F.col("record_"), F.col("ref_")])
    # Places run over all records: the blocks of a record are its shares of runs of places, without holes.
    blocks = written(rows.groupBy("record_", F.floor((F.col("place") - 1) / size).alias("block_")).agg(F.collect_list("ref_").alias("refs_")), "blocks")
    spans = blocks.groupBy("record_").agg(F.min("block_").alias("least_"), F.max("block_").alias("most_"))
    met = spans.agg(F.sum((F.col("most_") - F.col("least_") + 1) ** 2)).first()[0] or 0
    parts = max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(met * size**2 / TASK))

    def side(own: str, other: str, name: str) -> DataFrame:
        d = blocks.join(spans, "record_").select("record_", F.col("block_").alias(own), "refs_", F.explode(F.sequence("least_", "most_")).alias(other))
        return d.repartition(parts, "record_", "i_", "j_").select("record_", "i_", "j_", F.explode("refs_").alias(name))

    # A merge join gives out row after row, where one that is broadcast or explodes both blocks would hold all pairs of them.
    both = side("i_", "j_", "ref_a").join(side("j_", "i_", "ref_b").hint("merge"), ["record_", "i_", "j_"])
    both = both.filter((F.col("ref_a") != F.col("ref_b")) & (F.abs(F.col("ref_a") - F.col("ref_b")) >= gap))
    return both.select(F.col("record_").alias(record), "ref_a", "ref_b")


def random_negatives(segments: DataFrame, key: str, record: str, n: int, seed: int = 0, tries: int = 20, label: str | None = None) -> DataFrame:
    """key_a, key_b: n distinct unordered pairs of different records (fewer, if n * tries draws have fewer).

    Both ends of a draw are ranks by hash, so that the draws are two equi-joins. With `label`, both ends share it, and
    an attacker can't tell the classes apart by label.
    """
    by = [label] if label else []
    rows = ranked(segments.select(key, record, *by), hash_52(key, seed=seed), by=by, ties=[key])
    sizes = rows.groupBy(*by).agg(F.max("total_").alias("m_"))
    ends = lambda s: rows.select(F.col(key).alias(f"k{s}"), F.col(record).alias(f"r{s}"), F.col("rank_").alias(f"{s}_"), *(F.col(c) for c in by))

    def found(m: int) -> DataFrame:
        """The distinct pairs of the first m draws, with the first draw of each."""
        draws = segments.sparkSession.range(m).withColumnRenamed("id", "d_").crossJoin(F.broadcast(sizes)) if not label else None
        if label:
            draws = sizes.withColumn("d_", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        draws = draws.filter("m_ > 0").withColumn("x_", F.pmod(hash_52("d_", seed=f"{seed}x"), F.col("m_")) + 1).withColumn("y_", F.pmod(hash_52("d_", seed=f"{seed}y"), F.col("m_")) + 1)
        out = draws.join(ends("x"), ["x_", *by]).join(ends("y"), ["y_", *by]).filter("rx <> ry")
        return out.groupBy(F.least("kx", "ky").alias("key_a"), F.greatest("kx", "ky").alias("key_b")).agg(F.min("d_").alias("d_"))

    limit = max(n * tries, 1000)
    if n <= FIRST or label:
        return found(limit).orderBy("d_", "key_a", "key_b").limit(n).drop("d_")
    # The first n of many draws: no more draws than it takes, and a cut by ranks, as no task may hold them.
    rows = written(rows, "ends")
    m = min(limit, n + n // 4)
    out = written(found(m), "negatives")
    while m < limit and out.count() < n:
        discard(out)
        m = min(limit, 2 * m)
        out = written(found(m), "negatives")
    return ranked(out, F.col("d_") * (TWO_52 // m), ties=["key_a", "key_b"]).filter(F.col("rank_") <= n).select("key_a", "key_b")


def centroids(segments: DataFrame, record: str, vector: str) -> DataFrame:
    """record and the mean vector of its segments, as (record, centroid)."""
    long = segments.select(record, F.posexplode(vectors.doubles(vector)).alias("i", "x"))
    mean = long.groupBy(record, "i").agg(F.avg("x").alias("x"))
    return mean.groupBy(record).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def nearest_records(segments: DataFrame, record: str, vector: str, k: int = 5, **how) -> DataFrame:
    """record, neighbour, distance: the k records with the nearest mean vectors, exactly, at any number of records.

    The means are imputed by medians and scaled over all records first. A record is compared with those that the
    triangle inequality leaves (`nearest`).
    """
    means = centroids(segments.filter(F.col(record).isNotNull()), record, vector).withColumnRenamed("centroid", "v_")
    points = transforms.fit_vectors(means, "v_").transform(means, "v_", "v_").select(F.col(record).alias("id"), F.col("v_").alias("v"))
    return nearest.nearest(points, k, **how).withColumnRenamed("id", record)


def hard_negatives(segments: DataFrame, key: str, record: str, vector: str, n: int, k: int = 5, seed: int = 0, tries: int = 20) -> DataFrame:
    """key_a, key_b: segments of a record and of one of its nearest records; at most n distinct pairs.

    The k records after the very nearest one are its pool. The pairs of records take turns: in each of up to `tries`
    rounds a segment of each is drawn by hash, until there are n pairs.
    """
    near = top_k(nearest_records(segments, record, vector, k + 1).withColumn("at_", F.row_number().over(Window.partitionBy(record).orderBy("distance", "neighbour"))).filter("at_ > 1"), [record, "neighbour"], [F.col("at_")], 1)
    near = near.select(F.least(record, "neighbour").alias("r1"), F.greatest(record, "neighbour").alias("r2")).distinct()
    rounds = near.select("r1", "r2", F.explode(F.sequence(F.lit(0), F.least(F.lit(tries), F.lit(n)) - 1)).alias("turn"))
    rows = ranked(segments.select(key, record), hash_52(key, seed=seed), by=[record], ties=[key])
    sizes = rows.groupBy(record).agg(F.max("total_").alias("m_"))

    def end(d: DataFrame, r: str, name: str) -> DataFrame:
        d = d.join(sizes.withColumnRenamed(record, r), r).withColumn("k_", F.pmod(hash_52("r1", "r2", "turn", seed=f"{seed}{name}"), F.col("m_")) + 1).drop("m_")
        return d.join(rows.select(F.col(record).alias(r), F.col("rank_").alias("k_"), F.col(key).alias(name)), [r, "k_"]).drop("k_")

    out = end(end(rounds, "r1", "a"), "r2", "b")
    out = out.groupBy(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).agg(F.min("turn").alias("turn"))
    return out.orderBy("turn", hash_52("key_a", "key_b", seed=seed), "key_a", "key_b").limit(n).drop("turn")


def negatives(segments: DataFrame, key: str, record: str, n: int, strategy: str = "random", vector: str | None = None, k: int = 5, seed: int = 0) -> DataFrame:
    """Random, or hard ones filled up from random ones (seed + 101)."""
    if strategy not in ("random", "hard"):
        raise ValueError(strategy)
    if strategy == "random":
        return random_negatives(segments, key, record, n, seed)
    hard = hard_negatives(segments, key, record, vector, n, k, seed).withColumn("p_", F.lit(0))
    fill = random_negatives(segments, key, record, n, seed + 101).withColumn("p_", F.lit(1))
    both = hard.unionByName(fill).groupBy("key_a", "key_b").agg(F.min("p_").alias("p_"))
    return both.orderBy("p_", hash_52("key_a", "key_b", seed=seed), "key_a", "key_b").limit(n).drop("p_")


def pair_table(segments: DataFrame, key: str, record: str, ref: str, most: int | None, gap: int = 0, per_record: int | None = None, strategy: str = "random", vector: str | None = None, seed: int = 0) -> DataFrame:
    """key_a, key_b, pair_label: positive pairs (without `most` and `per_record` all there are), and as many negative ones."""
    if most is None and per_record is None:
        pos = _all_pairs(segments, record, ref, gap, key)
    else:
        pos = positive_pairs(segments, record, ref, gap, per_record, most, seed)
        at = segments.select(F.col(record), F.col(ref), F.col(key))
        pos = pos.join(at.withColumnRenamed(ref, "ref_a").withColumnRenamed(key, "key_a"), [record, "ref_a"]).join(at.withColumnRenamed(ref, "ref_b").withColumnRenamed(key, "key_b"), [record, "ref_b"])
    pos = written(pos.select("key_a", "key_b", F.lit(1).alias("pair_label")), "positives")
    neg = negatives(segments, key, record, pos.count(), strategy, vector, seed=seed)
    return written(pos.unionByName(neg.select("key_a", "key_b", F.lit(0).alias("pair_label"))), "pairs")  # so that its size is known


def with_vectors(pairs: DataFrame, segments: DataFrame, key: str, vector: str, *features: tuple[str, Column]) -> DataFrame:
    """The pairs with vectors a and b of their ends, and further expressions of these."""
    v = segments.select(F.col(key), vectors.doubles(vector).alias("v"))
    out = pairs.join(v.select(F.col(key).alias("key_a"), F.col("v").alias("a")), "key_a").join(v.select(F.col(key).alias("key_b"), F.col("v").alias("b")), "key_b")
    return out.select("*", *(x.alias(name) for name, x in features))


def pair_features(pairs: DataFrame, segments: DataFrame, key: str, vector: str, representation: str = "absdiff") -> DataFrame:
    """pairs with `features`: |a - b|, or that followed by the means (absdiff_mean)."""
    if representation not in ("absdiff", "absdiff_mean"):
        raise ValueError(representation)
    diff = vectors.absdiff("a", "b")
    x = diff if representation == "absdiff" else F.concat(diff, vectors.mean_of("a", "b"))
    return with_vectors(pairs, segments, key, vector, ("features", x)).drop("a", "b")
