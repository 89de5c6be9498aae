"""Mixing sources to target weights: balanced sampling by the cube method.

Every document of a source has the inclusion target/source_size: its whole part is taken as repeats, its
fraction is decided by the flight phase, which keeps the sums of words and of documents. Flights run in groups of
bounded size; what they leave open (two documents a group and the few held back for the landing) flies again, until one group
a source remains, whose open documents land by the best of all choices.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Weights by the rank of the source, repeating.
WEIGHTS = (5, 2, 1)
EPS = 1e-9


def flight(p: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Moves the inclusions p along the null space of (1, size) until at most two are not 0 or 1."""
    p, open_ = p[:], []
    todo = iter(range(len(p)))
    while True:
        while len(open_) < 3:
            k = next(todo, None)
            if k is None:
                break
            if EPS < p[k] < 1 - EPS:
                open_.append(k)
            else:
                p[k] = float(round(p[k]))
        if len(open_) < 2:
            return p
        a, b = size[open_[0]], size[open_[1]]
        if len(open_) == 3:
            c = size[open_[2]]
            u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        elif a == b:
            u = (1.0, -1.0)
        else:
            return p
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(open_, u) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(open_, u) if x)
        move = up if rng.random() * (up + down) < down else -down
        for k, x in zip(open_, u):
            p[k] += move * x
            if p[k] < EPS or p[k] > 1 - EPS:
                p[k] = float(round(p[k]))
        open_ = [k for k in open_ if 0 < p[k] < 1]


def held_back(p: list[float], size: list[float], keep: int) -> set[int]:
    """Up to `keep` open documents, half the largest and half spaced over the sizes: the landing chooses among them."""
    open_ = sorted((k for k, x in enumerate(p) if EPS < x < 1 - EPS), key=lambda k: (size[k], k))
    half = keep // 2
    return {*open_[-half:], *(open_[len(open_) * j // half] for j in range(half))} if len(open_) > keep else set(open_)


def land(p: list[float], size: list[float]) -> list[float]:
    """Decides the open documents (a few) by trying every choice: words nearest to their sum, then documents."""
    open_ = [k for k, x in enumerate(p) if 0 < x < 1]
    if not open_:
        return p
    s = np.array([size[k] for k in open_])
    words, docs = sum(p[k] * size[k] for k in open_), sum(p[k] for k in open_)
    take = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    cost = np.abs(take @ s - words) + 0.1 * max(s.mean(), 1) * np.abs(take.sum(1) - docs)
    best, p = take[int(np.argmin(cost))], p[:]
    for j, k in enumerate(open_):
        p[k] = float(best[j])
    return p


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, source_size, docs -> and target: the whole size shared by weight, each at most cap times its source.

    The excess of capped sources goes to the others by weight until none is above: with sources in ascending
    cap/weight the capped ones are a prefix. Works on one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    # Every source has a place in the order, one of size 0 too.
    t = sizes.withColumn("weight", weight).filter("source_size > 0").withColumn("cap", cap * F.col("source_size"))
    by = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # The level of words per weight if the sources before this one are capped and this one isn't.
    t = t.withColumn("level", (everything - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    t = t.withColumn("level", F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    t = t.withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
    return t.select("source", "source_size", "docs", "target").unionByName(sizes.filter("source_size = 0").withColumn("target", F.lit(0.0)).select("source", "source_size", "docs", "target"))


def mix_sources(sized: DataFrame, cap: float = 3.0, group: int = 2048, seed: int = 11, keep: int = 14) -> DataFrame:
    """doc_id, source, size -> doc_id, source, size, source_size, target, taken; one row for each row.

    sized must be a stored table (it is read several times). A source of size 0, or null, is a source like others. With
    a column `row`, rows without a doc_id are dealt by it.
    """
    sized = sized if "row" in sized.columns else sized.withColumn("row", F.lit(0).cast("long"))
    cols = "doc_id", "source", "size", "source_size", "target", "times", "p", "row"
    own = F.when(F.col("doc_id").isNull(), F.col("row"))
    sums = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), cap)
    salts = 64  # a source may hold most rows
    right = sums.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts))))).withColumnRenamed("source", "s_")
    left = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size", own), F.lit(salts)).cast("int"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = left.join(right, (left["salt"] == right["salt"]) & left["source"].eqNullSafe(right["s_"])).select("doc_id", "source", "size", "source_size", "target", F.floor(rate).alias("times"), (rate - F.floor(rate)).alias("p"), "row", F.ceil(F.col("docs") / group).alias("groups"))
    schema = ", ".join(f"{c} {t}" for c, t in (*joined.select("doc_id", "source").dtypes, ("size", "long"), ("source_size", "long"), ("target", "double"), ("times", "long"), ("p", "double"), ("row", "long")))

    def fly(last: bool, level: int):
        def run(t: pa.Table) -> pa.Table:
            t = t.select(list(cols)).sort_by([("doc_id", "ascending"), ("size", "ascending"), ("row", "ascending")])
            size, p = t["size"].to_pylist(), t["p"].to_pylist()
            rng = random.Random(f"{seed} {level} {t['source'][0].as_py()} {t['doc_id'][0].as_py()} {len(p)}")
            order = list(range(len(p)))
            rng.shuffle(order)
            back = held_back(p, size, keep)
            order = [k for k in order if k not in back]
            for k, x in zip(order, flight([p[k] for k in order], [float(size[k]) for k in order], rng)):
                p[k] = x
            if last:
                p = land(p, [float(x) for x in size])
            return t.set_column(6, "p", pa.array(p, pa.float64()))

        return run

    done, state, level = [], joined, 0
    while True:
        many = level == 0 or state.agg(F.max("groups")).first()[0] or 0
        last = level > 0 and many <= 1
        flown = state.withColumn("g", F.pmod(F.xxhash64("doc_id", "size", F.lit(level), own), F.col("groups"))).groupBy("source", "g").applyInArrow(fly(last, level), schema)
        flown = written(flown, "flight")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.filter(~open_))
        if last:
            break
        rest = flown.filter(open_)
        counts = rest.groupBy("source").agg(F.ceil(F.count("*") / group).alias("groups")).withColumnRenamed("source", "s_")
        # A few rows a group of the level before, but one source may have most of them: salted like above.
        right = counts.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
        left = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size", own), F.lit(salts)).cast("int"))
        state = left.join(right, (left["salt"] == right["salt"]) & left["source"].eqNullSafe(right["s_"])).select(*cols, "groups")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("times") + F.col("p").cast("long"))).alias("taken"))


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, the words of the text (null: 0), and row, a number, as a stored table."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return written(documents.select("doc_id", "source", size.alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")


def op9(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source.

    A null text has size 0, and is taken with 0 words; a null source is one like others, the last in order. Rows with
    null or repeated doc_ids are rows each. Reruns over the same rows agree. Other columns are ignored; an empty table
    gives an empty result.
    """
    return mix_sources(sized(documents)).select("doc_id", "size", "source_size", "target", "taken", "source")
