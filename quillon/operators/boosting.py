"""Second-order gradient boosting over histograms, for vectors of features.

Features are cut into bins by quantiles once; after that a row is its bins, its target and its margin. Each level of a
tree is one pass: a task adds the gradients and Hessians of its rows into a histogram for each open node, feature and
bin, blocks of features are added up and searched for their best splits in tasks of their own, and the driver gets one
candidate a node and block. Margins are stored every few trees, so that a pass evaluates only the newest ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import mapped, matrix
from ..functions.scalars import null_if_nan
from ..sources.stored import discard, written

#: Bins of a feature, features of a block, groups of tasks whose histograms are added first, and trees between stores.
BINS, BLOCK, FIRST, KEEP = 256, 32, 64, 10


@dataclass
class Tree:
    """Nodes in the order of their growth: a feature and threshold (a value up to it goes left) and children, or a weight."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, weight: float) -> int:
        for x, v in ((self.feature, -1), (self.cut, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.weight, weight), (self.gain, 0.0)):
            x.append(v)
        return len(self.weight) - 1

    def nodes(self, x: np.ndarray, by: list) -> np.ndarray:
        """The node that each row ends in; `by` is cut for bins and threshold for values."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        feature, left, right, by = np.array(self.feature), np.array(self.left), np.array(self.right), np.array(by)
        while len(rows):
            rows = rows[feature[at[rows]] >= 0]
            f = feature[at[rows]]
            at[rows] = np.where(x[rows, f] <= by[at[rows]], left[at[rows]], right[at[rows]])
        return at


@dataclass
class Boosted:
    """A fitted ensemble: the margin is base plus the weights of the leaves; for classes its logistic is the score."""

    trees: list[Tree]
    base: float
    classes: bool
    width: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += np.array(t.weight)[t.nodes(x, t.threshold)]
        return out

    def predict(self, df: DataFrame, features: str, name: str = "score") -> DataFrame:
        """df with the probability of class 1, or the estimate; a missing feature is below all values."""
        link = (lambda m: 1 / (1 + np.exp(-m))) if self.classes else (lambda m: m)
        temp = f"{name}_of"
        out = mapped(df.withColumn(temp, F.col(features)), temp, temp, lambda x: link(self.margin(np.where(np.isnan(x), -np.inf, x)))[:, None], self.width)
        return out.select(*(c for c in df.columns if c != name), F.get(temp, F.lit(0)).alias(name))

    def importance(self) -> np.ndarray:
        """The share of each feature in the gains of all splits."""
        out = np.zeros(self.width)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    out[f] += g
        return out / out.sum() if out.sum() else out


def cuts(train: DataFrame, features: str, width: int, bins: int = BINS) -> list[np.ndarray]:
    """The upper ends of each feature's bins but the last: quantiles, or all values but the greatest if they are few.
    Where values are missing, the first bin is theirs."""
    out = []
    for lo in range(0, width, BLOCK):
        part = [null_if_nan(F.get(features, F.lit(k)).cast("double")) for k in range(lo, min(lo + BLOCK, width))]
        marks = [k / bins for k in range(1, bins)]
        row = train.agg(*(F.percentile_approx(x, marks, 10_000).alias(f"q{k}") for k, x in enumerate(part)), *(F.approx_count_distinct(x, 0.02).alias(f"d{k}") for k, x in enumerate(part)), *(F.max(x).alias(f"m{k}") for k, x in enumerate(part)), *(F.count_if(x.isNull()).alias(f"n{k}") for k, x in enumerate(part))).first()
        few = [k for k in range(len(part)) if row[f"d{k}"] <= bins * 0.9]  # few values: each is a bin
        sets = train.agg(*(F.collect_set(part[k]).alias(f"s{k}") for k in few)).first() if few else None
        for k in range(len(part)):
            found = sets[f"s{k}"] if k in few else row[f"q{k}"] or []
            values = sorted({float(v) for v in found if v is not None and v < row[f"m{k}"]})[: bins - 2]
            out.append(np.array([-np.inf] * (row[f"n{k}"] > 0) + values))
    return out


def _packed(train: DataFrame, edges: list[np.ndarray], base: float) -> DataFrame:
    """bins (a byte a feature), y, h and margin of each training row (x, y and h, a hash)."""
    width = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["x"], width)
            bins = np.empty(x.shape, np.uint8)
            for k, e in enumerate(edges):
                bins[:, k] = np.where(np.isnan(x[:, k]), 0, np.searchsorted(e, x[:, k], "left"))
            offs = pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int64))
            packed = pa.Array.from_buffers(pa.large_binary(), len(x), [None, offs, pa.py_buffer(bins)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([packed, batch["y"], batch["h"], pa.array(np.full(len(x), base))], ["bins", "y", "h", "margin"])

    return train.mapInArrow(run, "bins binary, y double, h long, margin double")


def _bins(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(-1, width)


def _drawn(h: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Whether each row is in the tree's sample: a function of its hash, the tree and the seed."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) ^ (np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + 1) * np.uint64(0xD1B54A32D192ED03))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * (1 << 53)))


def fit(train: DataFrame, features: str, y: str, key: str, *, classes: bool = True, trees: int = 200, depth: int = 4, rate: float = 0.05, subsample: float = 0.8, columns: float = 0.8, l2: float = 1.0, least: float = 1.0, positive_weight: float | None = None, bins: int = BINS, seed: int = 0) -> Boosted:
    """An ensemble for a 0/1 target (logistic loss) or a number (squared error) in `y`.

    A split maximises the gain G_left^2 / (H_left + l2) + G_right^2 / (H_right + l2) - G^2 / (H + l2), with at least
    `least` Hessian on both sides; leaves weigh -rate G / (H + l2). A tree reads a share `subsample` of the rows, by hash
    of key, and a share `columns` of the features, drawn once a tree. positive_weight is the weight of class 1; None is
    negatives to positives. Margins start at the log odds of the weights, or the mean. Of equal gains the lower feature
    and then the lower bin wins.
    """
    train = train.filter(F.col(features).isNotNull() & F.col(y).isNotNull())
    train = written(train.select(F.col(features).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), F.xxhash64(key).alias("h")), "training")
    first = train.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no training rows")
    width = first["n"]
    sums = train.agg(F.avg("y").alias("m"), F.sum("y").alias("p"), F.count("*").alias("n")).first()
    heavy = (max(sums["n"] - sums["p"], 1) / max(sums["p"], 1) if positive_weight is None else positive_weight) if classes else 1.0
    share = heavy * sums["m"] / (heavy * sums["m"] + 1 - sums["m"]) if classes and sums["m"] else 0.0  # of the weights
    share = min(max(share, 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share))) if classes else float(sums["m"])
    edges = cuts(train, "x", width, bins)
    state = written(_packed(train, edges, base), "boosting")
    discard(train)
    many = state.rdd.getNumPartitions() > FIRST  # tasks
    rng, model, fresh = np.random.default_rng(seed), Boosted([], base, classes, width), []

    def margins(batch: pa.RecordBatch, x: np.ndarray, recent: list[Tree]) -> np.ndarray:
        out = batch["margin"].to_numpy().copy()
        for t in recent:
            out += np.array(t.weight)[t.nodes(x, t.cut)]
        return out

    for number in range(trees):
        chosen = np.sort(rng.permutation(width)[: max(1, round(columns * width))])
        tree, sizes, goes_on = Tree(), {}, True
        tree.add(0.0)
        open_ = [0]
        for level in range(depth):
            found = _splits(state, many, width, chosen, tree, open_, list(fresh), margins, edges, number, seed, subsample, classes, heavy, l2, least)
            if level == 0:
                g, h = next(((r["g"], r["h"]) for r in found), (0.0, 0.0))
                tree.weight[0] = -rate * g / (h + l2)
            new = []
            for node in open_:
                best = max((r for r in found if r["node"] == node and r["gain"] > 1e-12), key=lambda r: (r["gain"], -r["feature"], -r["bin"]), default=None)
                if best is None:
                    continue
                f, b = best["feature"], best["bin"]
                tree.feature[node], tree.cut[node], tree.threshold[node], tree.gain[node] = f, b, float(edges[f][b]), best["gain"]
                tree.left[node] = tree.add(-rate * best["gl"] / (best["hl"] + l2))
                tree.right[node] = tree.add(-rate * (best["g"] - best["gl"]) / (best["h"] - best["hl"] + l2))
                new += [tree.left[node], tree.right[node]]
            open_ = new
            if not open_:
                break
        model.trees.append(tree)
        fresh.append(tree)
        if len(fresh) == KEEP and number + 1 < trees:
            recent = list(fresh)

            def moved(batches, recent=recent):
                for batch in batches:
                    m = margins(batch, _bins(batch, width), recent)
                    yield pa.RecordBatch.from_arrays([batch["bins"], batch["y"], batch["h"], pa.array(m)], ["bins", "y", "h", "margin"])

            newer = written(state.mapInArrow(moved, "bins binary, y double, h long, margin double"), "boosting")
            discard(state)
            state, fresh = newer, []
    discard(state)
    return model


def _splits(state, many, width, chosen, tree, open_, recent, margins, edges, number, seed, subsample, classes, heavy, l2, least) -> list:
    """The best split of each open node in each block of the chosen features, with the node's own sums."""
    place = {n: k for k, n in enumerate(open_)}
    blocks = [chosen[lo : lo + BLOCK] for lo in range(0, len(chosen), BLOCK)]
    deep = 1 + max((len(e) for e in edges), default=0)

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, len(open_), len(b), deep)) for b in blocks]
        for batch in batches:
            x = _bins(batch, width)
            keep = _drawn(batch["h"].to_numpy().view(np.int64), number, seed, subsample)
            at = tree.nodes(x, tree.cut)
            slot = np.array([place.get(n, -1) for n in range(len(tree.weight))])[at]
            rows = np.flatnonzero(keep & (slot >= 0))
            if not len(rows):
                continue
            m, y = margins(batch, x, recent)[rows], batch["y"].to_numpy()[rows]
            if classes:
                p, w = 1 / (1 + np.exp(-m)), np.where(y == 1, heavy, 1.0)
                g, h = (p - y) * w, p * (1 - p) * w
            else:
                g, h = m - y, np.ones(len(y))
            for b, into in zip(blocks, total):
                cell = (slot[rows][:, None] * len(b) + np.arange(len(b))) * deep + x[np.ix_(rows, b)]
                for k, v in enumerate((g, h)):
                    into[k] += np.bincount(cell.ravel(), weights=np.repeat(v, len(b)), minlength=into[k].size).reshape(into[k].shape)
        salt = TaskContext.get().partitionId() % FIRST
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks)), pa.int32()), pa.array([salt] * len(blocks), pa.int32()), pa.array([t.ravel() for t in total], pa.list_(pa.float64()))], ["block", "salt", "sums"])

    def added(t: pa.Table) -> pa.Table:
        lists = t["sums"].combine_chunks()
        s = lists.flatten().to_numpy().reshape(len(lists), -1).sum(0)
        return pa.table({"block": t["block"][:1], "salt": t["salt"][:1], "sums": pa.array([s], pa.list_(pa.float64()))})

    def best(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        s = added(t)["sums"].combine_chunks().flatten().to_numpy().reshape(2, len(open_), len(blocks[block]), deep)
        left = np.cumsum(s, axis=3)
        whole = left[:, :, :, -1:]
        gl, hl, gr, hr = left[0], left[1], whole[0] - left[0], whole[1] - left[1]
        gain = 0.5 * (gl**2 / (hl + l2) + gr**2 / (hr + l2) - whole[0] ** 2 / (whole[1] + l2))
        usable = np.arange(deep) < np.array([len(edges[f]) for f in blocks[block]])[:, None]
        gain = np.where(usable[None] & (hl >= least) & (hr >= least), gain, -np.inf)
        at = gain.reshape(len(open_), -1).argmax(1)
        f, b = np.divmod(at, deep)
        n = np.arange(len(open_))
        pick = lambda v: pa.array(np.ascontiguousarray(v[n, f, b]))
        return pa.table({"node": pa.array(open_, pa.int32()), "feature": pa.array(blocks[block][f], pa.int32()), "bin": pa.array(b, pa.int32()), "gain": pick(gain), "gl": pick(gl), "hl": pick(hl), "g": pa.array(np.ascontiguousarray(whole[0][n, f, 0])), "h": pa.array(np.ascontiguousarray(whole[1][n, f, 0]))})

    parts = state.mapInArrow(histograms, "block int, salt int, sums array<double>")
    if many:
        parts = parts.groupBy("block", "salt").applyInArrow(added, "block int, salt int, sums array<double>")
    return parts.groupBy("block").applyInArrow(best, "node int, feature int, bin int, gain double, gl double, hl double, g double, h double").collect()
