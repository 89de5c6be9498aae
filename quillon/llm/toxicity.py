"""Toxicity scores: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, U64, byte_slices, fold, mix, row_spans, sampled_rows, spare, table_of, word_hashes, words

#: A word is a run of letters and digits of ASCII, or of bytes above it.
WORDS = table_of([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def hashed(buf: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of every unigram, bigram and skip-gram (one word left out); lower case, rows in any order."""
    low = LOWER[buf]
    start, end, row = words(low, offs, WORDS)
    h = word_hashes(low, start, end)
    shift = U64(64 - bits)
    feats, rows = [h >> shift], [row]
    with np.errstate(over="ignore"):
        for gap, mul in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
            if len(h) > gap:
                same = row[gap:] == row[:-gap]
                feats.append(mix(h[:-gap] * U64(mul) + h[gap:])[same] >> shift)
                rows.append(row[gap:][same])
    return np.concatenate(feats).astype(np.int64), np.concatenate(rows)


def features_of(sample: DataFrame, bits: int) -> DataFrame:
    """text, label, order -> the document's distinct features and their counts."""

    def run(batches):
        for batch in batches:
            label = batch.column("label").to_pylist()
            for lo, hi, buf, offs in byte_slices(batch):
                f, r = hashed(buf, offs, bits)
                key, count = np.unique(r << 32 | f, return_counts=True)
                spans = row_spans(key >> 32, hi - lo)
                idx, count = (key & 0xFFFFFFFF).astype(np.int32), count.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(label[lo:hi], pa.int32()),
                        batch.column("order").slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array(idx)),
                        pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array(count)),
                    ],
                    names=["label", "order", "idx", "count"],
                )

    return sample.mapInArrow(run, "label int, order long, idx array<int>, count array<int>")


class Ftrl:
    """FTRL-proximal: z and n per coordinate; a weight is exactly 0 while |z| <= l1."""

    def __init__(self, bits: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.01):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias_z = self.bias_n = 0.0

    def weights(self, idx=slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def step(self, idx: np.ndarray, x: np.ndarray, y: float) -> None:
        w, b = self.weights(idx), self.bias
        p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
        g = (p - y) * x
        s = (np.sqrt(self.n[idx] + g * g) - np.sqrt(self.n[idx])) / self.alpha
        self.z[idx] += g - s * w
        self.n[idx] += g * g
        g = p - y
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g


def damp(count: np.ndarray) -> np.ndarray:
    return np.log1p(count)


class ToxicityModel:
    """weights: float32 table of 2^bits, mostly 0; its size is fixed, so a closure can carry it."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int):
        self.idx = np.flatnonzero(weights).astype(np.int64)
        self.val, self.bias, self.bits = weights[self.idx].astype(np.float32), float(bias), bits

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of each row; a row without words gets that of the bias."""
        if not hasattr(self, "_w"):
            self._w = np.zeros(1 << self.bits, np.float32)
            self._w[self.idx] = self.val
        f, r = hashed(buf, offs, self.bits)
        has = self._w[f] != 0  # only a few thousand features have a weight
        key, count = np.unique(r[has] << 32 | f[has], return_counts=True)
        z = np.bincount(key >> 32, self._w[key & 0xFFFFFFFF] * damp(count), len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -35, 35)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_w"}


def fit(sample: DataFrame, bits: int = 20, passes: int = 6, seed: int = 7, shift: float = 0.0) -> ToxicityModel:
    """Trains on every row of sample (text, label 0/1, order) in one executor task; the driver gets the weights alone.

    The rows are a bounded sample; the task holds their hashed counts, not their texts. `order` fixes the order of
    training, so that reruns agree. With no row, or one label only, the scores follow from the bias. `shift` is added to
    the learnt bias.
    """

    def run(batches):
        rows = []
        for batch in batches:
            idx, count = batch.column("idx"), batch.column("count")
            at, keys, times = idx.offsets.to_numpy(), idx.values.to_numpy(), count.values.to_numpy()
            rows += [(keys[lo:hi].copy(), times[lo:hi].copy(), float(y)) for lo, hi, y in zip(at[:-1], at[1:], batch.column("label").to_pylist())]
        model, rng = Ftrl(bits), np.random.default_rng(seed)
        for _ in range(passes):
            for k in rng.permutation(len(rows)):
                model.step(rows[k][0], damp(rows[k][1]), rows[k][2])
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], model.bias))], names=["idx", "weight"])

    got = features_of(sample, bits).repartition(1).sortWithinPartitions("order").mapInArrow(run, "idx long, weight double").toArrow()
    idx, w = got["idx"].to_numpy(), got["weight"].to_numpy()
    weights = np.zeros(1 << bits)
    weights[idx[idx >= 0]] = w[idx >= 0]
    return ToxicityModel(weights, w[idx < 0].sum() + shift, bits)


def score(df: DataFrame, model: ToxicityModel, keep: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """`keep` columns of df, score (0 to 1) and predicted (1 if score >= 0.5), under `names`.

    Texts of any length are read whole; null counts as empty, and an empty text gets the score of the bias.
    """
    if clash := {n.lower() for n in names} & {c.lower() for c in keep}:
        raise ValueError(f"other names are needed for {sorted(clash)}")
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches):
        for batch in batches:
            out = [model.score(buf, offs) for _, _, buf, offs in byte_slices(batch)]
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, *names])

    cols = list(dict.fromkeys([*keep, "text"]))
    return df.select(*cols).mapInArrow(run, schema)


def prior_shift(counts: dict[int, int], per_class: int) -> float:
    """What the bias lacks if at most per_class of the counted keys of each label are sampled: the log odds of all
    keys less those of the sample. 0 while no cap bites, or with one label only."""
    if not (counts.get(0) and counts.get(1)):
        return 0.0
    rate = {y: min(counts[y], per_class) / counts[y] for y in (0, 1)}
    return float(np.log(rate[0] / rate[1]))


def train(documents: DataFrame, labels: DataFrame, per_class: int = 3000, seed: int = 7, **how) -> ToxicityModel:
    """Fits on labelled documents outside the held-out fold (crc32 of doc_id modulo 5 is 0).

    At most `per_class` texts of each label are taken, those of the smallest key hash; the bound is for training only,
    and holds however often a doc_id repeats. Both labels are counted over all of them, and the bias is moved from the
    sample's class shares to these: the prior doesn't depend on the bound.
    """
    lab = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    lab = lab.withColumn("order", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    counts = {r["label"]: r["count"] for r in lab.groupBy("label").count().collect()}
    keys = None
    for y in (0, 1):
        part = lab.filter(F.col("label") == y).orderBy("order", "doc_id").limit(per_class)
        keys = part if keys is None else keys.unionByName(part)
    sample = sampled_rows(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), keys, ["label"], per_class, "order")
    return fit(sample.select("text", "label", "order"), seed=seed, shift=prior_shift(counts, per_class), **how)


def harmless(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the model, trained on the labelled ones among them, does not reject; all their columns.

    Rows with null or repeated doc_ids are judged by their own text; columns named like the scores stay as they are.
    """
    model = train(documents, labels)
    names = spare(documents.columns, "score"), spare(documents.columns, "predicted")
    return score(documents, model, documents.columns, names).filter(F.col(names[1]) == 0).drop(*names)


def op6(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null text counts as empty; rows with a null doc_id are scored, not learnt from, and not held out. Repeated rows are
    scored each and learnt from once; a doc_id that repeats with other texts is learnt from with each of them. Labels other than 0 and 1 are
    left out, and of two labels the larger counts. Other columns are ignored; an empty table gives an empty result, and
    without labels every score is 0.5.
    """
    model = train(documents, labels)
    docs = documents.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return score(docs, model, ["doc_id", "held_out"])
