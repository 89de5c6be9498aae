"""Quality scores: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, U64, byte_slices, fold, mix, row_spans, row_sums, table_of, word_hashes, words, written

NAMES = ("log_bytes", "word_len", "word_len_sd", "upper", "symbol", "digit", "bars", "beyond_ascii", "line_len", "repeated_lines", "repeated_words", "repeated_trigrams", "short_words", "symbol_ends", "long_words", "sentence_ends")
UPPER, DIGIT, LETTER = table_of(range(65, 91)), table_of(range(48, 58)), table_of([*range(65, 91), *range(97, 123)])
SYMBOL = table_of([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'\"-;:()"])
NOT_LINE_END = ~table_of(b"\n\r")


def _repeated(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Share of the weight of each row's items that have an earlier equal item."""
    key = mix(h ^ (row.astype(U64) * U64(0x9E3779B97F4A7C15)))
    _, first = np.unique(key, return_index=True)
    all_ = np.bincount(row, weight, n)
    return 1 - np.bincount(row[first], weight[first], n) / np.maximum(all_, 1)


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """len(NAMES) numbers of each row, by log or square root on a like scale; an empty text gives 0 everywhere."""
    n, size = len(offs) - 1, np.diff(offs).astype(float)
    share = lambda t, by: row_sums(t[buf], offs) / np.maximum(by, 1)
    start, end, row = words(buf, offs)
    length = (end - start).astype(float)
    spans = row_spans(row, n)
    count = np.diff(spans).astype(float)
    many = np.maximum(count, 1)
    mean = row_sums(length, spans) / many
    sd = np.sqrt(np.maximum(row_sums(length**2, spans) / many - mean**2, 0))
    h = word_hashes(LOWER[buf], start, end)
    with np.errstate(over="ignore"):
        tri = h[:-2] * U64(0xA0761D6478BD642F) + mix(h[1:-1] * U64(3) + h[2:]) if len(h) > 2 else h[:0]
    same = row[:-2] == row[2:] if len(h) > 2 else np.zeros(0, bool)
    ls, le, lrow = words(buf, offs, NOT_LINE_END)
    lines = np.maximum(np.bincount(lrow, minlength=n), 1)
    last = buf[end - 1] if len(end) else buf[:0]
    per_word = lambda flag: row_sums(flag, spans) / many
    out = np.column_stack([
        np.log1p(size), mean, sd, share(UPPER, row_sums(LETTER[buf], offs)), share(SYMBOL, size), share(DIGIT, size),
        share(table_of(b"|"), size), share(table_of(range(128, 256)), size), np.log1p(size / lines),
        _repeated(lrow, word_hashes(buf, ls, le), (le - ls).astype(float), n), _repeated(row, h, np.ones(len(h)), n) / np.sqrt(np.log1p(many) + 1),
        _repeated(row[:-2][same] if len(h) > 2 else row[:0], tri[same], np.ones(int(same.sum())), n), per_word(length <= 2), per_word(SYMBOL[last]), per_word(length > 20), per_word(table_of(b".!?")[last]),
    ])
    for k, name in enumerate(NAMES):
        if name not in ("log_bytes", "line_len", "word_len"):
            out[:, k] = np.sqrt(np.maximum(out[:, k], 0))
    out[size == 0] = 0
    return out


def with_statistics(df: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns of df and stats, an array of doubles in the order of NAMES. Null text counts as empty."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("stats", T.ArrayType(T.DoubleType(), False), False)])

    def run(batches):
        for batch in batches:
            out = [statistics(buf, offs) for _, _, buf, offs in byte_slices(batch)]
            x = np.concatenate(out) if out else np.zeros((0, len(NAMES)))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), arrays], names=[*keep, "stats"])

    return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def moments(stats: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """label -> (n, sum of x, sum of x x'), over every row of (label, stats); each task sends one row per label."""
    p = len(NAMES)

    def run(batches):
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = batch.column("stats").flatten().to_numpy().reshape(-1, p)
                z = np.column_stack([np.ones(len(x)), x])
                label = batch.column("label").to_numpy()
                for y in np.unique(label):
                    acc[int(y)] = acc.get(int(y), 0) + z[label == y].T @ z[label == y]
        for y, m in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([y] * m.size, pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())], names=["label", "k", "v"])

    part = stats.select("label", "stats").mapInArrow(run, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in part:
        out.setdefault(r["label"], np.zeros((p + 1) * (p + 1)))[r["k"]] = r["v"]
    return {y: (m[0], m[1 : p + 1], m.reshape(p + 1, p + 1)[1:, 1:]) for y, m in out.items()}


class Discriminant:
    """Class Gaussians with shrunk covariances; a Cholesky factor of each is kept for scoring."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1, pooled: float = 0.2):
        self.classes: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
        total = sum(n for n, _, _ in sums.values())
        p = len(NAMES)
        if not total:
            self.mean, self.scale = np.zeros(p), np.ones(p)
            return
        self.mean = sum(s for _, s, _ in sums.values()) / total
        var = sum(np.diag(c) for _, _, c in sums.values()) / total - self.mean**2
        self.scale = np.sqrt(np.maximum(var, 1e-8))
        cov = {y: (c / n - np.outer(s / n, s / n)) / np.outer(self.scale, self.scale) for y, (n, s, c) in sums.items()}
        within = sum(sums[y][0] * cov[y] for y in cov) / total
        for y, (n, s, _) in sums.items():
            c = (1 - pooled) * cov[y] + pooled * within
            c = (1 - shrink) * c + shrink * max(np.trace(c) / p, 1e-3) * np.eye(p)
            self.classes[y] = (np.log(n / total), (s / n - self.mean) / self.scale, np.linalg.cholesky(c))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; 0.5 without training rows, 0 or 1 where only that label was seen."""
        if len(self.classes) < 2:
            return np.full(len(x), 0.5 if not self.classes else float(next(iter(self.classes))))
        x, d = (x - self.mean) / self.scale, {}
        for y, (prior, mu, chol) in self.classes.items():
            z = np.linalg.solve(chol, (x - mu).T)
            d[y] = prior - 0.5 * (z**2).sum(0) - np.log(np.diag(chol)).sum()
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -35, 35)))


def scored(stats: DataFrame, model: Discriminant, keep: list[str], threshold: float = 0.7) -> DataFrame:
    schema = T.StructType([*(stats.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            s = model.score(batch.column("stats").flatten().to_numpy().reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return stats.mapInArrow(run, schema)


def op7(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Learns from every labelled row outside the held-out fold.

    Null text counts as empty, and an empty text is scored like others; texts of any length are read whole. Rows with a
    null doc_id are scored, not learnt from, and not held out. Repeated rows are rows each, in training too; of two
    labels of a doc_id the larger counts, and labels other than 0 and 1 are left out. Other columns are ignored. An
    empty table gives an empty result; without labels every score is 0.5.
    """
    stats = written(with_statistics(documents.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text"), ["doc_id", "held_out"]), "quality")
    lab = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    model = Discriminant(moments(stats.filter(~F.col("held_out")).join(lab, "doc_id")))
    return scored(stats, model, ["doc_id", "held_out"])
