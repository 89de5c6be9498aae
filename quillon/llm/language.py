"""Language of texts by a bidirectional gated recurrent network over bytes, trained in numpy.

The text is read in segments of fixed length, from both ends of each; every byte gets class probabilities, and a text's
are the mean over its letters. Training is backpropagation through time over a bounded sample of text windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, fold, row_sums, sampled_rows, table_of

LETTER = table_of([*range(65, 91), *range(97, 123), *range(128, 256)])
f32 = np.float32


def _sigmoid(x):
    return f32(0.5) * np.tanh(f32(0.5) * x) + f32(0.5)


class Gru:
    """One direction. The input weights are a table of 256 rows: a byte's embedding times the input matrix."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.w = rng.normal(0, 0.3, (256, 3 * hidden)).astype(f32)
        self.u = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(f32)

    def step(self, x: np.ndarray, h: np.ndarray):
        """x: rows of w. Gates z and r, candidate n."""
        k = self.h
        a = h @ self.u
        g = _sigmoid(x[:, : 2 * k] + a[:, : 2 * k])
        z, r = g[:, :k], g[:, k:]
        n = np.tanh(x[:, 2 * k :] + r * a[:, 2 * k :])
        return n + z * (h - n), z, r, n, a[:, 2 * k :]

    def run(self, codes: np.ndarray, start: np.ndarray, alive: np.ndarray, times, each) -> None:
        """Reads codes[start + t] for t in times; the first alive[t] lanes are longer than t. each(t, states).

        The same step as above, a row for each unit, in place.
        """
        k, n = self.h, len(start)
        wt, ut = np.ascontiguousarray(self.w.T), np.ascontiguousarray(self.u.T)
        wt[: 2 * k] *= f32(0.5)
        ut[: 2 * k] *= f32(0.5)
        h, x, a = np.zeros((k, n), f32), np.empty((3 * k, n), f32), np.empty((3 * k, n), f32)
        last = n
        for t in times:
            m = int(alive[t])
            if m != last:  # narrower or wider arrays, so that they stay dense
                old, h = h, np.zeros((k, m), f32)
                h[:, : min(m, last)] = old[:, : min(m, last)]
                x, a, last = np.empty((3 * k, m), f32), np.empty((3 * k, m), f32), m
            np.take(wt, codes[start[:m] + t], axis=1, out=x, mode="clip")
            np.matmul(ut, h, out=a)
            g, n_ = x[: 2 * k], x[2 * k :]
            g += a[: 2 * k]
            np.tanh(g, out=g)
            g *= f32(0.5)
            g += f32(0.5)
            a[2 * k :] *= g[k:]
            n_ += a[2 * k :]
            np.tanh(n_, out=n_)
            h -= n_
            h *= g[:k]
            h += n_
            each(t, h)

    def forward(self, b: np.ndarray) -> tuple[np.ndarray, list]:
        """b: bytes (time, lanes) -> states (time, lanes, hidden), and what backward needs."""
        h = np.zeros((b.shape[1], self.h), f32)
        out, kept = np.empty((*b.shape, self.h), f32), []
        for t in range(len(b)):
            new, *rest = self.step(self.w[b[t]], h)
            kept.append((h, *rest))
            out[t] = h = new
        return out, kept

    def backward(self, b: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of w and u from those of the states."""
        k, dh = self.h, np.zeros_like(dout[0])
        dx = np.empty((*b.shape, 3 * k), f32)
        du = np.zeros_like(self.u)
        for t in range(len(b) - 1, -1, -1):
            h, z, r, n, an = kept[t]
            dh = dh + dout[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            du += h.T @ da
            dh = dh * z + da @ self.u.T
        dw = np.zeros_like(self.w)
        np.add.at(dw, b.ravel(), dx.reshape(-1, 3 * k))
        return dw, du


class LanguageModel:
    def __init__(self, classes: list[str], hidden: int = 6, segment: int = 256, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes, self.segment = classes, segment
        self.to_right, self.to_left = Gru(hidden, rng), Gru(hidden, rng)
        self.v = rng.normal(0, 0.1, (2 * hidden, len(classes))).astype(f32)
        self.c = np.zeros(len(classes), f32)

    def params(self) -> list[np.ndarray]:
        return [self.to_right.w, self.to_right.u, self.to_left.w, self.to_left.u, self.v, self.c]

    def gradients(self, b: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions of the windows b (time, lanes) with classes y, and its gradients."""
        right, kr = self.to_right.forward(b)
        left, kl = self.to_left.forward(b[::-1])
        both = np.concatenate([right, left[::-1]], axis=2)
        logit = both @ self.v + self.c
        p = np.exp(logit - logit.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        lane = np.arange(b.shape[1])
        loss = float(-np.log(p[:, lane, y] + 1e-9).mean())
        p[:, lane, y] -= 1
        d = p / f32(b.size)
        dv = np.tensordot(both, d, ([0, 1], [0, 1]))
        dboth = d @ self.v.T
        k = self.to_right.h
        gr = self.to_right.backward(b, kr, dboth[:, :, :k])
        gl = self.to_left.backward(b[::-1], kl, dboth[::-1, :, k:])
        return loss, [*gr, *gl, dv, d.sum((0, 1))]

    def train(self, texts: list[bytes], y: np.ndarray, steps: int = 400, lanes: int = 192, length: int = 48, rate: float = 0.02, seed: int = 5) -> float:
        """Adam over windows of the texts, classes equally often. Returns the last mean loss."""
        rng, params = np.random.default_rng(seed), self.params()
        m, v, loss = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0.0
        of = [np.flatnonzero(y == k) for k in range(len(self.classes))]
        of = [k for k in of if len(k)]
        for step in range(1, steps + 1):
            pick = np.array([rng.choice(of[j % len(of)]) for j in range(lanes)])
            b = np.full((lanes, length), 32, np.uint8)
            for j, k in enumerate(pick):
                t = texts[k]
                at = rng.integers(0, max(1, len(t) - length + 1))
                t = t[at : at + length]
                b[j, : len(t)] = np.frombuffer(t, np.uint8)
            loss, grads = self.gradients(np.ascontiguousarray(b.T), y[pick])
            now = rate * min(1, 2 * (1 - step / (steps + 1)))
            for p, g, mm, vv in zip(params, grads, m, v):
                mm *= 0.9
                mm += 0.1 * g
                vv *= 0.98
                vv += 0.02 * g * g
                p -= (now * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.98**step)) + 1e-8)).astype(f32)
        return loss

    def probabilities(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean class probabilities over the letters of each row; zeros for a row without."""
        n, many = len(offs) - 1, len(self.classes)
        size = np.diff(offs)
        pieces = -(-size // self.segment)
        row = np.repeat(np.arange(n), pieces)
        k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offs[:-1][row] + k * self.segment
        length = np.minimum(self.segment, offs[1:][row] - start)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        logit = np.zeros((many, len(buf)), f32)
        if len(start):
            alive = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right")
            for gru, v, times in ((self.to_right, self.v[: self.to_right.h], range(int(length[0]))), (self.to_left, self.v[self.to_right.h :], range(int(length[0]) - 1, -1, -1))):
                vt = np.ascontiguousarray(v.T)

                def each(t, h):
                    pos = start[: h.shape[1]] + t
                    for j, z in enumerate(vt @ h):
                        logit[j][pos] += z

                gru.run(buf, start, alive, times, each)
        logit += self.c[:, None]
        p = np.exp(logit - logit.max(0)) if many else logit
        letter = LETTER[buf]
        p *= letter / p.sum(0)
        sums = np.column_stack([row_sums(p[j].astype(float), offs) for j in range(many)]) if many else np.zeros((n, 0))
        return sums / np.maximum(row_sums(letter, offs), 1)[:, None]


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each row has a letter, of any script."""
    sure = table_of([*range(65, 91), *range(97, 123)])
    out, maybe = row_sums(sure[buf], offs) > 0, row_sums(buf >= 128, offs) > 0
    for k in np.flatnonzero(~out & maybe):
        out[k] = any(c.isalpha() for c in buf[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def train(documents: DataFrame, per_language: int = 400, most: int = 40_000, windows: int = 3, window: int = 256, hidden: int = 6, seed: int = 5, **how) -> LanguageModel:
    """Fits on text and lang of documents outside the held-out fold (crc32 of doc_id modulo 5 is 0), in one executor task.

    At most `per_language` texts of each language are sampled and about `most` in all, those of the smallest key hash,
    and `windows` pieces of `window` characters of each, from places all over the text; the bounds are for training only,
    and hold however often a doc_id repeats. The sample is cut in 16 parts of each language before it is cut in the
    language, so that no task sees all rows of one.
    """
    docs = documents.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0))
    classes = sorted(r[0] for r in docs.select("lang").distinct().collect())
    model = LanguageModel(classes, hidden, seed=seed)
    if len(classes) < 2:
        return model
    per_language = max(1, min(per_language, most // len(classes)))
    order = F.xxhash64("doc_id", F.lit(seed))
    first = lambda d, *by: d.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("order", "doc_id"))).filter(F.col("n") <= per_language).drop("n")
    keys = docs.select("doc_id", "lang", order.alias("order"), F.pmod(order, F.lit(16)).alias("part"))
    keys = first(first(keys, "lang", "part"), "lang").select("doc_id", "lang", "order").distinct()
    size = F.length("text")
    piece = F.explode(F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.substring("text", (F.pmod(F.xxhash64("order", k), F.greatest(size - window, F.lit(0)) + 1) + 1).cast("int"), F.lit(window)))).alias("piece")
    sample = sampled_rows(docs.withColumn("text", F.struct("text", "lang")), keys, ["lang"], per_language, "order").filter(F.col("text.lang") == F.col("lang"))
    sample = sample.select("lang", "order", F.col("text.text").alias("text")).select("lang", "order", piece)

    def run(batches):
        got = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("lang", "order", "piece")))]
        rows = sorted(got)
        model.train([r[2].encode() for r in rows], np.array([classes.index(r[0]) for r in rows]), **how)
        yield pa.RecordBatch.from_arrays([pa.array([p.ravel() for p in model.params()], pa.list_(pa.float32()))], names=["p"])

    learnt = sample.coalesce(1).mapInArrow(run, "p array<float>").collect()
    for p, r in zip(model.params(), learnt):
        p[...] = np.array(r["p"], f32).reshape(p.shape)
    return model


def predict(documents: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """`keep` columns of documents, lang_pred and score, the mean probability of that language over the letters.

    A text that is null or has no letter gets `und` and 0.
    """
    schema = T.StructType([*(documents.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = np.array([*model.classes, "und"], object)

    def run(batches):
        for batch in batches:
            label, score = [np.zeros(0, object)], [np.zeros(0)]
            for _, _, buf, offs in byte_slices(batch, limit=1 << 20):
                p = model.probabilities(buf, offs)
                ok = has_letter(buf, offs) & (p.shape[1] > 0)
                best = p.argmax(1) if p.shape[1] else np.zeros(len(p), int)
                label.append(names[np.where(ok, best, len(names) - 1)])
                score.append(np.clip(np.where(ok, p.max(1) if p.shape[1] else 0.0, 0.0), 0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.concatenate(label), pa.string()), pa.array(np.concatenate(score).astype(float))], names=[*keep, "lang_pred", "score"])

    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op3(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, gets `und` and 0. Rows with a null doc_id are predicted, not learnt from, and
    not held out; repeated rows are rows each, texts of any length are read whole, other columns are ignored. An empty
    table gives an empty result; with one language learnt, that is the prediction.
    """
    model = train(documents)
    docs = documents.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return predict(docs, model, ["doc_id", "held_out"])
