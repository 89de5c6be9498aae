"""Models: probes of a representation, encoders, decoders and attacks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import mapped, matrix
from ..functions.hashing import hash_52
from ..sources.stored import written
from . import boosting, metrics, pairs, sampling, transforms
from .quantiles import quantiles

CLASSIFIERS = ("logistic", "forest", "boosting", "boosting_light", "boosting_balanced")
#: Of second-order boosting: rate, trees and the weight of class 1 (None: negatives to positives).
BOOSTED = {"boosting_light": (0.05, 200, 1.0), "boosting_balanced": (0.03, 400, None)}


#: The conditions of views that the attacker of each training condition reads.
ATTACKED = {"single": ["single"], "oracle": ["oracle", "link_selected", "random"]}


def binary_target(df: DataFrame, label: str, preferred: tuple[str, ...] = ("Atrial", "AFL", "AF", "Positive", "1")) -> tuple[DataFrame, str]:
    """df with y (1.0 for the positive label) and that label: the first preferred one there is, else the first by name."""
    name = F.col(label).cast("string")
    place = F.array_position(F.array(*map(F.lit, preferred)), name)
    row = df.agg(F.min(F.when(place > 0, place)).alias("place"), F.min(name).alias("least")).first()
    positive = preferred[row["place"] - 1] if row["place"] else row["least"]
    return df.withColumn("y", (F.col(label).cast("string") == positive).cast("double")), positive


def balanced_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """df with weight: n / (classes * n of the class)."""
    n = df.groupBy(F.col(y).alias("_y")).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    w = n.crossJoin(F.broadcast(total)).select("_y", (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))  # a row per class
    return df.join(F.broadcast(w), df[y] == F.col("_y")).drop("_y")


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("features", F.array(*(F.col(c).cast("double") for c in columns)))


def classifier(name: str, n: int, trees: int | None = None, seed: int = 42):
    """An unfitted MLlib classifier on features, y and weight; n, the training rows, sets the logistic penalty to C = 1."""
    cols = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
    if name == "logistic":
        return LogisticRegression(**cols, regParam=1 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=200)
    if name == "forest":
        return RandomForestClassifier(**cols, numTrees=trees or 300, minInstancesPerNode=2, maxDepth=30, seed=seed)
    if name == "boosting":
        return GBTClassifier(**cols, maxDepth=6, stepSize=0.05, maxIter=trees or 300, seed=seed)
    raise ValueError(f"{name}: not one of {CLASSIFIERS}")


def train(rows: DataFrame, name: str, key: str | None = None, trees: int | None = None, seed: int = 42):
    """A model of `name` for features (an array) and y; key decides which rows a boosted tree reads (none: the features).

    boosting_light and boosting_balanced are second-order boosting (200 trees at a rate of 0.05, or 400 at 0.03 with the
    classes in balance); the others are MLlib's, with balanced classes.
    """
    rows = rows.select("features", F.col("y").cast("double").alias("y"), (F.col(key) if key else F.xxhash64("features")).alias("key_"))
    if name in BOOSTED:
        rate, rounds, heavy = BOOSTED[name]
        return boosting.fit(rows, "features", "y", "key_", trees=trees or rounds, rate=rate, positive_weight=heavy, seed=seed)
    weighted = balanced_weights(rows.select(array_to_vector("features").alias("features"), "y"))
    return classifier(name, rows.count(), trees, seed).fit(weighted)


def score(model, df: DataFrame) -> DataFrame:
    """df with score, the probability of class 1, from its features (an array)."""
    if isinstance(model, boosting.Boosted):
        return model.predict(df, "features")
    out = model.transform(df.withColumnRenamed("features", "array_").withColumn("features", array_to_vector("array_")))
    return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("probability", "rawPrediction", "prediction", "features").withColumnRenamed("array_", "features")


def probe(known: DataFrame, test: DataFrame, columns: list[str], label: str, name: str = "logistic", trees: int | None = None, seed: int = 42) -> DataFrame:
    """test with y, label (0/1) and score, from a model of known rows alone: imputed, scaled, classes balanced."""
    known, positive = binary_target(known, label)
    test = test.withColumn("y", (F.col(label).cast("string") == positive).cast("double"))
    fitted = transforms.fit(known, columns, "standard")
    model = train(assembled(fitted.transform(known), columns), name, trees=trees, seed=seed)
    out = score(model, assembled(fitted.transform(test), columns)).withColumn("label", F.col("y").cast("int")).drop("features")
    return written(out, "scored")  # measures read it several times


def utility(df: DataFrame, group: str, columns: list[str], label: str, names: list[str] = ("logistic",), test: float = 0.2, seed: int = 42, trees: int | None = None) -> DataFrame:
    """One row per model: exact curve metrics and confusion metrics at 0.5 and at the best threshold of a validation part."""
    parts = sampling.three_way_split(df, group, test, 0.2, seed)
    rows = written(df.join(parts.withColumnRenamed("part", "part_"), group).select(*df.columns, "part_"), "split")  # each fit reads it many times
    side = lambda p: rows.filter(F.col("part_").isin(*p)).drop("part_")
    out = None
    for name in names:
        val = probe(side(["train"]), side(["val"]), columns, label, name, trees, seed)
        best = metrics.best_threshold(val).first()
        judged = probe(side(["train", "val"]), side(["test"]), columns, label, name, trees, seed).select("label", "score")
        m = metrics.curve_metrics(judged).crossJoin(metrics.confusion(judged, F.col("score") >= 0.5)).crossJoin(metrics.confusion(judged, F.col("score") >= best["threshold"]).select(F.col("f1").alias("tuned_f1")))  # one row each
        m = m.withColumn("model", F.lit(name)).withColumn("threshold", F.lit(best["threshold"]))
        out = m if out is None else out.unionByName(m)
    return out


class PairAttacker:
    """Scores pairs by their features (an array), which are imputed and scaled as the training pairs say."""

    def __init__(self, train_pairs: DataFrame, name: str = "boosting_light", trees: int | None = 20, seed: int = 42):
        self.scale = transforms.fit_vectors(train_pairs, "features")
        rows = self.scale.transform(train_pairs, "features", "features").select("features", F.col("pair_label").alias("y"))
        self.model = train(rows, name, trees=trees, seed=seed)

    def score(self, pairs_: DataFrame) -> DataFrame:
        """pairs_ with score, without features."""
        return score(self.model, self.scale.transform(pairs_, "features", "features")).drop("features")


def linkability(train_pairs: DataFrame, test_pairs: DataFrame, name: str = "boosting_light", trees: int | None = 20, seed: int = 42) -> DataFrame:
    """test_pairs with label and score of an attacker trained on train_pairs (features array, pair_label)."""
    out = PairAttacker(written(train_pairs, "pairs"), name, trees, seed).score(test_pairs)
    return written(out, "scored").withColumn("label", F.col("pair_label"))


def linkability_attack(segments: DataFrame, key: str, record: str, ref: str, vector: str, most: int = 2000, name: str = "boosting_light", trees: int | None = 20, strategy: str = "random", seed: int = 42) -> DataFrame:
    """One row of curve metrics: pairs of training records fit the attacker, pairs of held-out records judge it."""
    held = written(sampling.group_holdout(segments, record, 0.3, seed), "held")
    side = lambda t: segments.join(held.filter(F.col("is_test") == t).select(record), record, "left_semi")
    features = {}
    for k, t in enumerate((False, True)):
        s = side(t)
        features[t] = pairs.pair_features(pairs.pair_table(s, key, record, ref, most, strategy=strategy, vector=vector, seed=seed + k), s, key, vector)
    return metrics.curve_metrics(linkability(features[False], features[True], name, trees, seed))


def linkability_runs(segments: DataFrame, key: str, record: str, ref: str, vector: str, names: list[str], seeds: list[int], **how) -> DataFrame:
    """model, seed and the curve metrics of an attack of each model on the split and the pairs of each seed."""
    runs = (linkability_attack(segments, key, record, ref, vector, name=n, seed=s, **how).select(F.lit(n).alias("model"), F.lit(s).alias("seed"), "*") for n in names for s in seeds)
    return reduce(DataFrame.unionByName, runs)


def utility_runs(df: DataFrame, group: str, subsets: dict[str, list[str]], label: str, names: list[str], seeds: list[int], **how) -> DataFrame:
    """subset, seed and the rows of `utility` for each named set of columns on the split of each seed."""
    runs = (utility(df, group, c, label, names, seed=s, **how).select(F.lit(n).alias("subset"), F.lit(s).alias("seed"), "*") for n, c in subsets.items() for s in seeds)
    return reduce(DataFrame.unionByName, runs)


def permutation_importance(known: DataFrame, test: DataFrame, columns: list[str], label: str, key: str, repeats: int = 5, name: str = "logistic", trees: int | None = None, seed: int = 42) -> DataFrame:
    """column, importance: the mean loss of ROC-AUC when the column's values are dealt anew among the rows, by hash.

    A row gets one new value a column and repeat. In a batch one column after another is swapped in place and scored, so
    that a vector is held once and not once a column and repeat. `name` is logistic or one of second-order boosting.
    """
    known, positive = binary_target(known, label)
    fitted = transforms.fit(known, columns, "standard")
    model = train(assembled(fitted.transform(known), columns), name, trees=trees, seed=seed)
    predict = scorer(model)
    test = fitted.transform(test.withColumn("y", (F.col(label).cast("string") == positive).cast("double")), key).select(key, "y", F.array(*columns).alias("x"))
    base = sampling.ranked(test, hash_52(key, seed=seed), ties=[key]).select("rank_", "y", "x")
    # Of each column and repeat the values in an order of its own; the row of the same rank gets them.
    long = test.select(key, F.posexplode("x").alias("i", "new")).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    dealt = sampling.ranked(long, hash_52(key, "i", "repeat", seed=seed), by=["i", "repeat"], ties=[key]).select("rank_", "i", "repeat", "new")
    dealt = dealt.groupBy("rank_").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "repeat", "new"))), lambda s: s["new"]).alias("new"))  # columns x repeats
    width = len(columns)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x, new = matrix(part["x"], width).copy(), matrix(part["new"], width * repeats)
                out = np.empty((len(x), 1 + width * repeats))
                out[:, 0] = predict(x)
                for i in range(width):
                    own = x[:, i].copy()
                    for r in range(repeats):
                        x[:, i] = new[:, i * repeats + r]
                        out[:, 1 + i * repeats + r] = predict(x)
                    x[:, i] = own
                yield pa.RecordBatch.from_arrays([part["y"], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))], ["y", "scores"])

    rows = dealt.join(base, "rank_").select("y", "x", "new").mapInArrow(run, "y double, scores array<double>")
    scored = rows.select(F.col("y").cast("int").alias("label"), F.posexplode("scores").alias("at", "score"))
    auc = metrics.curve(scored, by=["at"]).groupBy("at").agg(metrics.roc_auc().alias("auc"))
    losses = auc.groupBy().agg(F.max(F.when(F.col("at") == 0, F.col("auc"))).alias("whole"), F.collect_list(F.when(F.col("at") > 0, F.struct("at", "auc"))).alias("all"))  # a row a column and repeat
    names = F.array(*map(F.lit, columns))
    return losses.select("whole", F.explode("all").alias("r")).groupBy(F.get(names, F.expr(f"cast((r.at - 1) div {repeats} as int)")).alias("column")).agg(F.avg(F.col("whole") - F.col("r.auc")).alias("importance"))


def scorer(model):
    """The model's probability of class 1 as a function of a numpy matrix: of a logistic or boosted model."""
    if isinstance(model, boosting.Boosted):
        return lambda x: 1 / (1 + np.exp(-model.margin(x)))
    if not hasattr(model, "coefficients"):
        raise ValueError("only logistic and second-order boosted models are scored in batches")
    w, b = model.coefficients.toArray(), float(model.intercept)
    return lambda x: 1 / (1 + np.exp(-(x @ w + b)))


def model_importance(model, columns: list[str]) -> list[tuple[str, float]]:
    """Coefficients' sizes, impurity importances or shares of gains, greatest first."""
    v = model.importance() if isinstance(model, boosting.Boosted) else np.abs(model.coefficients.toArray()) if hasattr(model, "coefficients") else model.featureImportances.toArray()
    return sorted(zip(columns, map(float, v)), key=lambda x: (-x[1], x[0]))


def in_one_task(rows: DataFrame, fit) -> list[tuple[np.ndarray, np.ndarray]]:
    """The layers that `fit` makes of x and y, matrices of a bounded sample (x, y, o, key), in the order of o and key.

    It runs in a task of its own: the driver gets the layers only.
    """

    def run(batches):
        t = pa.Table.from_batches(list(batches), schema=None).sort_by([("o", "ascending"), ("k", "ascending")])
        x, y = (matrix(t[c], len(t[c][0].as_py())) for c in ("x", "y"))
        layers = fit(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([w.shape[0] for w, _ in layers], pa.int32()), pa.array([w.ravel() for w, _ in layers], pa.list_(pa.float64())), pa.array([b for _, b in layers], pa.list_(pa.float64()))], ["n", "w", "b"])

    found = rows.coalesce(1).mapInArrow(run, "n int, w array<double>, b array<double>").collect()
    return [(np.array(r["w"]).reshape(r["n"], -1), np.array(r["b"])) for r in found]


def encoder(known: DataFrame, columns: list[str], label: str, key: str, dim: int = 8, hidden: int = 128, rows: int = 40_000, epochs: int = 60, seed: int = 42):
    """A supervised encoder: (fitted scaling, layers of weights and bias, labels). The layers are relu units of sizes
    `hidden` and `dim`, and a linear one with an output a label.

    Trained in a task by Adam with early stopping on at most `rows` rows, by hash of key, as even over the labels as they
    allow.
    """
    fitted = transforms.fit(known, columns, "standard")
    labels = [r[0] for r in known.select(label).distinct().orderBy(label).collect()]
    sample = sampling.balanced_sample(known, key, label, rows, len(labels), seed)
    y = F.array(*((F.col(label) == v).cast("double") for v in labels))
    data = fitted.transform(sample).select(F.array(*columns).alias("x"), y.alias("y"), hash_52(key, seed=seed).alias("o"), F.col(key).alias("k"))
    layers = in_one_task(data, lambda x, y: mlp(x, y, (hidden, dim), epochs, classes=True, patience=10, seed=seed))
    return fitted, layers, labels


def _forward(layers, last: int):
    """x -> the output of the layers up to `last`, relu units but for the final one."""

    def run(x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(layers[:last]):
            x = x @ w + b
            x = np.maximum(x, 0) if k < len(layers) - 1 else x
        return x

    return run


def embedded(df: DataFrame, columns: list[str], fitted: transforms.Fitted, layers, keep: list[str], prefix: str = "enc") -> DataFrame:
    """keep and the encoder's last hidden layer, in Arrow batches."""
    f, dim = _forward(layers, len(layers) - 1), len(layers[-2][1])

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(f(np.stack(s.to_list())))) if len(s) else pd.Series([], dtype=object)

    out = fitted.transform(df).select(*keep, run(F.array(*columns)).alias("e"))
    return out.select(*keep, *(F.get("e", F.lit(k)).alias(f"{prefix}_{k:03d}") for k in range(dim)))


def encoder_scores(df: DataFrame, columns: list[str], fitted: transforms.Fitted, layers, labels: list, positive, keep: list[str]) -> DataFrame:
    """keep and score, the encoder's own probability of the positive label: it judged directly, without a probe."""
    f, at = _forward(layers, len(layers)), labels.index(positive)

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        z = f(np.stack(s.to_list())) if len(s) else np.zeros((0, len(labels)))
        z = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return pd.Series(z[:, at] / z.sum(1))

    return fitted.transform(df).select(*keep, run(F.array(*columns)).alias("score"))


def ridge(df: DataFrame, x: list[str], y: list[str], alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (y, x) and intercepts of a multi-output ridge: sums of products, solved on the driver."""
    n, m, c = transforms.covariance(df, [*x, *y])
    c, p = c * n, len(x)
    w = np.linalg.solve(c[:p, :p] + alpha * np.eye(p), c[:p, p:]).T
    return w, m[p:] - w @ m[:p]


def ridge_predict(df: DataFrame, x: list[str], w: np.ndarray, b: np.ndarray, names: list[str]) -> DataFrame:
    """df with the estimates, by a product of matrices in Arrow batches; a row with a null in x has NaN."""
    out = mapped(df.withColumn("_x", F.array(*(F.col(c).cast("double") for c in x))), "_x", "_x", lambda v: v @ w.T + b, len(x))
    return out.select(*df.columns, *(F.get("_x", F.lit(k)).alias(n) for k, n in enumerate(names)))


def mlp(x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...], epochs: int = 60, rate: float = 1e-3, batch: int = 128, classes: bool = False, patience: int | None = None, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """A relu network for several outputs, by Adam, on a bounded sample; layers of (weights, bias).

    Squared errors, or with `classes` cross-entropy over the outputs. With `patience` a tenth of the rows is held back;
    training ends after so many epochs without a better loss on it, and the best layers count.
    """
    rng = np.random.default_rng(seed)
    sizes = [x.shape[1], *hidden, y.shape[1]]
    layers = [[rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)] for a, b in zip(sizes, sizes[1:])]
    state, step = [[np.zeros_like(p), np.zeros_like(p)] for layer in layers for p in layer], 0
    rows = rng.permutation(len(x)) if patience else np.arange(len(x))
    held, rows = (rows[: len(x) // 10], rows[len(x) // 10 :]) if patience else (rows[:0], rows)
    best, kept, since = np.inf, None, 0

    def outputs(at):
        acts = [x[at]]
        for i, (w, b) in enumerate(layers):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0) if i < len(layers) - 1 else z)
        if classes:
            z = np.exp(acts[-1] - acts[-1].max(1, keepdims=True))
            acts[-1] = z / z.sum(1, keepdims=True)
        return acts

    for _ in range(epochs):
        order = rows[rng.permutation(len(rows))]
        for k in range(0, len(rows), batch):
            at, step = order[k : k + batch], step + 1
            acts = outputs(at)
            d, grads = (1 if classes else 2) * (acts[-1] - y[at]) / len(at), []
            for i in range(len(layers) - 1, -1, -1):
                grads[:0] = [acts[i].T @ d, d.sum(0)]
                d = (d @ layers[i][0].T) * (acts[i] > 0)
            for p, g, s in zip([p for layer in layers for p in layer], grads, state):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                p -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
        if len(held):
            z = outputs(held)[-1]
            loss = float(-(y[held] * np.log(z + 1e-12)).sum(1).mean() if classes else ((z - y[held]) ** 2).mean())
            since = 0 if loss < best - 1e-4 else since + 1
            if loss < best:
                best, kept = loss, [(w.copy(), b.copy()) for w, b in layers]
            if since >= patience:
                break
    return kept or [(w, b) for w, b in layers]


def attribute_attack(known: DataFrame, test: DataFrame, columns: list[str], target: str, regression: bool = False, trees: int = 20, seed: int = 42, by: list[str] = ()) -> DataFrame:
    """How well an attribute is inferred from views, beside the constant baseline of the known rows: one row, or one for
    each group `by` of the test rows. The attacker, second-order boosting, is fitted once; classes are in balance."""
    by = list(by)
    known, test = known.filter(F.col(target).isNotNull()), test.filter(F.col(target).isNotNull())
    known = written(known.select(target, *columns), "known")
    fitted = transforms.fit(known, columns, "standard")
    a = assembled(fitted.transform(known), columns).select("features", F.col(target).cast("double").alias("y"), F.xxhash64("features").alias("key_"))
    b = assembled(fitted.transform(test), columns).select(*by, "features", F.col(target).cast("double").alias("y"))
    side = lambda x, y: x.join(y, by) if by else x.crossJoin(y)  # noqa: E731 (one row each)
    model = boosting.fit(a, "features", "y", "key_", classes=not regression, trees=trees, seed=seed)
    out = written(model.predict(b, "features", "prediction" if regression else "score"), "scored")
    if regression:
        middle = quantiles(a, [F.col("y")], [0.5])[0][0] or 0.0
        out = out.withColumn("constant", F.lit(middle))
        return side(metrics.regression(out, "y", "prediction", by), metrics.regression(out, "y", "constant", by).select(*by, F.col("mae").alias("constant_mae")))
    out = out.withColumn("label", F.col("y").cast("int")).select(*by, "label", "score")
    share = a.agg(F.avg("y").alias("m")).first()["m"] or 0.0
    constant = metrics.confusion(out, F.lit(share >= 0.5), by=by).select(*by, F.col("balanced_accuracy").alias("constant_balanced_accuracy"))
    return side(side(metrics.confusion(out, F.col("score") >= 0.5, by=by), metrics.curve_metrics(out, by)), constant)


def attribute_under_conditions(known: dict[str, DataFrame], views: DataFrame, columns: list[str], target: str, **how) -> DataFrame:
    """train_condition, condition and the measures of attribute_attack, of two attackers.

    known has the training rows of the attacker on single segments (`single`) and of that on whole groups (`oracle`).
    The first reads the single views, the second those of the true, the linked and the random group. views: condition,
    x (an array) and the target, of records that are not in known.
    """
    rows = views.select("condition", target, *(F.get("x", F.lit(k)).alias(n) for k, n in enumerate(columns)))
    parts = [attribute_attack(known[t], rows.filter(F.col("condition").isin(c)), columns, target, by=["condition"], **how).select(F.lit(t).alias("train_condition"), "*") for t, c in ATTACKED.items()]
    return reduce(DataFrame.unionByName, parts)
