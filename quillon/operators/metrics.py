"""Exact classification, ranking and regression metrics as aggregates.

Curves are built on counts per distinct score, and their running sums in two steps: within ranges of about equal numbers
of scores, then over the ranges, so that no single task sees all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import in_ranges, quantiles


def curve(df: DataFrame, y: str = "label", score: str = "score", by: list[str] = ()) -> DataFrame:
    """by, score, p and n (of this score), tp and fp (down to it), pos and neg (in all), for each distinct score."""
    by = list(by)
    s = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum((1 - F.col(y)).cast("long")).alias("n"))
    s = in_ranges(s, "score")
    parts = s.groupBy(*by, "part").agg(F.sum("p").alias("pp"), F.sum("n").alias("nn"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    above = w.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "part", F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("nn").over(above), F.lit(0)).alias("n0"), F.sum("pp").over(w).alias("pos"), F.sum("nn").over(w).alias("neg"))
    s = s.join(parts, [*by, "part"])
    down = Window.partitionBy(*by, "part").orderBy(F.desc("score"))
    return s.withColumn("tp", F.sum("p").over(down) + F.col("p0")).withColumn("fp", F.sum("n").over(down) + F.col("n0")).drop("part", "p0", "n0")


def roc_auc() -> Column:
    """Area under the ROC of a curve; ties count half. Null if a class is missing."""
    return F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.nullif(F.max("pos") * F.max("neg"), F.lit(0)).cast("double")


def average_precision() -> Column:
    return F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.max("pos"), F.lit(0)).cast("double")


def equal_error_rate() -> Column:
    """Mean of the two error rates where they are nearest (in whole numbers, so that ties are ties); the highest such score."""
    fpr, fnr = F.try_divide("fp", "neg"), 1 - F.try_divide("tp", "pos")
    n = lambda c: F.col(c).cast("decimal(19,0)")
    return F.min(F.struct(F.abs(n("fp") * n("pos") - (n("pos") - n("tp")) * n("neg")).alias("d"), (-F.col("score")).alias("s"), ((fpr + fnr) / 2).alias("e")))["e"]


def tpr_at_fpr(level: float) -> Column:
    return F.coalesce(F.max(F.when(F.try_divide("fp", "neg") <= level, F.try_divide("tp", "pos"))), F.lit(0.0))


def curve_metrics(df: DataFrame, by: list[str] = (), levels: tuple[float, ...] = (0.01, 0.1)) -> DataFrame:
    c = curve(df, by=by)
    return c.groupBy(*by).agg(roc_auc().alias("roc_auc"), average_precision().alias("average_precision"), equal_error_rate().alias("eer"), *(tpr_at_fpr(x).alias(f"tpr_at_fpr_{int(x * 1000):04d}") for x in levels))


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)).cast("double"), F.lit(0.0))


def confusion(df: DataFrame, predicted: Column, y: str = "label", by: list[str] = ()) -> DataFrame:
    """tp, fp, fn and tn, and accuracy, balanced accuracy, precision, recall, f1 and macro_f1."""
    yes, hit = F.col(y) == 1, predicted
    c = df.groupBy(*by).agg(*(F.count_if(x).alias(k) for k, x in (("tp", yes & hit), ("fp", ~yes & hit), ("fn", yes & ~hit), ("tn", ~yes & ~hit))))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    f1, f0 = _div(2 * tp, 2 * tp + fp + fn), _div(2 * tn, 2 * tn + fp + fn)
    return c.select("*", _div(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((_div(tp, tp + fn) + _div(tn, tn + fp)) / 2).alias("balanced_accuracy"), _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"), f1.alias("f1"), ((f1 + f0) / 2).alias("macro_f1"))


def best_threshold(df: DataFrame, y: str = "label", score: str = "score", thresholds: list[float] | None = None) -> DataFrame:
    """threshold and f1: the first of the thresholds (0.05 to 0.95 by default) with the greatest F1."""
    grid = thresholds or [round(0.05 * k, 2) for k in range(1, 20)]
    yes = F.col(y) == 1
    counts = [F.struct(F.lit(t).alias("threshold"), F.count_if(yes & (F.col(score) >= t)).alias("tp"), F.count_if(~yes & (F.col(score) >= t)).alias("fp"), F.count_if(yes & (F.col(score) < t)).alias("fn")) for t in grid]
    rows = df.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")  # a row a threshold
    rows = rows.select("threshold", _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    return rows.orderBy(F.desc("f1"), "threshold").limit(1)


def score_quantile_thresholds(df: DataFrame, score: str = "score", n: int = 19) -> list[float]:
    """Thresholds for scores on any scale: exact quantiles."""
    return quantiles(df, [F.col(score)], [k / (n + 1) for k in range(1, n + 1)])[0]


def regression(df: DataFrame, y: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """mae, rmse, r2 (null for a constant y) and n."""
    e = F.col(y) - F.col(predicted)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row with spearman, the correlation of average ranks; null where a side is constant."""

    def average_rank(d: DataFrame, c: str) -> DataFrame:
        counts = in_ranges(d.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("k")), "v")
        parts = counts.groupBy("part").agg(F.sum("k").alias("k_"))
        before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        parts = parts.select("part", F.coalesce(F.sum("k_").over(before), F.lit(0)).alias("before"))
        up = counts.join(F.broadcast(parts), "part")
        up = up.withColumn(f"r_{c}", F.col("before") + F.sum("k").over(Window.partitionBy("part").orderBy("v")) - (F.col("k") - 1) / 2)
        return d.join(up.select(F.col("v").alias(c), f"r_{c}"), c)

    rows = average_rank(average_rank(df.select(a, b).dropna(), a), b)
    return rows.agg(F.try_divide(F.covar_pop(f"r_{a}", f"r_{b}"), F.stddev_pop(f"r_{a}") * F.stddev_pop(f"r_{b}")).alias("spearman"))


def record_scores(df: DataFrame, record: str, y: str = "label", score: str = "score") -> DataFrame:
    """record, label, score: the mean score of a record's segments and its label."""
    return df.groupBy(record).agg(F.max(y).alias("label"), F.avg(score).alias("score"))
