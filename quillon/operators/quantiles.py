"""Exact quantiles of whole columns, and ranges of equal size for running sums, with bounded memory in every task."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import discard, written

#: Accuracy of the sketch: a bracket holds about 4/ACCURACY of the values in it.
ACCURACY = 10_000
#: Values of a bracket that are read at once; a larger bracket is narrowed again.
MOST = 20_000
#: Columns of one aggregate.
WIDE = 32
#: Steps of the sketch that narrows a key's bracket; a new one spans three of them.
MARKS = 256


def quantiles(df: DataFrame, columns: list[Column], levels: list[float]) -> list[list[float | None]]:
    """For each column its quantiles, by linear interpolation between order statistics; null for one without values.

    A mergeable sketch gives a bracket of values around each; the next scan counts what is below the bracket and reads
    what is in it, or narrows it again. No task and no aggregate holds more than MOST values of a bracket.
    """
    out: list[list[float | None]] = []
    for lo in range(0, len(columns), WIDE):
        part = columns[lo : lo + WIDE]
        rows = df.select(*(c.cast("double").alias(f"x{k}") for k, c in enumerate(part)))
        out += _quantiles(rows, len(part), levels)
    return out


def _quantiles(rows: DataFrame, width: int, levels: list[float]) -> list[list[float | None]]:
    counts = rows.agg(*(F.count(f"x{k}").alias(f"x{k}") for k in range(width))).first()
    found: dict[tuple[int, float], float | None] = {(k, p): None for k in range(width) for p in levels}
    # Of each wanted quantile: the bracket, what is below it and in it.
    todo = {(k, p): (None, None, 0, counts[f"x{k}"]) for k, p in found if counts[f"x{k}"]}
    while todo:
        def inside(key):
            x, (a, b, _, _) = F.col(f"x{key[0]}"), todo[key]
            return x if a is None else F.when((x >= a) & (x <= b), x)

        def marks(key):
            _, _, below, n = todo[key]
            first = floor((counts[f"x{key[0]}"] - 1) * key[1]) - below
            return [max(0.0, first / n - 3 / ACCURACY), min(1.0, (first + 1) / n + 3 / ACCURACY)]

        keys = list(todo)
        row = rows.agg(*(F.percentile_approx(inside(q), marks(q), ACCURACY).alias(f"q{j}") for j, q in enumerate(keys))).first()
        new = {q: tuple(row[f"q{j}"]) for j, q in enumerate(keys)}
        x = lambda q: F.col(f"x{q[0]}")
        row = rows.agg(*(e for j, q in enumerate(keys) for e in (F.count_if(x(q) < new[q][0]).alias(f"a{j}"), F.count_if((x(q) >= new[q][0]) & (x(q) <= new[q][1])).alias(f"n{j}"), F.min(F.when(x(q) > new[q][1], x(q))).alias(f"h{j}"), F.count_if(x(q) == new[q][0]).alias(f"e{j}"), F.min(F.when(x(q) > new[q][0], x(q))).alias(f"m{j}")))).first()
        read, again = {}, {}
        for j, q in enumerate(keys):
            n, below = counts[f"x{q[0]}"], row[f"a{j}"]
            at = (n - 1) * q[1]
            if not below <= floor(at) < below + row[f"n{j}"]:
                raise ValueError(f"no bracket for quantile {q[1]}")  # against the sketch's bound
            if new[q][0] == new[q][1] or row[f"n{j}"] <= MOST:
                read[q] = (*new[q], below, row[f"n{j}"], row[f"h{j}"])
            elif floor(at) < below + row[f"e{j}"]:  # the least value of the bracket, however often it occurs
                read[q] = (new[q][0], new[q][0], below, row[f"e{j}"], row[f"m{j}"])
            else:  # without it, so that a bracket of a few frequent values gets smaller too
                again[q] = (row[f"m{j}"], new[q][1], below + row[f"e{j}"], row[f"n{j}"] - row[f"e{j}"])
        several = {q: v for q, v in read.items() if v[0] != v[1]}
        lists = rows.agg(*(F.sort_array(F.collect_list(F.when(x(q).between(v[0], v[1]), x(q)))).alias(f"v{j}") for j, (q, v) in enumerate(several.items()))).first() if several else None
        values = {q: lists[f"v{j}"] for j, q in enumerate(several)}
        for q, (a, b, below, n, above) in read.items():
            at = (counts[f"x{q[0]}"] - 1) * q[1] - below
            one = lambda i: (a if a == b else values[q][i]) if i < n else above
            low = one(floor(at))
            found[q] = low if at == floor(at) else low + (one(floor(at) + 1) - low) * (at - floor(at))
        todo = again
    return [[found[k, p] for p in levels] for k in range(width)]


def quantiles_by_key(df: DataFrame, keys: list[str], value: str, levels: list[float], most: int | None = None) -> DataFrame:
    """keys, n and q, an array of the quantiles of each key's values, by linear interpolation; exact, for all keys at once.

    Keys of up to `most` values are aggregated as they are. Of the others each wanted quantile has a bracket of values; a
    scan counts, for all keys, what is below and in the brackets, with a sketch of what is in them that narrows them
    for the next scan, until each holds `most` values at most. No aggregate of a key grows with its values. Null and NaN
    values are left out; a key without values has null quantiles.
    """
    most = most or MOST
    rows = df.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("x_"))
    counts = rows.groupBy(*keys).agg(F.count("x_").alias("n"))
    few = joined(rows, counts.filter(F.col("n") <= most).select(*keys), keys).groupBy(*keys).agg(F.count("x_").alias("n"), F.percentile("x_", F.array(*map(F.lit, levels))).alias("q"))
    todo = counts.filter(F.col("n") > most)
    if todo.isEmpty():
        return few
    # The order statistic below each quantile, and its bracket: (place, low, high, values below low, values in it).
    place = lambda p: F.floor((F.col("n") - 1) * p)
    empty = lambda p: F.struct(place(p).alias("at"), F.lit(float("-inf")).alias("a"), F.lit(float("inf")).alias("b"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    todo = written(todo.select(*keys, "n", *(empty(p).alias(f"s{j}") for j, p in enumerate(levels))), "brackets")
    marks = [k / MARKS for k in range(MARKS + 1)]
    while not todo.filter(" or ".join(f"(s{j}.inside > {most} and s{j}.a < s{j}.b)" for j in range(len(levels)))).isEmpty():
        inside = lambda j: F.when((F.col("x_") >= F.col(f"s{j}.a")) & (F.col("x_") <= F.col(f"s{j}.b")), F.col("x_"))
        grids = joined(rows, todo, keys).groupBy(*keys).agg(*(F.percentile_approx(inside(j), marks, ACCURACY).alias(f"g{j}") for j in range(len(levels))))
        step = lambda j: F.floor((F.col(f"s{j}.at") - F.col(f"s{j}.below")) / F.col(f"s{j}.inside") * MARKS).cast("int")
        end = lambda j, k: F.get(f"g{j}", F.greatest(F.lit(0), F.least(step(j) + k, F.lit(MARKS))))
        new = todo.join(grids, keys).select(*keys, "n", *(F.struct(F.col(f"s{j}.at").alias("at"), end(j, -1).alias("a"), end(j, 2).alias("b")).alias(f"s{j}") for j in range(len(levels))))
        found = joined(rows, new, keys).groupBy(*keys, "n", *(f"s{j}" for j in range(len(levels)))).agg(*(e for j in range(len(levels)) for e in (F.count_if(F.col("x_") < F.col(f"s{j}.a")).alias(f"l{j}"), F.count(inside(j)).alias(f"i{j}"), F.count_if(F.col("x_") == F.col(f"s{j}.a")).alias(f"e{j}"), F.min(F.when(F.col("x_") > F.col(f"s{j}.a"), F.col("x_"))).alias(f"m{j}"))))

        def narrowed(j: int) -> Column:
            """The bracket and its counts; its least value alone, or all but that, if it is still large: it always gets smaller."""
            at, a, b, below, inside_, least = F.col(f"s{j}.at"), F.col(f"s{j}.a"), F.col(f"s{j}.b"), F.col(f"l{j}"), F.col(f"i{j}"), F.col(f"e{j}")
            state = lambda a, b, below, inside: F.struct(at.alias("at"), a.alias("a"), b.alias("b"), below.alias("below"), inside.alias("inside"))
            small = (inside_ <= most) | (a == b)
            return F.when(small, state(a, b, below, inside_)).when(at < below + least, state(a, a, below, least)).otherwise(state(F.col(f"m{j}"), b, below + least, inside_ - least)).alias(f"s{j}")

        last, todo = todo, written(found.select(*keys, "n", *(narrowed(j) for j in range(len(levels)))), "brackets")
        discard(last)
    within = lambda j: (F.col("x_") >= F.col(f"s{j}.a")) & (F.col("x_") <= F.col(f"s{j}.b"))
    lists = joined(rows, todo, keys).groupBy(*keys, "n", *(f"s{j}" for j in range(len(levels)))).agg(*(e for j in range(len(levels)) for e in (F.sort_array(F.collect_list(F.when(within(j) & (F.col(f"s{j}.a") < F.col(f"s{j}.b")), F.col("x_")))).alias(f"v{j}"), F.min(F.when(F.col("x_") > F.col(f"s{j}.b"), F.col("x_"))).alias(f"h{j}"))))

    def one(j: int, more: int) -> Column:
        k = F.col(f"s{j}.at") - F.col(f"s{j}.below") + more
        own = F.when(F.col(f"s{j}.a") == F.col(f"s{j}.b"), F.col(f"s{j}.a")).otherwise(F.get(f"v{j}", k.cast("int")))
        return F.when(k < F.col(f"s{j}.inside"), own).otherwise(F.col(f"h{j}"))

    rest = lambda p: (F.col("n") - 1) * p - place(p)
    q = F.array(*(F.when(rest(p) == 0, one(j, 0)).otherwise(one(j, 0) + (one(j, 1) - one(j, 0)) * rest(p)) for j, p in enumerate(levels)))
    return few.unionByName(lists.select(*keys, "n", q.alias("q")))


def joined(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the values of their key; null keys are keys."""
    other = values.select(*(F.col(c).alias(f"{c}_of") for c in keys), *(c for c in values.columns if c not in keys))
    on = rows[keys[0]].eqNullSafe(other[f"{keys[0]}_of"])
    for c in keys[1:]:
        on = on & rows[c].eqNullSafe(other[f"{c}_of"])
    return rows.join(other, on).drop(*(f"{c}_of" for c in keys))


def in_ranges(rows: DataFrame, value: str, part: str = "part", ranges: int = 128) -> DataFrame:
    """rows with `part`, ascending with the value: ranges of about equal numbers of rows, from a sketch of the values."""
    cuts = rows.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], ACCURACY).alias("cuts_"))
    out = rows.crossJoin(F.broadcast(cuts))  # one row
    return out.withColumn(part, F.size(F.filter(F.coalesce("cuts_", F.array().cast("array<double>")), lambda c: c <= F.col(value)))).drop("cuts_")
