"""More queries with DuckDB SQL: checked joins, cleaning, labels, releases and tables of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dsp, scalars
from ..operators import metrics, models, pairs, reconstruct, reports, sampling, signal, stats, transforms, views, windows
from .catalog import SEG, SIG, _rounded, h, norm, query
from .tables import read, vector_segments
from .tables import signal as samples

# --- cleaning and labels

SEX = "CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN ' female ' WHEN 2 THEN 'Mixed' WHEN 3 THEN 'F' WHEN 4 THEN 'MALE' END"


@query(f"SELECT c_custkey, CASE WHEN lower(trim({SEX})) IN ('m', 'male') THEN 'Male' WHEN lower(trim({SEX})) IN ('f', 'female') THEN 'Female' END AS sex FROM customer")
def normalized_sex(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", scalars.normalize_sex(F.expr(SEX)).alias("sex"))


AGE = "CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_custkey % 150 - 10 AS VARCHAR) END"


@query(f"SELECT c_custkey, CASE WHEN TRY_CAST({AGE} AS DOUBLE) BETWEEN 0 AND 120 THEN TRY_CAST({AGE} AS DOUBLE) END AS age FROM customer")
def valid_ages(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", scalars.valid_age(F.expr(AGE.replace("VARCHAR", "STRING"))).alias("age"))


@query("SELECT c_custkey, round(greatest(c_acctbal, 0), 6) AS relu, round(tanh(c_acctbal / 1000), 6) AS tanh, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS logistic, c_acctbal AS identity FROM customer")
def activations(spark, sf):
    x = F.col("c_acctbal")
    return read(spark, sf, "customer").select("c_custkey", *(F.round(scalars.activation(x / 1000 if k in ("tanh", "logistic") else x, k), 6).alias(k) for k in ("relu", "tanh", "logistic")), scalars.activation(x, "identity").alias("identity"))


@query("SELECT p_partkey, format('Gaussian C={:.1f} sigma={:.4f}', CAST(p_size AS DOUBLE), p_size / 16.0) AS label FROM part")
def gaussian_labels(spark, sf):
    return read(spark, sf, "part").select("p_partkey", scalars.gaussian_label(F.col("p_size") / 16.0, F.col("p_size").cast("double")).alias("label"))


# --- checked joins and views


@query("SELECT r_regionkey, r_name FROM region WHERE r_name = 'ASIA'")
def exactly_one_row(spark, sf):
    return views.exactly_one(read(spark, sf, "region"), F.col("r_name") == "ASIA").select("r_regionkey", "r_name")


@query("SELECT o_custkey, o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def aligned_targets(spark, sf):
    t = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return views.aligned(read(spark, sf, "orders").select("o_custkey", "o_orderkey"), t, "o_custkey")


@query("SELECT row_number() OVER (ORDER BY o DESC) AS place, n_nationkey, n_name FROM (SELECT n_nationkey AS o, n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 0)")
def rows_in_order(spark, sf):
    wanted = read(spark, sf, "nation").filter("n_nationkey % 3 = 0").select("n_nationkey", (-F.col("n_nationkey")).alias("o"))
    rows = wanted.join(read(spark, sf, "nation"), "n_nationkey")
    return sampling.in_order(rows, [F.col("o")]).select("place", "n_nationkey", "n_name")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def labelled_keys(spark, sf):
    names = read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return reports.labelled(read(spark, sf, "supplier"), names, "s_nationkey").select("s_suppkey", "n_name")


WHOLE = "SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 2"


@query(f"SELECT l_orderkey FROM ({WHOLE}) WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ORDER BY {h('l_orderkey', seed=5)}, l_orderkey LIMIT 50")
def query_records(spark, sf):
    known = read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return views.query_records(read(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", [1, 2], known, 50, 5)


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def refreshed_cache(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderdate").distinct()
    return views.refreshed(o.filter("o_custkey % 2 = 0"), o, "o_custkey", "o_orderdate")


@query("SELECT a.c_custkey, CAST(a.c_acctbal > 0 AS INT) AS y, CAST(a.c_acctbal > 0 AS INT) AS y_b, a.c_custkey % 2 AS p, a.c_custkey % 3 AS p_b FROM customer a")
def paired_predictions(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") > 0).cast("int").alias("y"))
    return stats.same_targets(c.withColumn("p", F.col("c_custkey") % 2), c.withColumn("p", F.col("c_custkey") % 3), ["c_custkey"], "y")


# --- signals


@query(f"""WITH {SIG}, p AS (SELECT record, idx FROM sig WHERE value > 60), d AS (SELECT record, idx, (idx - lag(idx) OVER w) / 10.0 AS d FROM p WINDOW w AS (PARTITION BY record ORDER BY idx)), e AS (SELECT *, d - lag(d) OVER (PARTITION BY record ORDER BY idx) AS dd FROM d)
SELECT record, CAST(count(*) AS INT) AS n_peaks, round(avg(d), 6) AS rr_mean, round(stddev_pop(d), 6) AS rr_std, round(sqrt(avg(dd * dd)), 6) AS rr_rmssd, round(60 / avg(d), 6) AS heart_rate FROM e GROUP BY 1""")
def rr_intervals(spark, sf):
    p = samples(spark, sf).filter("value > 60").groupBy("record").agg(F.array_sort(F.collect_list("idx")).alias("peaks"))
    return _rounded(signal.rr_features(p, 10.0).drop("peaks"))


@query(f"""WITH {SIG}, s AS (SELECT record, idx, CASE WHEN value < 40 THEN 1 WHEN value < 60 THEN 0 WHEN idx % 2 = 0 THEN 1 ELSE 0 END AS neg FROM sig)
SELECT record, round(coalesce(avg(c), 0), 6) AS zero_crossing_rate FROM (SELECT record, CAST(neg <> lag(neg) OVER (PARTITION BY record ORDER BY idx) AS INT) AS c FROM s) GROUP BY 1""")
def signed_zero_crossings(spark, sf):
    s = samples(spark, sf)
    v = F.when(F.col("value") < 40, -1.0).when(F.col("value") < 60, 1.0).when(F.col("idx") % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0))
    return _rounded(windows.zero_crossings(s.withColumn("value", v), ["record"]))


@query(f"""WITH {SIG}, r AS (SELECT record, idx, value AS y, coalesce(lag(value) OVER (PARTITION BY record ORDER BY idx), 0) AS z FROM sig)
SELECT record, round(sqrt(avg((y - z) * (y - z))), 6) AS rmse, round(100 * sqrt(sum((y - z) * (y - z)) / sum(y * y)), 5) AS prd, round(10 * log10(sum(y * y) / sum((y - z) * (y - z))), 6) AS snr_db,
round(corr(y, z), 6) AS correlation FROM r GROUP BY 1 HAVING count(*) > 2""")
def reconstruction_errors(spark, sf):
    from pyspark.sql import Window

    s = samples(spark, sf).withColumn("z", F.coalesce(F.lag("value").over(Window.partitionBy("record").orderBy("idx")), F.lit(0.0)))
    a = s.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("idx", "value", "z"))).alias("r")).filter(F.size("r") > 2)
    a = a.select("record", F.col("r.value").alias("y"), F.col("r.z").alias("z"))
    m = signal.reconstruction_metrics(a)
    return m.select("record", F.round("rmse", 6).alias("rmse"), F.round("prd", 5).alias("prd"), F.round("snr_db", 6).alias("snr_db"), F.round("correlation", 6).alias("correlation"))


@query(f"WITH {SIG} SELECT record, CAST(count(*) AS INT) AS n, round(sum(value), 4) AS total FROM sig GROUP BY 1 HAVING count(*) >= 66")
def guarded_rows(spark, sf):
    def f(x):
        if len(x) < 66:
            raise ValueError("too short")
        return {"n": len(x), "total": round(float(x.sum()), 4)}

    return signal.guarded(signal.as_arrays(samples(spark, sf)), f, "n int, total double")[0].select("record", "n", "total")


@query(f"WITH {SIG} SELECT record, 'ValueError: too short' AS error FROM sig GROUP BY 1 HAVING count(*) < 66")
def dead_letters(spark, sf):
    def f(x):
        if len(x) < 66:
            raise ValueError("too short")
        return {"n": len(x)}

    return signal.guarded(signal.as_arrays(samples(spark, sf)), f, "n int")[1].select("record", "error")


def both_ways(low: float, high: float, fs: float, order: int) -> str:
    """A band-pass forwards and backwards in recursive SQL: the recurrence of the filter's states, sample by sample."""
    b, a = dsp.butter_bandpass(low, high, fs, order)
    zi, n = dsp.steady_state(b, a), len(a) - 1
    num = lambda x: f"({float(x)!r})"

    def states(x: str, s: list[str]) -> tuple[str, str]:
        y = f"({num(b[0])} * {x} + {s[0]})"
        return y, ", ".join((f"{s[i + 1]} + " if i < n - 1 else "") + f"{num(b[i + 1])} * {x} - {num(a[i + 1])} * {y} AS s{i}" for i in range(n))

    def run(name: str, source: str) -> str:
        y0, s0 = states("x", [f"{num(z)} * x" for z in zi])
        y1, s1 = states("n.x", [f"{name}.s{i}" for i in range(n)])
        return f"{name} AS (SELECT record, 0::BIGINT AS k, {y0} AS y, {s0} FROM {source} WHERE k = 0 UNION ALL SELECT {name}.record, {name}.k + 1, {y1}, {s1} FROM {name} JOIN {source} n ON n.record = {name}.record AND n.k = {name}.k + 1)"

    return f"""WITH RECURSIVE {SIG}, m AS (SELECT record, max(idx) AS m, least({3 * (n + 1)}, max(idx)) AS p, arg_min(value, idx) AS v0, arg_max(value, idx) AS v1 FROM sig GROUP BY 1),
ext AS (SELECT record, p - idx AS k, 2 * v0 - value AS x FROM sig JOIN m USING (record) WHERE idx BETWEEN 1 AND p UNION ALL SELECT record, p + idx, value FROM sig JOIN m USING (record) UNION ALL SELECT record, p + m + (m - idx), 2 * v1 - value FROM sig JOIN m USING (record) WHERE idx BETWEEN m - p AND m - 1),
{run('fw', 'ext')},
rv AS (SELECT fw.record, m + 2 * p - k AS k, y AS x FROM fw JOIN m ON m.record = fw.record),
{run('bw', 'rv')}
SELECT bw.record, CAST(m + p - k AS INT) AS idx, round(y, 4) + 0.0 AS value FROM bw JOIN m ON m.record = bw.record WHERE k BETWEEN p AND m + p"""


def _filtered(spark, sf, order: int):
    out = signal.bandpass(signal.as_arrays(samples(spark, sf)), 0.5, 4.0, 10.0, order)
    return out.select("record", F.posexplode("signal").alias("idx", "value")).select("record", "idx", (F.round("value", 4) + 0.0).alias("value"))


@query(both_ways(0.5, 4.0, 10.0, 1))
def bandpass_order_1(spark, sf):
    return _filtered(spark, sf, 1)


@query(both_ways(0.5, 4.0, 10.0, 4))
def bandpass(spark, sf):
    return _filtered(spark, sf, 4)


@query(both_ways(0.5, 4.0, 10.0, 4))
def bandpass_in_chunks(spark, sf):
    """The same of recordings that are cut in chunks of 16 samples: their filter states are linked by a scan."""
    out = signal.bandpass_in_chunks(samples(spark, sf), 0.5, 4.0, 10.0, 4, 16)
    return out.select("record", F.col("idx").cast("int").alias("idx"), (F.round("value", 4) + 0.0).alias("value"))


# --- transforms and models


@query(f"SELECT o_orderkey, round(o_totalprice + 0.1 * (SELECT stddev_pop(o_totalprice) FROM orders) * {norm('o_orderkey', chr(39) + 'o_totalprice' + chr(39), seed=0)}, 2) AS o_totalprice FROM orders")
def noise_release(spark, sf):
    d = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return transforms.fit(d, ["o_totalprice"], "noise").transform(d, "o_orderkey").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def identity_release(spark, sf):
    d = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return transforms.fit(d, ["o_totalprice"], "identity").transform(d)


@query("WITH a AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 4 <> 0) SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice FROM orders, a WHERE o_orderkey % 4 = 0")
def fitted_on_train(spark, sf):
    d = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    test = transforms.fit_split(d.filter("o_orderkey % 4 <> 0"), d.filter("o_orderkey % 4 = 0"), ["o_totalprice"], "standard")[1]
    return test.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem")
def best_ranked_columns(spark, sf):
    ranking = spark.createDataFrame([("nothing", 0), ("l_tax", 1), ("l_discount", 2), ("l_tax", 5), ("l_quantity", 9)], "name string, place int")
    return transforms.top_features(read(spark, sf, "lineitem"), ranking, "name", "place", 2, ["l_orderkey", "l_linenumber"])


@query("WITH n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) SELECT c_custkey, c_mktsegment, round((SELECT sum(n) / count(*) FROM n) / n, 6) AS weight FROM customer JOIN n USING (c_mktsegment)")
def balanced_class_weights(spark, sf):
    return _rounded(models.balanced_weights(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment"))


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT)::DOUBLE AS y FROM orders")
def binary_targets(spark, sf):
    return models.binary_target(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")[0].select("o_orderkey", "y")


@query("WITH t AS (SELECT avg(c_acctbal) AS m FROM customer WHERE c_custkey % 5 <> 0) SELECT round(sqrt(avg((c_acctbal - m) * (c_acctbal - m))), 4) AS rmse, round(100 * sqrt(sum((c_acctbal - m) * (c_acctbal - m)) / sum(c_acctbal * c_acctbal)), 4) AS prd FROM customer, t WHERE c_custkey % 5 = 0")
def mean_reference(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_acctbal")
    m = reconstruct.train_mean(c.filter("c_custkey % 5 <> 0"), ["c_acctbal"])[0]
    e = reconstruct.error_table(c.filter("c_custkey % 5 = 0").withColumn("p", F.lit(m)), ["c_acctbal"], ["p"])
    return e.select(F.round("rmse", 4).alias("rmse"), F.round("prd", 4).alias("prd"))


XY = "t AS (SELECT l_quantity AS x, l_extendedprice AS y, l_orderkey % 5 = 0 AS test FROM lineitem), w AS (SELECT covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1) AS w, avg(x) AS mx, avg(y) AS my FROM t WHERE NOT test)"


@query(f"WITH {XY} SELECT round(sum(w * x + my - w * mx), 2) AS total, count(*) AS n, round(avg(abs(y - (w * x + my - w * mx))), 4) AS mae FROM t, w WHERE test")
def ridge_of_one(spark, sf):
    d = read(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_orderkey") % 5 == 0).alias("test"))
    w, b = models.ridge(d.filter("not test"), ["x"], ["y"])
    out = models.ridge_predict(d.filter("test"), ["x"], w, b, ["p"])
    return out.agg(F.round(F.sum("p"), 2).alias("total"), F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y") - F.col("p"))), 4).alias("mae"))


@query(f"WITH {SEG}, n AS (SELECT a.vec_id, a.label, list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))) AS d FROM seg a JOIN seg b ON a.vec_id = b.vec_id) SELECT vec_id, round(d, 6) AS zero FROM n")
def distance_to_itself(spark, sf):
    seg = vector_segments(spark, sf)
    p = seg.select(F.col("vec_id").alias("key_a"), F.col("vec_id").alias("key_b"))
    out = pairs.pair_features(p, seg, "vec_id", "v", "absdiff_mean")
    return out.select(F.col("key_a").alias("vec_id"), F.round(F.aggregate(F.slice("features", 1, 64), F.lit(0.0), lambda a, x: a + x), 6).alias("zero"))


# --- tables of results


@query("SELECT o_orderstatus AS task, o_orderpriority AS representation, round(avg(CASE WHEN o_custkey % 2 = 0 THEN o_totalprice END), 4) AS even_mean, round(stddev_samp(CASE WHEN o_custkey % 2 = 0 THEN o_totalprice END), 4) AS even_std, round(avg(CASE WHEN o_custkey % 2 = 1 THEN o_totalprice END), 4) AS odd_mean, round(stddev_samp(CASE WHEN o_custkey % 2 = 1 THEN o_totalprice END), 4) AS odd_std FROM orders GROUP BY 1, 2")
def attribute_table(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderstatus").alias("task"), F.col("o_orderpriority").alias("representation"), F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("condition"), "o_totalprice")
    t = reports.attribute_table(o, ["even", "odd"], "o_totalprice")
    return t.select("task", "representation", *(F.round(c, 4).alias(c) for c in t.columns[2:]))


@query("""WITH s AS (SELECT o_orderstatus AS scope, CAST(count(*) AS VARCHAR) AS n_orders, CAST(min(o_orderkey) AS VARCHAR) AS first_key, CASE WHEN o_orderstatus <> 'F' THEN CAST(count(DISTINCT o_orderpriority) AS VARCHAR) END AS priorities FROM orders GROUP BY 1)
SELECT scope, parameter, value FROM s UNPIVOT (value FOR parameter IN (n_orders, first_key, priorities))""")
def fixed_settings(spark, sf):
    o = read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"), F.min("o_orderkey").alias("first_key"), F.count_distinct("o_orderpriority").alias("p"))
    o = o.withColumn("priorities", F.when(F.col("o_orderstatus") != "F", F.col("p")))
    return reports.protocol_rows(o, "o_orderstatus", ["n_orders", "first_key", "priorities"])


@query("SELECT n_nationkey, CAST(row_number() OVER (ORDER BY CASE n_regionkey WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE 3 END, n_nationkey) AS BIGINT) AS place FROM nation")
def ordered_table(spark, sf):
    n = read(spark, sf, "nation").withColumn("r", F.col("n_regionkey").cast("string"))
    return sampling.in_order(n, reports.in_given_order("r", ["2", "0"], "n_nationkey")).select("n_nationkey", "place")


@query("SELECT c_mktsegment, count(*) AS n, round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.75), 4) AS q75 FROM customer GROUP BY 1")
def quartiles_by_key(spark, sf):
    r = stats.unpivoted_quartiles(read(spark, sf, "customer").select("c_mktsegment", "c_acctbal"), ["c_acctbal"], ["c_mktsegment"])
    return r.select("c_mktsegment", "n", *(F.round(c, 4).alias(c) for c in ("q25", "median", "q75")))


@query(" UNION ALL ".join(f"SELECT {k} AS place, round(quantile_cont(l_extendedprice, {k / 20}), 6) AS threshold FROM lineitem" for k in range(1, 20)))
def score_thresholds(spark, sf):
    q = metrics.score_quantile_thresholds(read(spark, sf, "lineitem"), "l_extendedprice")
    return spark.createDataFrame([(k + 1, round(v, 6)) for k, v in enumerate(q)], "place long, threshold double")


@query(f"WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY {h('p_partkey', seed=8)}, p_partkey) AS rn FROM part) SELECT p_brand, p_partkey FROM r WHERE rn <= 3")
def ranked_in_groups(spark, sf):
    from ..functions.hashing import hash_52

    return sampling.ranked(read(spark, sf, "part"), hash_52("p_partkey", seed=8), ["p_brand"], ["p_partkey"]).filter("rank_ <= 3").select("p_brand", "p_partkey")
