"""Divergence of sources, line dedup and importance resampling against brute force, with odd rows and tiny parameters."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import divergence, importance, line_dedup
from quillon.llm.common import ranked_rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_ int, a string, lines_ string, key_ int, rank int"
CLASH = (1, 2, "x", "y", 3, 4)
WORDS = "the of and Straße naïve ΣΑΣ 日本 x1 y2 don't é É z".split()


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    line = "A Line That Is Shared By Many Documents, of forty letters and more"
    long = "  the same long line again, with white space at its ends \t"
    out = []
    for k in range(120):
        text = "\n".join(" ".join(rng.choice(WORDS, rng.integers(0, 40))) for _ in range(rng.integers(0, 5)))
        if k % 3 == 0:
            text += "\n" + line + ("\n" + line.upper() if k % 2 else "")
        if k % 10 == 0:
            text = long + "\n" + text + "\n" + long.strip()
        out.append((k, text, ["en", "de", None][k % 3] if k % 11 else "", f"s{k % 4}" if k % 7 else None))
    out += [(None, line, "en", "s0"), (None, line + "\n" + line, "en", "s0"), (None, None, None, None), (3, line, "en", "s1"), (3, line, "en", "s1"), (500, "", "xx", "s9"), (501, None, "xx", "s8")]
    out += [(600, "\n".join(f"a line of its own, number {n}, which nothing repeats at all" for n in range(20_000)) + "\n" + line, "en", "s2")]
    return out


@pytest.fixture(scope="module")
def documents(spark, rows):
    return frame(spark, rows)


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


@pytest.mark.parametrize("how", [{"least_docs": 5}, {"least_docs": 5, "chunk": 3, "block": 2, "top": 4}, {"least_docs": 10**6}])
def test_divergence(documents, rows, how):
    least, top = how["least_docs"], how.get("top", 50)
    docs, counts, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        docs.update((g[0], t) for t in set(terms(text)))
        counts.update((*g, t) for t in terms(text))
    want = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for x, t in docs if x == lang and docs[x, t] >= least), key=lambda t: t.encode())
        sources = sorted((s for x, s in groups if x == lang), key=lambda t: t.encode())

        def share(n, kept=kept):
            size = sum(n)
            return [1 + 10**9 * (c + 5) // (size + 5 * len(kept)) for c in n]

        n = {s: [counts[lang, s, t] for t in kept] for s in sources}
        p, q = {s: share(n[s]) for s in sources}, share([sum(n[s][k] for s in sources) for k in range(len(kept))])
        for s in sources:
            pair = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode()) for o in sources if o != s))
            term = sorted((q[k] - p[s][k], t.encode()) for k, t in enumerate(kept) if n[s][k] and p[s][k] > q[k])[:top]
            for part, found in (("pair", pair), ("term", term)):
                want |= {(lang, s, part, o.decode(), -v, k + 1) for k, (v, o) in enumerate(found)}
    got = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in divergence.divergence(documents, **how).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_shares_are_exact():
    rng = np.random.default_rng(0)
    for size, width in ((10**15, 10**6), (17, 3), (0, 1), (0, 7)):
        n = rng.integers(0, size + 1, 50)
        assert divergence.shares(n, size, width).tolist() == [1 + 10**9 * (int(c) + 5) // (size + 5 * width) for c in n]


@pytest.mark.parametrize("how", [{}, {"min_chars": 3, "min_docs": 2, "batches": 7}, {"min_chars": 1, "min_docs": 1, "batches": 1}])
def test_line_dedup(documents, rows, how):
    chars, least = how.get("min_chars", 40), how.get("min_docs", 5)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    rank = lambda i: -1 if i is None else i
    holders = defaultdict(list)
    for i, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(i)
    want = Counter()
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < chars or len(holders[key(x)]) < least or max(holders[key(x)], key=rank) == i]
        want[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(documents, **how).collect())
    assert got == want
    clean = line_dedup.cleaned_documents(documents, **how)
    assert clean.columns == documents.columns
    texts = Counter((r.doc_id, r.text or "") for r in clean.collect())
    assert texts == Counter((i, t) for (i, _, _, t), n in want.items() for _ in range(n))


def test_line_dedup_of_string_ids(spark):
    line = "x" * 50
    docs = spark.createDataFrame([(f"d{k}", line) for k in range(7)], "doc_id string, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.op12(docs).collect()} == {f"d{k}": int(k < 6) for k in range(7)}


def test_a_run_is_one_row_a_hash_and_new_hashes_have_a_top(spark):
    docs = spark.range(40).select((40 - F.col("id")).alias("doc_id"), F.concat(F.lit("line "), F.col("id") % 4).alias("text"), F.col("id").alias("r"))
    runs = line_dedup.LineRuns(spark)
    hashed = line_dedup.hashed_lines(docs, "r", 1)
    for k in range(5):
        runs.add(line_dedup.line_counts(hashed.filter(F.floor(F.col("r") / 8) == k)))
        assert [len(level) for level in runs.levels] == [(k + 1) >> n & 1 for n in range(len(runs.levels))]
    got = runs.merged().collect()
    assert sorted((r.docs, r.times, r.top) for r in got) == [(10, 10, 37), (10, 10, 38), (10, 10, 39), (10, 10, 40)]
    runs.close()


def feats(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("buckets,percent", [(10_000, 5), (7, 60)])
def test_resample(spark, documents, rows, buckets, percent):
    bench = [("the of and Straße",), ("日本 x1 y2 don't z z z",), (None,)]
    s, t = (Counter(b % buckets for x in texts for b in feats(x)[1]) for texts in ([r[1] for r in rows], [b[0] for b in bench]))
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[k] + 1.0) * a / ((s[k] + 1.0) * b))) for k in range(buckets)]
    every, fit = [], []
    for n, (i, text, *_) in enumerate(rows):
        words, f = feats(text)
        weight = sum(gain[x % buckets] for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        every.append((i, len(f), weight, score))
        if words >= 20:
            fit.append((-score, i is None, i or 0, n))
    drawn = sorted(fit)[: len(fit) * percent // 100]
    ranks = {n: k + 1 for k, (*_, n) in enumerate(drawn)}
    want = Counter((*x, ranks.get(n)) for n, x in enumerate(every))
    got = importance.resample(documents, spark.createDataFrame(bench, "text string"), percent, buckets=buckets)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == want
    if buckets == 10_000:
        keep = importance.selected(documents, spark.createDataFrame(bench, "text string"), percent)
        assert keep.columns == documents.columns and Counter((r.doc_id, r.text) for r in keep.collect()) == Counter(rows[n][:2] for n in ranks)


def test_noise_favours_weight_as_sampling_without_replacement_does():
    """The maximum of weight plus noise is a draw in proportion to exp(weight / 1000)."""
    weight = [0, 1000, 2000]
    first = Counter(max(range(3), key=lambda k: weight[k] + importance.noise(3 * d + k, 1)) for d in range(6000))
    share = np.exp([0, 1, 2]) / np.exp([0, 1, 2]).sum()
    assert all(abs(first[k] / 6000 - share[k]) < 0.02 for k in range(3))


def test_ranked_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("row"), (F.col("id") % 5).alias("x"))
    got = ranked_rows(df, [F.col("x").desc(), F.col("row").asc()], "rank").collect()
    want = sorted(((-(k % 5), k) for k in range(3000)))
    assert {(r.row, r["rank"]) for r in got} == {(k, n + 1) for n, (_, k) in enumerate(want)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = frame(spark, [(1, "one two", "en", "s")])
    assert divergence.op11(none).count() == line_dedup.op12(none).count() == importance.op13(none, none).count() == 0
    assert importance.op13(some, none).count() == 1 and divergence.op11(some).count() == 0
    assert line_dedup.cleaned_documents(none).count() == importance.selected(none, some).count() == 0


@pytest.mark.parametrize("name", ["op11", "op12"])
def test_sql_agrees_on_odd_rows(documents, name):
    con = duckdb.connect()
    con.register("pandas_docs", documents.select("doc_id", "text", "lang", "source").filter("doc_id <> 3").toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source FROM pandas_docs")
    module = {"op11": divergence, "op12": line_dedup}[name]
    want = con.sql(module.SQL).df()
    got = getattr(module, name)(documents.filter("doc_id <> 3")).toPandas()[list(want.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))
