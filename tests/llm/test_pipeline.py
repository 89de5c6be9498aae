"""The whole pipeline against a brute-force version of each stage, on one small table."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import mixing, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOW))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    say = lambda n, low=0: " ".join(f"w{x}" for x in rng.integers(low, low + 900, n))
    vile = lambda n: " ".join(rng.choice(["vile", "awful", "hate", "scum", "w1", "w2", "w3"], n))
    rows, leak, base = [], say(14), say(120)
    for k in range(240):
        rows.append((k, vile(12) if k % 6 == 0 else say(int(rng.integers(5, 60)))))
    rows += [(300 + k, base if k % 2 else base.upper()) for k in range(6)]
    w = base.split()
    rows += [(310 + k, " ".join(w[:k] + ["odd"] + w[k + 1 :])) for k in range(5, 100, 19)]  # near copies
    rows += [(330, base[: len(base) // 2]), (340, say(20) + " " + leak + " " + say(9)), (341, leak.upper()), (342, " ".join(leak.split()[:9])), (350, None), (351, ""), (352, " \n"), (3, say(40)), (None, say(30)), (None, rows[7][1])]
    docs = [(i, t, "en", f"s{(i or 0) % 5}" if i != 9 else None, len(t or "")) for i, t in rows]
    path = tmp_path_factory.mktemp("small")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, "never anywhere")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, leak


def test_pipeline_is_what_brute_force_gives(spark, folder):
    path, docs, leak = folder
    table = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    model = toxicity.train(table("documents"), table("labels"))
    scores = []
    for d in docs:
        b = np.frombuffer((d[1] or "").encode(), np.uint8)
        scores.append(model.score(b, np.array([0, len(b)]))[0])
    rows = [d for d, s in zip(docs, scores) if s < 0.5]
    assert 150 < len(rows) < len(docs) - 30
    rank = lambda i: -1 if i is None else i
    best = {}
    for d in rows:
        t = d[1] or ""
        if t not in best or rank(d[0]) > rank(best[t][0]):
            best[t] = d
    rows = list(best.values())
    sets, parent = [shingles(d[1]) for d in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    keep = {}
    for k, d in enumerate(rows):
        g = root(k) if sets[k] else ("own", k)
        if g not in keep or (keep[g][0] is None, keep[g][0] or 0) > (d[0] is None, d[0] or 0):
            keep[g] = d
    rows = list(keep.values())
    letters = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    item = words(leak, letters)
    spans = {tuple(item[i : i + 10]) for i in range(len(item) - 9)} | {("never", "anywhere")}

    def hit(text):
        w = words(text, letters)
        return any(tuple(w[i : i + n]) in spans for n in (2, 10) for i in range(len(w) - n + 1))

    rows = [d for d in rows if not hit(d[1])]
    got = corpus_pipeline.run(spark, path).collect()
    size = lambda d: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((d[0], size(d), d[3]) for d in rows)
    sources = Counter()
    for d in rows:
        sources[d[3]] += size(d)
    want = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sources.items()], "source string, source_size long, docs long")).collect()}
    for s, n in sources.items():
        own = [r for r in got if r.source == s]
        assert {(r.source_size, round(r.target, 6)) for r in own} == {(n, round(want[s], 6))}
        assert abs(sum(r.taken for r in own) - want[s]) < 0.05 * n + 60 and all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in own)
    assert {340, 341} & {d[0] for d in docs} and not {340, 341} & {r.doc_id for r in got} and {342, 330} <= {r.doc_id for r in got}
