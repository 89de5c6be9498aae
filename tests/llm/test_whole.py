"""Operators do the whole job: cases that a bound or a cut used to leave out."""

import hashlib

import numpy as np

from quillon.llm import decontaminate, near_dedup, secrets, toxicity


def test_toxicity_keeps_its_prior_when_the_cap_bites(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(rng.choice(words, 6))) for k in range(3000)]  # nothing in a text tells its label
    labels = [(k, int(k % 10 == 3)) for k in range(3000)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for cap in (3000, 100):
        got = toxicity.score(docs, toxicity.train(docs, labels, per_class=cap), ["doc_id"]).toPandas()
        assert 0.05 < got["score"].mean() < 0.2 and got["predicted"].mean() < 0.05


def test_secret_candidates_are_whole(spark):
    key = hashlib.sha1(b"k").hexdigest()
    path = "/".join(["srv", "share", "deployment", "production", "credentials", "storage", "archive", "keys"]) + "/"
    pad = "QWxhZGRpbjpvcGVuIHNlc2FtZQ9="
    rows = [
        (path + key, [path + key]),
        ("password=hunter2hunter2", ["hunter2hunter2"]),
        (f"export token={key}\nx", [key]),
        (f"AWS_SECRET_ACCESS_KEY={key}", [key]),
        (f"call({{api_key={key}, n=2}})", [key]),
        (f"GET /?token={key}&page=2", [key]),
        (f"password: {key}!x% end", [key + "!x%"]),
        (f"the value {pad} ends", [pad]),
        (f"name=x{key}", ["x" + key]),
        (f"if token == '{key}'", [key]),
        (f"token=={key}", [key]),
        (f"{key} {key} and {key}", [key] * 3),
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = secrets.candidates(docs).orderBy("doc_id", "n").collect()
    for k, (t, want) in enumerate(rows):
        mine, at = [r for r in got if r.doc_id == k], 0
        assert [r.value for r in mine] == want
        for r in mine:
            at = t.index(r.value, at)
            assert r.before == t[max(0, at - 48) : at] and r.after == t[at + len(r.value) :][:48]
            at += len(r.value)
    keyed = {r.doc_id for r in secrets.with_features(secrets.candidates(docs)).filter("keyed > 0").collect()}
    assert keyed == {1, 2, 3, 4, 5, 6, 9, 10}


def test_secret_features_see_the_whole_value(spark):
    rows = spark.createDataFrame([("ab" * 200 + "".join(map(chr, range(48, 122))), "", "")], "value string, before string, after string")
    v = rows.first().value
    p = np.array([v.count(c) / len(v) for c in set(v)])
    r = secrets.with_features(rows).first()
    assert abs(r.entropy + (p * np.log2(p)).sum()) < 1e-9 and abs(r.variety - len(p) / 64) < 1e-9


def test_rows_without_or_with_the_same_id_are_told_apart(spark):
    rng = np.random.default_rng(9)
    some = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    near, clean, leak = some(200), [some(60) for _ in range(4)], some(30)
    rows = [(None, leak + " a", 0), (None, clean[0], 1), (7, clean[1], 2), (7, leak + " b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert {r.k for r in decontaminate.clean_documents(docs, bench).collect()} == {1, 2}

    rows = [(None, near, 0), (None, near + " x", 1), (None, near + " y", 2), (None, clean[0], 3), (5, clean[1], 4), (5, clean[2] + " z", 5), (3, clean[2], 6), (8, clean[3], 7), (None, clean[3] + " x", 8), (None, None, 9), (None, near, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = [r.k for r in near_dedup.kept_documents(docs.repartition(3)).collect()]
    assert len(got) == len(set(got)) and len({0, 1, 2, 10} & set(got)) == 1 and set(got) - {0, 1, 2, 10} == {3, 4, 6, 7, 9}
    groups = near_dedup.near_groups(docs).collect()
    assert sum(r.kept for r in groups if r.n_shingles in (196, 197)) == 1 and sum(r.kept for r in groups) == 6
