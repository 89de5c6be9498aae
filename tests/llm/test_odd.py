"""Odd input: clashing and unusual columns, ids of other types, very long texts, letters beyond ASCII, empty tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, exact_dedup, language, mixing, near_dedup, quality, repeats, secrets, token_counts, toxicity
from quillon.llm.common import keyed_join, sampled_rows, spare

CLASH = ["_of", "_id", "_values", "_stay", "_row_", "row_", "rid", "stay_", "bad_", "score", "predicted", "values_", "key_", "n", "level", "name", "label", "th", "bands", "times", "top", "w", "raw", "stats", "text_sha256", "kept", "item"]


def some(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Texts under one doc_id, without one, repeated rows; a map column, an array column and clashing names."""
    rng = np.random.default_rng(3)
    a, b, c = some(rng, 80), some(rng, 40), some(rng, 30)
    rows = [(1, a), (1, b), (2, a + " x"), (None, c), (None, None), (4, ""), (4, ""), (5, c + " vile awful"), (7, b), (7, b), (8, some(rng, 50))]
    df = spark.createDataFrame([(i, t, None, f"s{(i or 0) % 2}", 1, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, k int")
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)), F.create_map(F.lit("x"), F.lit(1)).alias("m"), F.array(F.lit(1)).alias("arr"))


def test_spare_names():
    assert spare(["a", "ROW_"], "row_") == "row__" and spare([], "x") == "x"


def test_keyed_join_is_a_join(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).alias("k"))
    values = rows.filter("k <> 5").groupBy("k").agg(F.count("*").alias("times"), F.max("id").alias("v"))
    got = keyed_join(rows, values, ["k"], "times", 2000)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, rows.join(values.drop("times"), "k").collect()))


def test_stages_keep_rows_and_columns(spark, odd):
    bench = odd.filter("doc_id = 8").select(F.lit(1).alias("item_id"), "text")
    labels = spark.createDataFrame([(5, 1), (8, 0)], "doc_id long, toxic int")
    stages = {
        "exact": (exact_dedup.kept_documents(odd), 7),
        "near": (near_dedup.kept_documents(odd, 80), 7),
        "benchmark": (decontaminate.clean_documents(odd, bench), 10),
        "toxicity": (toxicity.harmless(odd, labels.limit(0)), 0),
        "secrets": (secrets.redacted(odd, secrets.train(secrets.labelled_findings(spark, 300), 3, 3)), 11),
    }
    for name, (out, rows) in stages.items():
        assert out.dtypes == odd.dtypes, name
        if rows:
            got = out.select("k", "text").collect()
            assert len(got) == rows == len({r.k for r in got}), name
    assert {r.k for r in stages["exact"][0].select("k").collect()} >= {0, 2, 3, 7, 10}
    assert {r.k for r in stages["near"][0].select("k").collect()} >= {0, 1, 4, 5, 6, 7, 10}  # row 1 shares its id, not its text
    keep = toxicity.score(odd, toxicity.train(odd, labels), odd.columns[:6], ("s1", "p1"))
    assert keep.count() == odd.count()
    with pytest.raises(ValueError):
        toxicity.score(odd, toxicity.train(odd, labels), odd.columns)


def test_queries_ignore_other_columns(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").withColumn("score", F.lit(1)).withColumn("label", F.lit("x"))
    bench = spark.createDataFrame([(1, "never there", 3)], "item_id long, text string, len int")
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    calls = {
        "op2": exact_dedup.exact_dedup, "op3": language.op3, "op4": token_counts.op4, "op5": near_dedup.near_groups, "op6": lambda d: toxicity.op6(d, labels),
        "op7": lambda d: quality.op7(d, labels), "op8": lambda d: decontaminate.decontaminate(d, bench), "op9": mixing.op9, "op10": repeats.repeated_passages,
    }
    for name, f in calls.items():
        got = f(odd)
        assert got.count() == odd.count(), name
        assert got.columns == f(plain).columns, name


def test_string_ids(spark, odd):
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {r.component_id for r in near_dedup.near_groups(named).collect()} == {"d1", "d4", "d8", None} | {r.component_id for r in near_dedup.near_groups(named).filter("doc_id is null").collect()}
    assert exact_dedup.exact_dedup(named).filter("doc_id = 'd7' and kept").count() == 1


def test_letters_beyond_ascii_are_compared_as_they_are(spark):
    # A capital sigma's lower case depends on what follows; only A-Z are folded.
    item = "aa bb cc dd αΣ εΣ gg hh ii jj"
    rows = [(1, item), (2, item.replace(" ", ".")), (3, item.replace(" ", "'") + "'"), (4, item.upper()), (5, item.replace("α", "Α")), (6, "İİ " + item.replace("aa", "AA"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: 10, 2: 10, 3: 10, 4: 0, 5: 0, 6: 10}


def test_long_documents(spark):
    """A million words: linear in time, and every place is found, repeats and periodic text too."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{x}" for x in range(50_000)])
    body = rng.choice(words, 1_000_000)
    item = [f"q{k}" for k in range(14)]
    body[10:24] = item
    body[700_000:700_012] = item[1:13]
    body[999_990:] = item[4:14]
    body[500_000:500_100] = "same"
    docs = spark.createDataFrame([(1, " ".join(body)), (2, " ".join(["a", "b"] * 2000))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "same " * 12), (3, "a b " * 6), (4, "b a b")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: (1_000_000, 14 + 12 + 10 + 100, 2), 2: (4000, 4000, 2)}
    sized = {r.doc_id: (r.n_bytes, r.n_tokens > 10**6) for r in token_counts.op4(docs).collect()}
    assert sized[1] == (len(" ".join(body)), True)
    assert {r.doc_id: r.n_shingles for r in near_dedup.near_groups(docs).collect()}[2] == 2


def test_token_counts_do_without_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pool = list("abcdest nr'.!0é-ÜÑ’“—…λσΣΩдЖ日本語한글ไทยहिन्दी́̈😀‍👩​\xa0　½²٣KİΣ \x1c\x85") + ["é", "가", "<|endoftext|>", "\r\n", "n't", "'s", "’s"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(pool, rng.integers(1, 60))) for _ in range(1500)] + ["x" * 70_000 + "é" + "ab" * 5000 + " “quoted” end", "日本" * 3000]
    data = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    got = token_counts.counts(np.frombuffer(b"".join(data), np.uint8), offs, path)
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    # Once its characters are known, ordinary text asks the library nothing.
    machine, alphabet, special = token_counts._load(path)
    deaf = token_counts.Alphabet(library)
    deaf.kind, deaf.low, deaf.odd = alphabet.kind, alphabet.low, alphabet.odd
    deaf.normal = deaf.split = None
    token_counts._loaded[path] = machine, deaf, special
    try:
        plain = "“Curly” — and Ελληνικά, кириллица, 漢字 and 😀 don’t ask."
        for t in (plain, plain.upper()):
            alphabet.compile(np.array([ord(c) for c in t], np.int32))
            alphabet.compile(alphabet.low[np.array([ord(c) for c in t], np.int32)])
            b = t.encode()
            assert token_counts.counts(np.frombuffer(b, np.uint8), np.array([0, len(b)]), path)[0] == len(library.encode(t, add_special_tokens=False).ids)
    finally:
        token_counts._loaded[path] = machine, alphabet, special


def test_secret_shapes(spark):
    key = hashlib.sha256(b"k").hexdigest()
    letters = "".join(chr(97 + int(c, 16)) for c in key[:32])
    armour = f"-----BEGIN RSA PRIVATE KEY-----\n{key}\n{key[::-1]}\n-----END RSA PRIVATE KEY-----"
    rows = [(f"Authorization: Bearer {letters} end", letters), (f"a {armour} b", armour), (f"see https://joe:hunter2hunter2@host/x", "hunter2hunter2"), (f"x {letters * 2}{key[:12]}9 y", f"{letters * 2}{key[:12]}9")]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = secrets.candidates(docs).collect()
    assert {(r.doc_id, r.value) for r in got} == {(k, v) for k, (_, v) in enumerate(rows)}


def test_secrets_on_findings_of_another_part(spark):
    """Held-out precision and recall, on findings that the forest has not seen, found again in running text."""
    model = secrets.train(secrets.labelled_findings(spark, 2000), 20, 8)
    held = secrets.labelled_findings(spark, 1500, 1).toPandas()
    text = [b + v + ("@host/x" if "https://" in b else " ") + a for b, v, a in zip(held["before"], held["value"], held["after"])]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    found = {r.doc_id for r in secrets.scan(docs, model).filter("secret").collect()}
    true = set(np.flatnonzero(held["label"] == 1))
    assert len(found & true) > 0.97 * len(true) and len(found & true) > 0.97 * len(found)


def test_scores_by_brute_force(spark):
    """The scorers of toxicity and quality against their formulas, text by text."""
    rng = np.random.default_rng(2)
    texts = ["", "one", "One two, three!  four", some(rng, 300), "| a | b |\n| a | b |\n\nC"] + [some(rng, int(n)) for n in rng.integers(1, 40, 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    w = np.where(rng.random(1 << 10) < 0.3, rng.normal(size=1 << 10), 0.0)
    model = toxicity.ToxicityModel(w, -0.5, 10)
    for r in toxicity.score(docs, model, ["doc_id"]).collect():
        b = np.frombuffer(texts[r.doc_id].encode(), np.uint8)
        f, _ = toxicity.hashed(b, np.array([0, len(b)]), 10)
        words = re.findall(r"[0-9a-z\x80-\xff]+", texts[r.doc_id].lower())
        assert len(f) == len(words) + max(0, len(words) - 1) + max(0, len(words) - 2)
        z = sum(model_w * np.log1p(n) for k, n in Counter(f.tolist()).items() for model_w in [np.float32(w[k])])
        assert r.score == pytest.approx(1 / (1 + np.exp(-(z - 0.5))), abs=1e-5)
    x = quality.with_statistics(docs, ["doc_id"]).toPandas().set_index("doc_id")["stats"].map(np.array)
    label = {k: k % 2 for k in range(len(texts))}
    sums = {y: (float(len(v)), np.sum(v, 0), np.sum([np.outer(s, s) for s in v], 0)) for y in (0, 1) for v in [[x[k] for k in label if label[k] == y]]}
    got = quality.moments(docs.join(quality.with_statistics(docs, ["doc_id"]), "doc_id").withColumn("label", F.col("doc_id").cast("int") % 2))
    for y in (0, 1):
        assert got[y][0] == sums[y][0] and np.allclose(got[y][1], sums[y][1]) and np.allclose(got[y][2], sums[y][2])
    d = quality.Discriminant(sums)
    z = {k: (x[k] - d.mean) / d.scale for k in label}
    for k in label:
        density = {y: p - 0.5 * (z[k] - m) @ np.linalg.inv(c @ c.T) @ (z[k] - m) - 0.5 * np.linalg.slogdet(c @ c.T)[1] for y, (p, m, c) in d.classes.items()}
        want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / 2, -35, 35)))
        assert d.score(x[k][None])[0] == pytest.approx(want, abs=1e-6)


def test_language_over_many_segments():
    """A text of many segments gives the mean over its letters of each segment's own probabilities."""
    model = language.LanguageModel(["a", "b", "c"], hidden=3)
    text = np.frombuffer((b"abcde fgh 12 " * 90)[:1100], np.uint8)
    rows, got = [], model.probabilities(text, np.array([0, len(text)]))[0]
    for lo in range(0, len(text), 256):
        part = text[lo : lo + 256]
        right, _ = model.to_right.forward(part[:, None])
        left, _ = model.to_left.forward(part[::-1, None])
        logit = np.concatenate([right, left[::-1]], 2)[:, 0] @ model.v + model.c
        p = np.exp(logit) / np.exp(logit).sum(1, keepdims=True)
        rows.append(p[language.LETTER[part]])
    assert np.allclose(got, np.concatenate(rows).mean(0), atol=1e-4)


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_op10_compares_ids_of_any_type(spark):
    shared = "".join(chr(97 + (k * k + 3 * k) % 26) for k in range(90))
    rows = [("b", "1 " + shared), ("a", shared + " 2"), ("c", "3" + shared), (None, shared), ("c", shared + "4")]
    named = {(r.doc_id, r.n_bytes): r.n_removed for r in repeats.repeated_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    place = {"a": 1, "b": 2, "c": 3, None: None}
    counted = {(r.doc_id, r.n_bytes): r.n_removed for r in repeats.repeated_passages(spark.createDataFrame([(place[i], t) for i, t in rows], "doc_id long, text string")).collect()}
    assert {(place[i], n): x for (i, n), x in named.items()} == counted and counted[1, 92] == 0 and counted[2, 92] == counted[3, 91] == 90


def test_training_rows_are_bounded_where_ids_repeat(spark):
    """One doc_id on many rows: rows alike count once, and of others no more than the bound are taken."""
    rng = np.random.default_rng(3)
    rows = [(1, some(rng, 5) if k % 2 else "the same text", "en") for k in range(3000)] + [(k, some(rng, 5), "de") for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    keys = spark.createDataFrame([(1, 0, 7), (2, 1, 8), (3, 1, 9)], "doc_id long, label int, order long")
    got = sampled_rows(docs, keys, ["label"], 40, "order").collect()
    assert sorted((r.label, r.doc_id) for r in got) == [(0, 1)] * 40 + [(1, 2), (1, 3)] and len({r.text for r in got}) == 42
    model = language.train(docs, per_language=20, steps=5)
    assert model.classes == ["de", "en"] and language.train(docs, most=2, steps=1, hidden=3).to_left.h == 3


def test_very_long_texts_of_the_other_operators(spark):
    rng = np.random.default_rng(4)
    long, shared = " ".join(f"word{x}" for x in rng.integers(0, 10**6, 300_000)), some(rng, 30)
    rows = [(1, long + " " + shared, "en"), (2, shared + " " + long[: 1 << 20], "en"), (3, long + " " + shared, "de"), (4, "kurz", "de")]
    docs = spark.createDataFrame([(i, t, g, "s", 1) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs).collect()} == {1: 3, 2: 2, 3: 3, 4: 4}
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.repeated_passages(docs).collect()}
    assert gone[3] == (len(rows[2][1]), len(rows[2][1])) and gone[1][1] == 0 and gone[2][1] > 1 << 20
    for f in (lambda d: language.op3(d), lambda d: toxicity.op6(d, labels), lambda d: quality.op7(d, labels), mixing.op9):
        assert f(docs).count() == 4
    assert {r.doc_id: r.size for r in mixing.op9(docs).collect()}[1] == 300_030
