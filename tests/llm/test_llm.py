"""Corpus operators against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, exact_dedup, language, mixing, near_dedup, quality, repeats, secrets, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, rid string, name string"
SYLLABLES = "the an er tion on st ble re ing ha".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    base, shared = prose(rng, 300), prose(rng, 60)
    words = base.split()
    out = [base, base, base + " more words", " ".join(words[:20] + ["other"] + words[21:]), " ".join(words[:-40]), prose(rng, 5000), prose(rng, 80) + " " + shared + " " + prose(rng, 30), shared + prose(rng, 90), None, "", "", " \n\t", "one two", "One TWO", "É è ü ß x", "a" * 5000, "a" * 4096, "ab" * 2048, "ab" * 2048 + "c", None]
    out += [prose(rng, int(n)) for n in rng.integers(1, 120, 40)]
    return [(k, t) for k, t in enumerate(out)] + [(3, out[3]), (None, base), (None, None), (70, shared), (71, shared[:49]), (72, shared[5:55])]


@pytest.fixture(scope="module")
def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}" if i != 5 else None, 1, "x", "y", "z") for i, t in texts], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(documents, texts, nothing):
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    rank = lambda i: -1 if i is None else i
    want = Counter((i, max(groups[t or ""], key=rank), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    for how in ({}, {"block": 16}, {"block": 64, "hashed": lambda b: F.pmod(F.xxhash64(b), F.lit(3))}):
        got = exact_dedup.exact_dedup(documents, **how).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = [r.text_sha256 for r in got if r.kept]
        assert len(kept) == len(set(kept)) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(nothing).count() == 0
    left = exact_dedup.kept_documents(documents)
    assert left.columns == documents.columns and left.count() == len(groups)


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 200])
def test_near_dedup(documents, texts, nothing, block):
    sets = {k: (i, shingle_set(t)) for k, (i, t) in enumerate(texts)}
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                x, y = sets[a][1], sets[b][1]
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
        break
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a][1], sets[b][1]
                if label[a] != label[b] and x and y and 100 * len(x & y) >= 85 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    ids = defaultdict(list)
    for k in sets:
        if sets[k][0] is not None:
            ids[label[k]].append(sets[k][0])
    want = Counter((i, len(s), (min(ids[label[k]]) if ids[label[k]] else None) if s else i) for k, (i, s) in sets.items())
    got = near_dedup.near_groups(documents, block=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_groups(nothing).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 40, 3000):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        k = near_dedup.sketch(s, 252)
        assert k.max() < np.iinfo(np.uint64).max and (k == near_dedup.sketch(s[::-1].copy(), 252)).all()
    both = rng.integers(0, 1 << 63, 1200).astype(np.uint64)
    a, b = both[:1000], both[200:]
    same = np.mean(near_dedup.sketch(np.sort(a), 252) == near_dedup.sketch(np.sort(b), 252))
    assert abs(same - 800 / 1200) < 0.12


def test_decontaminate(spark, documents, texts, nothing):
    shared = texts[6][1].split()[80:140]
    items = [(1, " ".join(shared[:30]).upper()), (2, " ".join(shared[15:24])), (3, "One two"), (4, None), (5, ""), (10, texts[0][1][:400]), (None, "é è"), (6, "É"), (1, "never seen words at all in any of these")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))

    def one(t):
        w, hit, names = cut(t), set(), set()
        for i, x in items:
            v = cut(x)
            n = min(10, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for d in range(len(w) - n + 1):
                    if w[d : d + n] == v[s : s + n]:
                        hit |= set(range(d, d + n))
                        names.add("" if i is None else str(i))
        return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)

    want = Counter((i, *one(t)) for i, t in texts)
    for most in (decontaminate.BROADCAST_SPANS, 0):
        got = decontaminate.decontaminate(documents, bench, most)
        assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == want
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert decontaminate.decontaminate(documents, bench.limit(0)).filter("contaminated").count() == 0


def brute_repeats(texts):
    first = {}
    top = 1 << 63
    for i, t in texts:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, top), top if i is None else i)
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (top if i is None else i):
                gone[k : k + 50] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        yield i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("group", [1 << 23, 3000])
def test_repeats(documents, texts, nothing, group):
    got = repeats.repeated_passages(documents, group=group)
    assert Counter(map(tuple, got.collect())) == Counter(brute_repeats(texts))
    assert repeats.repeated_passages(nothing).count() == 0


def test_cover_and_windows():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))
    b = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabc", np.uint8)
    h = repeats.window_hashes(b, 20)
    assert len(h) == 11 and h[0] == h[3] and h[0] != h[1]


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_bucket_sort_against_brute_force(letters):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 97 + letters, 4000).astype(np.uint8)
    text[2000:3000] = text[:1000]
    text[3100:3140] = text[20:60]  # equal in 40 bytes, not in 50
    begin, count = np.arange(0, 3900, 150), np.full(26, 100)
    doc = rng.integers(0, 9, 26).astype(np.int64)
    at, owner = repeats._ranges(begin, count), np.repeat(doc, count)
    least = {}
    for p, o in zip(at, owner):
        key = text[p : p + 50].tobytes()
        least[key] = min(least.get(key, o), o)
    want = [least[text[p : p + 50].tobytes()] < o for p, o in zip(at, owner)]
    got = repeats.owned_elsewhere(text, begin, count, doc)
    assert got.any() and got.tolist() == want


def test_token_counts(documents, texts, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    odd = ["it's don't 'tis we'll I'D 'S''s a'b'", "<|endoftext|> a", "日本 x", "ſ ß Ÿ İ", "tab\x1cfoo", "x y\u0085z", "café café", "½²3 ١٢", "''' 're're"]
    odd += ["".join(rng.choice(list("abcdeist nr'.!0é-ÜÑ"), rng.integers(1, 50))) for _ in range(300)]
    more = documents.sparkSession.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    got = token_counts.op4(documents.select("doc_id", "text").unionByName(more)).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in [*texts, *((1000 + k, t) for k, t in enumerate(odd))])
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.op4(nothing).count() == 0


def test_mixing(documents, nothing, spark):
    got = mixing.op9(documents).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.op9(documents).collect()))
    assert len(got) == documents.count() and all(0 <= r.taken <= 3 * r["size"] for r in got)
    size, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        largest[r.source] = max(largest[r.source], r["size"])
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {r.source: r.source_size for r in got} == dict(size)
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    # A source of a few documents can miss by half of its largest.
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + largest[s] / 2 + 3 for s in size)
    assert mixing.op9(nothing).count() == 0


def test_targets_are_capped(spark):
    rows = [("a", 10), ("b", 1000), ("c", 500), ("d", 0), ("e", 900), (None, 4000)]  # d has a place, and its weight
    want, left = {"d": 0}, {s: n for s, n in rows if n}
    order = ["a", "b", "c", "d", "e", None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = sum(n for _, n in rows)
    while True:
        level = (total - sum(want.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 3 * left[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * left.pop(s)
    want |= {s: weight[s] * level for s in left}
    df = spark.createDataFrame([(s, n, 1) for s, n in rows], "source string, source_size long, docs long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(want)


def test_flights_keep_sums():
    import random

    rng = random.Random(1)
    size = [float(rng.randint(1, 500)) for _ in range(300)]
    p = mixing.flight([0.37] * 300, size, rng)
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(0.37 * 300) and sum(a * b for a, b in zip(p, size)) == pytest.approx(0.37 * sum(size))


@pytest.fixture(scope="module")
def learning(spark):
    rng = np.random.default_rng(6)
    tongue = {"aa": "tion ing the er st".split(), "bb": "eau oi que ment ai".split(), "cc": "ción os ado que ñ".split()}
    docs, labels = [], []
    for k in range(360):
        lang = "aa bb cc".split()[k % 3]
        w = ["".join(rng.choice(tongue[lang], rng.integers(1, 4))) for _ in range(rng.integers(30, 90))]
        toxic, bad = int(rng.random() < 0.3), int(rng.random() < 0.4)
        if toxic:
            w[int(rng.integers(len(w)))] = "vile"
            w[int(rng.integers(len(w)))] = "awful"
        if bad:
            w = [x + "$$$" for x in w]
        docs.append((k, " ".join(w), lang))
        if k % 4 and k > 5:
            labels.append((k, 1 - bad, toxic))
    docs += [(1000, None, None), (1001, "", "aa"), (1002, "123 !!", "aa"), (1003, "日本", None), (None, "tioning the", "aa"), (7, docs[7][1], docs[7][2])]
    labels += [(9999, 1, 1), (8, None, None), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def crc(i, m):
    return 0 if i is None else zlib.crc32(str(i).encode()) % m


def test_language(learning, nothing):
    docs, _ = learning
    got = language.op3(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == docs.count() and all(r.held_out == (crc(r.doc_id, 5) == 0) for r in got if r.doc_id is not None)
    real = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in real]) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[1000].lang_pred == by[1001].lang_pred == by[1002].lang_pred == "und" and by[1003].lang_pred in ("aa", "bb", "cc")
    assert all(0 <= r.score <= 1 for r in got)
    assert language.op3(nothing).count() == 0


def test_language_gradients():
    model = language.LanguageModel(["a", "b"], hidden=3)
    b = np.random.default_rng(0).integers(97, 105, (6, 4)).astype(np.uint8)
    y = np.array([0, 1, 1, 0])
    _, grads = model.gradients(b, y)
    for p, g in zip(model.params(), grads):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[k]
        p[k] = old + 1e-2
        up = model.gradients(b, y)[0]
        p[k] = old - 1e-2
        down = model.gradients(b, y)[0]
        p[k] = old
        assert (up - down) / 2e-2 == pytest.approx(g[k], rel=0.05, abs=1e-4)
    text = np.frombuffer(b"abcde fgh" * 40, np.uint8)
    right, _ = model.to_right.forward(text[:256, None])
    left, _ = model.to_left.forward(text[255::-1, None])
    logit = np.concatenate([right, left[::-1]], 2)[:, 0] @ model.v + model.c
    p = np.exp(logit) / np.exp(logit).sum(1, keepdims=True)
    letters = language.LETTER[text[:256]]
    assert np.allclose(model.probabilities(text[:256], np.array([0, 256]))[0], p[letters].mean(0), atol=1e-4)


def test_toxicity(learning, nothing):
    docs, labels = learning
    got = toxicity.op6(docs, labels).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert np.mean([r.predicted == int("vile" in text[r.doc_id]) for r in held]) > 0.95
    again = {r.doc_id: r.score for r in toxicity.op6(docs.repartition(3), labels).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in got)
    assert toxicity.op6(nothing, labels).count() == 0 and toxicity.op6(docs, labels.limit(0)).count() == docs.count()


def test_quality(learning, nothing):
    docs, labels = learning
    got = quality.op7(docs, labels).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count() and all(r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert np.mean([r.predicted == int("$$$" not in text[r.doc_id]) for r in held]) > 0.9
    assert quality.op7(nothing, labels).count() == 0 and quality.op7(docs, labels.limit(0)).count() == docs.count()


def test_secrets(spark, nothing):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'the config has token = "{key}" and more'), (2, "commit 1234567890123456 of the order"), (3, None), (4, ""), (5, "word " * 20000 + f"api_key: {key[:32]} end"), (None, f"password='{key}'"), (6, "id " + "0" * 16), (6, "id " + "0" * 16)]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, length double, value string")
    model = secrets.train(secrets.labelled_findings(spark, 1500), trees=15, depth=6)
    got = secrets.scan(docs, model).collect()
    assert {(r.doc_id, r.secret) for r in got} == {(1, True), (2, False), (5, True), (None, True), (6, False)}
    assert len(got) == 6 and {r.value_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(key.encode()).hexdigest()}
    clean = {r.doc_id: r.text for r in secrets.redacted(docs, model).collect()}
    assert key not in clean[1] and "<secret>" in clean[1] and clean[2] == rows[1][1]
    assert secrets.scan(nothing, model).count() == 0


def test_pipeline(spark, tmp_path, learning):
    import corpus_pipeline

    docs, labels = learning
    full = docs.select("*", F.concat(F.lit("s"), (F.coalesce("doc_id", F.lit(0)) % 2).cast("string")).alias("source"), F.length("text").cast("long").alias("n_chars"))
    full.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, full.filter("doc_id = 20").first().text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r.doc_id for r in out}
    text = {r.doc_id: r.text or "" for r in full.collect()}
    assert 20 not in left and len(left) == len(out) > 150
    assert np.mean(["vile" in text[i] for i in left]) < 0.02
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == full.columns


def test_names_of_long_texts_come_from_short_plans(spark, monkeypatch):
    """Whatever the number of levels, no stored step joins the steps of two levels: each level is a table of its own."""
    from quillon.llm import exact_dedup

    joins, stored = [], exact_dedup.written

    def counted(df, name, *by):
        joins.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Join ")))
        return stored(df, name, *by)

    monkeypatch.setattr(exact_dedup, "written", counted)
    texts = ["x" * 40, "x" * 40, "".join(map(chr, range(65, 105))), "y", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs, block=2).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 5, 5: 5}
    assert max(n for _, n in joins) <= 4, joins
