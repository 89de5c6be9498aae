"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window of L words has the grams of k words that begin in it (k = 5: six grams for ten words). Its fingerprint is the
least hash of these and the place of that gram. Windows with equal words have equal hashes, so a join on fingerprints
misses no shared window. A match says where the window would begin; there it is extended to all its words and joined
once more by the words themselves.

Every text is cut into words once. Only (row, fingerprint, place) is exploded; the words of the few matched rows are
read again from the stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, numbered, spare, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is between words: all ASCII but letters and digits, one by one, which the regex engine keeps as a bit table.
BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
SPAN, GRAM = 10, 5
#: The low bits of a fingerprint hold the gram's place modulo 8, which tells the grams of a window apart.
PLACES = 8
#: Windows of the benchmark up to which they are broadcast (about 250 bytes each); beyond, the joins shuffle.
BROADCAST_SPANS = 200_000
#: Parts of a key in a shuffle join: a passage may be in a third of all documents.
SALTS = 16


def _words(text: Column) -> Column:
    """The words of a text with A-Z in lower case, other letters as they are (`lower` knows ASCII alone to be such)."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def _gram(span: int) -> int:
    return min(span, GRAM)


def _mask(x: Column) -> Column:
    return x.bitwiseAND(F.lit(-PLACES).cast("long"))


def _grams(k: int) -> Column:
    """From the hashes `w` of the words: a hash of each k words, with its place modulo PLACES. The last k - 1 have fewer words."""
    own = lambda x, i: _mask(F.xxhash64(x, *(F.get("w", i + j) for j in range(1, k)))).bitwiseOR(i.bitwiseAND(F.lit(PLACES - 1)).cast("long"))
    return F.transform("w", own)


def _least(span: int, grams: str) -> Column:
    """The least gram of each window; empty for a text of fewer words."""
    k = _gram(span)
    least = lambda s: F.least(*(F.get(grams, s + i) for i in range(span - k + 1))) if span > k else F.get(grams, s)
    return F.when(F.col("n") >= span, F.transform(F.sequence(F.lit(0), F.col("n") - span), least)).otherwise(F.array().cast("array<bigint>"))


def _prints(least: str) -> Column:
    """(fp, at) of each run of windows with one least gram: its hash and its place in the text."""
    new = lambda x, s: (s == 0) | (x != F.get(least, s - 1))
    keep = F.transform(least, lambda x, s: F.when(new(x, s), F.struct(_mask(x).alias("fp"), (s + (x.bitwiseAND(F.lit(PLACES - 1).cast("long")).cast("int") - s).bitwiseAND(F.lit(PLACES - 1))).alias("at"))))
    return F.filter(keep, lambda x: x.isNotNull())


def fingerprinted(documents: DataFrame, spans: list[int], row: str) -> DataFrame:
    """row, n (words) and, for each window length, p<length>: the fingerprints of all its windows.

    Each step refers to the arrays of the one before more than once, so that Spark computes them once a row.
    """
    docs = documents.select(row, _words(F.col("text")).alias("raw"))
    docs = docs.select(row, F.size("raw").alias("n"), F.transform("raw", lambda x: F.xxhash64(x)).alias("w"))
    docs = docs.select(row, "n", *(_grams(k).alias(f"g{k}") for k in sorted({_gram(s) for s in spans})))
    docs = docs.select(row, "n", *(_least(s, f"g{_gram(s)}").alias(f"m{s}") for s in spans))
    return docs.select(row, "n", *(_prints(f"m{s}").alias(f"p{s}") for s in spans))


def item_spans(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """item, len, words (joined by spaces), fp, off: the windows of every item, as a stored table.

    off is the fingerprint's place in the window; a window in which its gram occurs more than once has a row for each.
    An item of fewer than `span` words is one window of its own length; one without words has none. A null item_id
    counts as ''.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _words(F.col("text")).alias("raw"))
    items = items.select("item", "raw", F.size("raw").alias("n"), F.transform("raw", lambda x: F.xxhash64(x)).alias("w")).filter("n > 0")
    rows = None
    for k in range(1, GRAM + 1):
        own = items.withColumn("len", F.least("n", F.lit(span))).filter(F.least("len", F.lit(GRAM)) == k)
        own = own.select("item", "raw", "n", "len", _grams(k).alias("g"))
        window = lambda s: F.struct(F.array_join(F.slice("raw", s + 1, F.col("len")), " ").alias("words"), F.transform(F.slice("g", s + 1, F.col("len") - (k - 1)), _mask).alias("g"))
        own = own.select("item", "len", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("len")), window)).alias("x"))
        own = own.select("item", "len", "x.words", F.array_min("x.g").alias("fp"), F.posexplode("x.g").alias("off", "gram")).filter("gram = fp").drop("gram")
        rows = own if rows is None else rows.unionByName(own)
    return written(rows.distinct(), "spans")


def _lookup(rows: DataFrame, known: DataFrame, on: list[str], few: bool, row: str) -> DataFrame:
    """rows joined with a table of the benchmark: broadcast up to a checked size, else by a shuffle on salted keys."""
    if few:
        return rows.join(F.broadcast(known), on)
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int")).join(known, [*on, "salt"]).drop("salt")


def _hits(docs: DataFrame, prints: DataFrame, spans: DataFrame, lengths: list[int], few: bool, row: str) -> DataFrame:
    """row, len, at, words: every occurrence of a window of the benchmark, as a stored table."""
    starts = None
    for n in lengths:
        places = prints.select(row, F.explode(f"p{n}").alias("x")).select(row, "x.fp", "x.at")
        found = _lookup(places, spans.filter(F.col("len") == n).select("fp", "off").distinct(), ["fp"], few, row)
        found = found.select(row, F.lit(n).alias("len"), (F.col("at") - F.col("off")).alias("at")).filter("at >= 0")
        starts = found if starts is None else starts.unionByName(found)
    starts = written(starts.groupBy(row).agg(F.collect_set(F.struct("len", "at")).alias("starts")), "starts")  # of a size that is known then
    texts = docs.select(row, "text").join(starts, row).select(row, "starts", _words(F.col("text")).alias("raw"))
    inside = F.filter("starts", lambda x: x["at"] + x["len"] <= F.size("raw"))
    there = F.transform(inside, lambda x: F.struct(x["len"].alias("len"), x["at"].alias("at"), F.array_join(F.slice("raw", x["at"] + 1, x["len"]), " ").alias("words")))
    rows = texts.select(row, F.explode(there).alias("x")).select(row, "x.len", "x.at", "x.words")
    hits = written(_lookup(rows, spans.select("len", "words").distinct(), ["len", "words"], few, row), "hits")
    discard(starts)
    return hits


def judged(docs: DataFrame, benchmark: DataFrame, row: str, broadcast_spans: int = BROADCAST_SPANS) -> tuple[DataFrame, DataFrame]:
    """(row and n, its words; row, n_hit and items of the rows with a hit); docs is a stored table."""
    spans = item_spans(benchmark)
    few = spans.count() <= broadcast_spans
    lengths = sorted({r["len"] for r in spans.select("len").distinct().collect()} | {SPAN})  # ten at most
    prints = written(fingerprinted(docs, lengths, row), "prints")
    hits = _hits(docs, prints, spans, lengths, few, row)
    sizes = written(prints.select(row, "n"), "sizes")
    discard(prints)
    # Overlapping windows count once: each adds what is beyond the furthest end before it.
    before = Window.partitionBy(row).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("len")
    runs = hits.groupBy(row, "at").agg(F.max("len").alias("len")).select(row, F.greatest(F.lit(0), end - F.greatest("at", F.coalesce(F.max(end).over(before), F.lit(0)))).alias("more"))
    n_hit = runs.groupBy(row).agg(F.sum("more").cast("long").alias("n_hit"))
    named = _lookup(hits.select(row, "len", "words").distinct(), spans.select("len", "words", "item").distinct(), ["len", "words"], few, row)
    items = named.groupBy(row).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return sizes, n_hit.join(items, row)


def decontaminate(documents: DataFrame, benchmark: DataFrame, broadcast_spans: int = BROADCAST_SPANS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of letters and digits of ASCII and of all characters above it, A-Z in lower case; null has none. A
    word is hit if it is in any occurrence of a window of ten words of an item (of the whole item, if that is shorter).
    A row is judged by its own text: null and repeated doc_ids, and repeated rows, are rows like others. Other columns
    are ignored. An empty table gives an empty result; without benchmark rows nothing is hit.
    """
    docs, row = numbered(documents.select("doc_id", "text"), "documents")
    sizes, found = judged(docs, benchmark, row, broadcast_spans)
    out = docs.select(row, "doc_id").join(sizes, row).join(found, row, "left")
    hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents without any hit, with all their columns, whatever their names; rows are told apart by number."""
    docs, row = numbered(documents, "rows")
    bad = written(judged(docs, benchmark, row)[1].select(F.col(row).alias(spare(docs.columns, "bad_"))), "bad")
    return docs.join(bad, docs[row] == bad[bad.columns[0]], "left_anti").drop(row)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, s, l, array_to_string(w[s : s + l - 1], ' ') AS g FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw))),
hit AS (SELECT rid, s, l, item FROM dw JOIN iw USING (l, g)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT rid, s, l FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
