"""Importance resampling towards a target distribution over hashed n-grams, with an integer dictionary of words.

The words of a slice of texts get integer ids. An n-gram is a tuple of ids; each distinct tuple of a slice is hashed
once, over its bytes (a crc32 runs on: the bytes of (i, j, k) are those of (i, j), a space and word k), and its bucket
is joined back to the places by the tuple's number. A dictionary of the whole corpus would have no size bound and would
send every n-gram through a shuffle; only counts per bucket leave a task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_slices, encoded, numbered, numbers, ranked_rows, row_spans, row_sums, spare, table_of, words, written

LETTERS = table_of([c for c in range(256) if c >= 128 or chr(c).isalnum()])
BUCKETS, LONGEST = 10_000, 3
#: Documents of fewer words are not drawn.
LEAST_WORDS = 20


def features(buf: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per row and, for each length from 1 to `longest`, (bucket, row) of the runs of so many words; A-Z in lower case."""
    low = LOWER[buf]
    start, end, row = words(low, offs, LETTERS)
    ids, known = encoded(low, start, end, LETTERS[low])
    known = known.to_pylist()
    spaced = [b" " + w for w in known]
    at, number, crcs, out = np.arange(len(ids)), ids, list(map(zlib.crc32, known)), []
    for n in range(longest):
        if n:  # number is that of the run of n words at each place; it grows by one word of the same row
            more = at + n < len(row)
            more[more] = row[at[more]] == row[at[more] + n]
            at = at[more]
            number, tuples = numbers(number[more] * max(1, len(known)) + ids[at + n])
            shorter, last = divmod(tuples, max(1, len(known)))
            crcs = list(map(zlib.crc32, map(spaced.__getitem__, last.tolist()), map(crcs.__getitem__, shorter.tolist())))
        out.append(((np.array(crcs, np.int64) % buckets)[number], row[at]))
    return np.diff(row_spans(row, len(offs) - 1)), out


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: the features of all texts; a task sends one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, buf, offs in byte_slices(batch):
                for found, _ in features(buf, offs, buckets, longest)[1]:
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """1000 times the log of the target's to the source's smoothed share of each bucket, rounded down; one row a bucket is collected."""
    s, t = ([0] * buckets for _ in range(2))
    for counts, found in ((s, source), (t, target)):
        for r in found.collect():
            counts[r["bucket"]] = r["n"]
    a, b = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((y + 1.0) * a / ((x + 1.0) * b))) for x, y in zip(s, t)], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """1000 times a standard Gumbel number that is a function of seed and doc_id (null: as ''), rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(documents: DataFrame, gain: np.ndarray, seed: int, longest: int = LONGEST) -> DataFrame:
    """doc_id, text and any other columns -> these without text, and n_words, n_features, weight, score."""
    rest = [c for c in documents.columns if c != "text"]
    schema = ", ".join(f"`{c}` {t}" for c, t in documents.select(*rest).dtypes) + ", n_words long, n_features long, weight long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in byte_slices(batch):
                n_words, found = features(buf, offs, len(gain), longest)
                n_features, weight = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for bucket, row in found:
                    spans = row_spans(row, hi - lo)
                    n_features += np.diff(spans)
                    weight += row_sums(gain[bucket], spans)
                part = batch.slice(lo, hi - lo)
                extra = np.array([noise(x, seed) for x in part["doc_id"].to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in rest), *map(pa.array, (n_words.astype(np.int64), n_features, weight, weight + extra))], [*rest, "n_words", "n_features", "weight", "score"])

    return documents.select(*rest, "text").mapInArrow(run, schema)


def resample(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = 42, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank, n_words; rank is null for what is not drawn.

    Of the documents with at least `least_words` words, `percent` in a hundred (rounded down) are drawn without
    replacement: those with the highest weight plus Gumbel noise. Words are runs of letters and digits of ASCII and of
    all characters above it, A-Z in lower case; features are all runs of 1 to `longest` words, repeats counted. Ties go
    to the smaller doc_id, null last, and then to either row. Null and empty texts have no words: features and weight
    are 0. Repeated rows and doc_ids are rows each, with the same noise. Texts are read whole; other columns are
    ignored. An empty table gives an empty result; with an empty target the gains are those of equal shares.
    """
    gain = gains(bucket_counts(documents, buckets, longest), bucket_counts(target, buckets, longest), buckets)
    rows = written(scored(documents.select("doc_id", "text"), gain, seed, longest).withColumn("row", F.monotonically_increasing_id()), "scored")
    out = _ranked(rows, percent, least_words)
    out = out.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def _ranked(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """The rows with enough words, and their rank if they are drawn."""
    fit = rows.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    return ranked_rows(fit, order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))


def selected(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = 42) -> DataFrame:
    """The drawn rows of documents, with all their columns, whatever their names; nulls, ties and repeated rows as in `resample`."""
    docs, row = numbered(documents, "rows")
    own = docs.select(F.col(row).alias("row"), "doc_id", "text")
    rows = written(scored(own, gains(bucket_counts(docs), bucket_counts(target)), seed), "scored")
    keep = _ranked(rows, percent, least_words).filter("rank is not null").select(F.col("row").alias(spare(docs.columns, "drawn_")))
    return docs.join(keep, docs[row] == keep[keep.columns[0]], "left_semi").drop(row)


def op13(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`resample` of documents towards the benchmark: 5 in a hundred, 10,000 buckets, runs of 1 to 3 words."""
    return resample(documents, benchmark)
