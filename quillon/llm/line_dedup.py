"""Line dedup across documents by levelled sorted runs of line hashes, in DataFrame operations only.

A run is a table of line hashes, bucketed and sorted by them, one row a hash. Batches of documents come in the order of
their doc_ids, the largest first. Each batch merge-anti-joins the runs: a hash that none of them has is new, so the
batch's largest doc_id with it is the largest of all. Then the batch's own hashes become a run; two runs of a level are
compacted into one of the next. All runs share their buckets: neither the anti-join nor a compaction shuffles.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, discard, discard_path, keyed_join, numbered, remove_at_exit, shared_dir, spare, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line's hash: two 64-bit hashes, so that two of 10^12 different lines share both with a probability of 1e-15.
HASH = ["a", "b"]
#: Batches of op12: each is a job over its part of the hashes, of any size.
BATCHES = 4


def _key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case (`lower` knows ASCII alone to be such)."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(documents: DataFrame, row: str, min_chars: int) -> DataFrame:
    """row, doc_id and entries: (a, b, i), hash and place of each line of at least min_chars code points, sorted by hash."""
    entry = lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"), i.alias("i")))
    entries = F.filter(F.transform(F.transform(_lines(F.col("text")), _key), entry), lambda x: x.isNotNull())
    return documents.select(row, "doc_id", F.array_sort(entries).alias("entries"))


def line_counts(hashed: DataFrame) -> DataFrame:
    """a, b, docs (rows with the line), times (lines) and top (the largest doc_id), one row a hash."""
    same = lambda x, i: (i > 0) & (x["a"] == F.get("entries", i - 1)["a"]) & (x["b"] == F.get("entries", i - 1)["b"])
    marked = F.transform("entries", lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.when(same(x, i), 0).otherwise(1).alias("first")))
    rows = hashed.select("doc_id", F.explode(marked).alias("x")).select("doc_id", "x.a", "x.b", "x.first")
    return rows.groupBy(*HASH).agg(F.sum("first").alias("docs"), F.count("*").alias("times"), F.max("doc_id").alias("top"))


class LineRuns:
    """The runs of the batches so far: a, b, docs, times and top, as `line_counts` has them.

    top stands in the run of the first batch that has the line, the largest doc_id with it; it is null in later ones.
    The tables are bucketed ones in the shared folder, removed by `close`, or when the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self._names = spark, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _stored(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        remove_at_exit(self.spark, path)
        df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).option("compression", "zstd").saveAsTable(name)
        self._names.append((name, path))
        return name

    def add(self, counts: DataFrame) -> None:
        """Adds a batch's `line_counts`; its doc_ids are below those of all batches before."""
        own = self.spark.table(self._stored(counts))
        runs = [self.spark.table(name) for level in self.levels for name in level]
        new = reduce(lambda rest, run: rest.join(run.select(*HASH).hint("merge"), HASH, "left_anti"), runs, own)
        if runs:
            new = new.select(*HASH, F.lit(True).alias("new"))
            own = own.join(new.hint("merge"), HASH, "left").withColumn("top", F.when(F.col("new"), F.col("top"))).drop("new")
        self._push(self._stored(own), 0)

    def _push(self, name: str, level: int) -> None:
        """Puts a run on its level; two of a level become one of the next."""
        if level == len(self.levels):
            self.levels.append([])
        if self.levels[level]:
            self._push(self._merged(self.levels[level].pop(), name), level + 1)
        else:
            self.levels[level].append(name)

    def _merged(self, one: str, two: str) -> str:
        x, y = self.spark.table(one).alias("x"), self.spark.table(two).hint("merge").alias("y")
        total = lambda c: (F.coalesce(F.col(f"x.{c}"), F.lit(0)) + F.coalesce(F.col(f"y.{c}"), F.lit(0))).alias(c)
        both = x.join(y, HASH, "full_outer")
        return self._stored(both.select(*HASH, total("docs"), total("times"), F.greatest("x.top", "y.top").alias("top")))

    def merged(self) -> DataFrame | None:
        """All runs as one; None without any batch."""
        names = [name for level in self.levels for name in level]
        if not names:
            return None
        return self.spark.table(reduce(self._merged, names))

    def close(self) -> None:
        for name, path in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard_path(self.spark, path)
        self._names = []


def _cuts(docs: DataFrame, batches: int) -> list:
    """Up to batches - 1 doc_ids, ascending, that cut the table into parts of about equal size."""
    ids = docs.select("doc_id").filter("doc_id is not null").repartitionByRange(batches, "doc_id")
    tops = sorted(r["top"] for r in ids.groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("top")).collect())
    return sorted({tops[len(tops) * k // batches - 1] for k in range(1, batches) if len(tops) * k // batches})


def repeated_lines(docs: DataFrame, row: str, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """row, gone: the places of the lines that go, for each row that loses any; docs is a stored table."""
    cuts = _cuts(docs, batches)
    batch = sum((F.coalesce((F.col("doc_id") <= F.lit(c)).cast("int"), F.lit(1)) for c in cuts), F.lit(0))
    hashed = written(hashed_lines(docs, row, min_chars).withColumn("batch", batch), "lines", by=("batch",))
    runs = LineRuns(docs.sparkSession)
    for k in range(len(cuts) + 1):
        runs.add(line_counts(hashed.filter(F.col("batch") == k)))
    known = runs.merged()
    total = known.agg(F.sum("times")).first()[0] or 0
    lines = hashed.select(row, "doc_id", F.explode("entries").alias("x")).select(row, "doc_id", *(f"x.{c}" for c in (*HASH, "i")))
    found = keyed_join(lines, known.filter(F.col("docs") >= min_docs).drop("docs"), HASH, "times", total)
    out = written(found.filter(~F.col("doc_id").eqNullSafe(F.col("top"))).groupBy(row).agg(F.collect_list("i").alias("gone")), "gone")
    runs.close()
    discard(hashed)
    return out


def _without(docs: DataFrame, gone: DataFrame, row: str, other: list[str]) -> DataFrame:
    """other, n_lines, n_dropped, and text without the lines that go. The lines are cut once a row: they are used twice.

    Always a merge join: the lines that go grow with the documents, and have no size that would allow a broadcast.
    """
    rows = docs.join(gone.hint("merge"), row, "left").select(*other, F.coalesce("text", F.lit("")).alias("text_"), _lines(F.col("text")).alias("lines_"), "gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines_") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("text_")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines_", i)), "\n"))
    return rows.select(*other, F.size("lines_").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"))


def line_dedup(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (what stays of it).

    Lines are equal if they are without the white space at their ends and with A-Z in lower case. A line of at least
    min_chars code points, so changed, in at least min_docs documents goes everywhere but in the documents with the
    largest doc_id that has it. A null or empty text is one empty line and stays empty. Every row is a document, repeated
    ones too; null is below every doc_id, and rows with the doc_id that keeps a line all keep it. Texts of any length are
    read whole. Other columns are ignored. An empty table gives an empty result.
    """
    docs, row = numbered(documents.select("doc_id", "text"), "documents")
    return _without(docs, repeated_lines(docs, row, min_chars, min_docs, batches), row, ["doc_id"])


def cleaned_documents(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """documents with the repeated lines taken out of text, as in line_dedup; all rows and columns stay, whatever their names.

    A text that loses nothing stays as it is, null too.
    """
    docs, row = numbered(documents, "rows")
    gone = repeated_lines(docs.select(F.col(row).alias("row"), "doc_id", "text"), "row", min_chars, min_docs, batches)
    new = _without(docs.select(F.col(row).alias("row"), "text"), gone, "row", ["row"]).filter("n_dropped > 0")
    key, body = spare(docs.columns, "key_"), spare(docs.columns, "body_")
    out = docs.join(new.select(F.col("row").alias(key), F.col("text").alias(body)).hint("merge"), F.col(row) == F.col(key), "left")
    return out.select(*(F.coalesce(F.col(body), docs["text"]).alias("text") if c == "text" else docs[c] for c in documents.columns))


def op12(documents: DataFrame) -> DataFrame:
    """line_dedup at 40 code points and 5 documents, the text as kept_sha256: doc_id, n_lines, n_dropped, kept_sha256."""
    return line_dedup(documents).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
k AS (SELECT rid, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.top AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
