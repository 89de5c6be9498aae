"""Shared pieces of the corpus operators: shared-folder tables, Arrow batches as byte arrays, hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Whitespace of the word rules: space and the six control characters from tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
#: Keys that hold more than this share of all rows are hot; there are fewer of them than its inverse.
HOT = 512


@cache
def _local_dir() -> str:
    own = tempfile.TemporaryDirectory(prefix="quillon-")
    atexit.register(own.cleanup)
    return own.name


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a local one, for a local session only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remove(spark: SparkSession, path: str) -> None:
    """At the end of the process: results may be read from a stored table until then."""
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended: its folder is left to whoever gave it
        pass


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Registers a path of the shared folder for removal when the process ends."""
    atexit.register(_remove, spark, path)


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder, one folder a value of `by`: it cuts the lineage and outlives lost executors.

    The table is removed by `discard`, or when the process ends.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    remove_at_exit(df.sparkSession, path)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that `written` gave, once all that was made from them is itself stored."""
    for t in tables:
        _remove(t.sparkSession, t.stored_at)


def discard_path(spark: SparkSession, path: str) -> None:
    """The same for a path given to `remove_at_exit`."""
    _remove(spark, path)


def spare(columns: list[str], name: str) -> str:
    """name, lengthened until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a stored table with a number for each row, and the name of that column.

    Rows are decided and found again by it: a doc_id may be null or repeat.
    """
    row = spare(df.columns, "row_")
    return written(df.withColumn(row, F.monotonically_increasing_id()), name), row


def keyed_join(rows: DataFrame, values: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """rows with the values of their key. `values` has one row per key; `weight` is the key's number of rows, of `total`.

    Keys with more than 1/HOT of all rows, fewer than HOT of them, come by a broadcast, so that no task gets all rows of
    one; the others by a shuffle. Both tables are read more than once: rows should be stored.
    """
    hot, cold = (values.filter(x).drop(weight) for x in (F.col(weight) * HOT > total, F.col(weight) * HOT <= total))
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold.hint("merge"), on))


def sampled_rows(documents: DataFrame, keys: DataFrame, by: list[str], most: int, *order: str) -> DataFrame:
    """doc_id, text and the columns of keys, for at most `most` texts of each value of `by`, by `order`: a bounded sample.

    keys: doc_id, by and order, one row a doc_id and value of `by`, of bounded number. A doc_id may repeat: rows that
    share doc_id and text count once. Texts are chosen by their hash; only the chosen ones move.
    """
    docs = documents.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    found = docs.select("doc_id", "th").join(F.broadcast(keys), "doc_id").distinct()
    first = lambda d, *g: d.withColumn("nth", F.row_number().over(Window.partitionBy(*g).orderBy(*order, "doc_id", "th"))).filter(F.col("nth") <= most).drop("nth")
    found = first(first(found.withColumn("part", F.pmod("th", F.lit(16))), *by, "part"), *by).drop("part")
    names = [c for c in keys.columns if c != "doc_id"]
    return docs.join(F.broadcast(found), ["doc_id", "th"]).groupBy("doc_id", "th", *names).agg(F.first("text").alias("text")).drop("th")


def fold(column: str, mod: int) -> Column:
    """crc32 of the key as text, modulo mod; 0 for a null key."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % mod, F.lit(0))


def byte_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 21):
    """Yields (first row, last row, bytes, offsets): runs of rows of about `limit` bytes, one row at least.

    A null text counts as empty. The bytes are a view of Arrow's buffer.
    """
    col = batch.column(column)
    if not pa.types.is_string(col.type) and not pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


_POW = np.ones(1, U64)
_BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2^64."""
    global _POW
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            _POW = np.concatenate([np.ones(1, U64), np.cumprod(np.full(max(n, 2 * len(_POW), 64) - 1, _BASE, U64))])
    return _POW[:n]


def table_of(chars) -> np.ndarray:
    """A boolean table of 256 byte values."""
    out = np.zeros(256, bool)
    out[np.frombuffer(bytes(chars), np.uint8)] = True
    return out


IS_SPACE = table_of(SPACE.encode())
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray | None = None):
    """(start, end, row) of each run of word bytes; runs never cross rows."""
    inside = (is_word[buf] if is_word is not None else ~IS_SPACE[buf])
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(len(buf) + 1, bool)
    first[offs[:-1]] = True
    prev = np.empty(len(buf), bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~prev | first[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    if len(end) < len(start):  # the last row may end inside a word
        end = np.append(end, len(buf))
    row = np.searchsorted(offs, start, "right") - 1
    return start, end, row


def encoded(buf: np.ndarray, start: np.ndarray, end: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Integer ids of the words and their dictionary (binary), in order of first appearance; `inside` marks word bytes."""
    offs = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words_ = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(buf[inside]))])
    found = words_.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each integer key and the distinct keys, in order of first appearance."""
    found = pa.array(keys).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_numpy()


def ranked_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a column `name`: the row's rank from 1 in `order`, which tells all rows apart.

    Rows are sorted by ranges; a rank is the number of rows in the ranges before and the place in its own, so that no
    task holds more than a range. The driver gets one count a range.
    """
    part, n = spare(df.columns, "part_"), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "ranks")
    rows = rows.withColumn(part, F.shiftright(name, 33)).withColumn(name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted(tuple(r) for r in rows.groupBy(part).agg(F.count("*")).collect())
    before, total = [], 0
    for k, x in sizes:
        before.append((k, total))
        total += x
    starts = df.sparkSession.createDataFrame(before, f"{part} long, start_{part} long")
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(name) + F.col(f"start_{part}") + 1).drop(part, f"start_{part}")


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from a polynomial of its bytes and its length."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(int(size.sum())) + np.repeat(start - begin, size)
    k = at - np.repeat(start, size)
    with np.errstate(over="ignore"):
        terms = (buf[at].astype(U64) + U64(1)) * powers(int(size.max()))[k]
        return mix(np.add.reduceat(terms, begin) + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def row_spans(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the n rows in a sorted array of row numbers."""
    return np.searchsorted(row, np.arange(n + 1))


def row_sums(values: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Sum of values in each span; 0 for an empty one."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[spans[1:]] - total[spans[:-1]]
