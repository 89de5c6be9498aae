"""Exact duplicates by deterministic block naming (Karp, Miller and Rosenberg), in DataFrame operations only.

A text is cut into blocks of fixed size. The distinct blocks, sorted, get integer names; then adjacent pairs of names
are sorted and named, level by level, until each text has one name. Equal names of a level mean equal texts: a name
stands for one block or one pair only. A 64-bit hash routes blocks to their class, and classes that hold more than one
block are told apart by the blocks themselves, so that no name rests on a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keyed_join, numbered, spare, written

BLOCK = 4096


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys -> and name: the rank in the sorted order of a bucket, with the bucket in the high bits."""
    n = 4 * int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n))
    order = Window.partitionBy("_bucket").orderBy(*keys)
    return distinct.withColumn("_bucket", bucket).withColumn("name", F.shiftleft(F.col("_bucket"), 40) + F.row_number().over(order)).drop("_bucket")


def identities(documents: DataFrame, block: int = BLOCK, hashed: Callable[[Column], Column] = F.xxhash64, row: str | None = None) -> DataFrame:
    """doc_id, text -> rid, doc_id, text_sha256, n_bytes, level, name; one row per row, as a stored table.

    Two rows have equal (level, name) exactly if their texts are equal. Null text counts as empty. `hashed` may be any
    function of a block: a poor one costs time, not correctness. rid is the column `row` of documents, else a number.
    Blocks and pairs that hold a large share of all rows get their names by a broadcast.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents.select(*([F.col(row).alias("rid")] if row else []), "doc_id", body.alias("body"))
    start = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.octet_length("body") - 1).cast("int")), F.lit(block))
    part = lambda i: F.substring("body", i + 1, F.lit(block))
    blocks = lambda df, *cols: df.select(*cols, F.posexplode(F.transform(start, part)).alias("idx", "block")).withColumn("h", hashed(F.col("block")).cast("long"))
    classes = blocks(docs).groupBy("h").agg(F.min("block").alias("lo"), F.max("block").alias("hi"), F.count("*").alias("times"))
    classes = written(classes.select("h", (F.col("lo") != F.col("hi")).alias("clash"), "times"), "classes")
    rid = F.col("rid") if row else F.monotonically_increasing_id().alias("rid")
    about = rid, "doc_id", F.sha2("body", 256).alias("text_sha256"), F.octet_length("body").cast("long").alias("n_bytes")
    if classes.filter("clash").isEmpty():
        base = written(docs.select(*about, F.transform(start, lambda i: hashed(part(i)).cast("long")).alias("hs")), "base")
        keyed = base.select("rid", F.posexplode("hs").alias("idx", "h"), F.size("hs").alias("n"), F.lit(1).alias("k"))
        names = classes.select("h", F.lit(1).alias("k"), "times")
    else:
        base = written(docs.select(*about, "body"), "base")
        rows = blocks(base, "rid", F.size(start).alias("n"))
        shared = rows.join(classes.filter("clash").select("h"), "h", "left_semi").groupBy("h", "block").agg(F.count("*").alias("times"))
        shared = written(shared.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("block"))), "clashes")
        keyed = rows.join(shared.drop("times"), ["h", "block"], "left").select("rid", "idx", "h", "n", F.coalesce("k", F.lit(0)).alias("k"))
        names = classes.filter(~F.col("clash")).select("h", F.lit(0).alias("k"), "times").unionByName(shared.select("h", "k", "times"))
    state = written(_renamed(keyed, names, ["h", "k"], classes.agg(F.sum("times")).first()[0] or 0), "names")
    used = [classes, base, state]
    longest, level = state.agg(F.max("n")).first()[0] or 1, 0
    done = [state.filter("n = 1").select("rid", F.lit(0).alias("level"), "name")]
    while longest > 1:
        pairs = written(_pairs(state), "pairs")
        # Stored, so that the driver never has the plans and broadcasts of all levels at once.
        distinct = written(_named(pairs.groupBy("a", "b").agg(F.count("*").alias("times")), ["a", "b"]), "distinct")
        state = written(keyed_join(pairs, distinct, ["a", "b"], "times", pairs.count()).select("rid", "idx", "n", "name"), "names")
        discard(pairs, distinct)
        used.append(state)
        longest, level = (longest + 1) // 2, level + 1
        done.append(state.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionByName(more)
    out = written(base.drop("hs", "body").join(ids, "rid"), "identities")
    discard(*used)
    return out


def _renamed(rows: DataFrame, distinct: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rid, idx, n and the name of the keys; `distinct` has the keys once, with `times`, their number of rows, of `total`."""
    return keyed_join(rows, _named(distinct, keys), keys, "times", total).select("rid", "idx", "n", "name")


def _pairs(state: DataFrame) -> DataFrame:
    """Adjacent names of each text, as (rid, idx, n, a, b); b is -1 after the last name of an odd number."""
    odd = F.col("idx") % 2 == 1
    up = state.filter("n > 1").withColumn("up", F.expr("idx div 2").cast("int")).groupBy("rid", "n", "up")
    found = up.agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b"))
    return found.select("rid", F.col("up").alias("idx"), F.expr("cast((n + 1) div 2 as int)").alias("n"), "a", "b")


def grouped(documents: DataFrame, row: str | None = None, **how) -> DataFrame:
    """The identities' columns with top (doc_id and rid of the row that stays) and group_size."""
    ids = identities(documents, row=row, **how)
    groups = written(ids.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count("*").alias("group_size")).withColumn("times", F.col("group_size")), "groups")
    total = groups.agg(F.sum("times")).first()[0] or 0
    return keyed_join(ids, groups, ["level", "name"], "times", total)


def exact_dedup(documents: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Of equal texts the row with the largest doc_id stays; null is below every doc_id, and of rows that also share the
    doc_id exactly one stays. Null text counts as empty, and texts of any length are read whole. Other columns of
    documents are ignored. An empty table gives an empty result.
    """
    out = grouped(documents.select("doc_id", "text"), **how)
    return out.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), "text_sha256", "n_bytes")


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows of documents that stay, with all their columns, whatever their names and types.

    Rows are told apart by a number of their own: of rows that are alike in everything exactly one stays. Nulls, empty
    texts and an empty table are as in exact_dedup.
    """
    docs, row = numbered(documents, "rows")
    gone = written(grouped(docs.select(row, "doc_id", "text"), row).filter("rid <> top.rid").select(F.col("rid").alias(spare(docs.columns, "gone_"))), "gone")
    return docs.join(gone, docs[row] == gone[gone.columns[0]], "left_anti").drop(row)


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256,
       strlen(coalesce(text, ''))::BIGINT AS n_bytes
FROM documents
"""
