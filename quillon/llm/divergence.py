"""How the sources of a language differ in their words, by an integer dictionary of the kept terms.

Terms are counted once, by slices of texts. The counts are dealt out by ranges of (language, term): a task sees a range
in UTF-8 order, keeps the terms of enough documents, and cuts them into chunks. A chunk is a sorted array of terms, whose
places are their ids (searchsorted), and a count vector for each group that has any of them. Chunk and id preserve the
order of the terms, so ties need no strings. Pairs of sources are compared chunk by chunk on dense vectors, a block of
sources against a block, and summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, byte_slices, discard, encoded, numbers, table_of, words, written

LETTERS = table_of([c for c in range(256) if c >= 128 or chr(c).isalpha()])
#: Documents of a language that a term has to be in, the number added to each count, and the scale of shares.
LEAST_DOCS, ADDED, SCALE_STEPS = 30, 5, 3
#: Terms of a chunk and sources of a block: what a task holds is bounded by their product.
CHUNK, BLOCK = 4096, 256
#: Bytes of text that are counted at once.
SLICE = 1 << 23


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.cast(pa.string()).fill_null("").dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs; each group also has a row of the term '', with zeros, which no text has.

    Null text, lang and source count as ''. A slice of texts is counted by one bincount over ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in byte_slices(batch, limit=SLICE):
                part = batch.slice(lo, hi - lo)
                lang, langs = _codes(part["lang"])
                source, sources = _codes(part["source"])
                group, groups = numbers(lang * len(sources) + source)
                low = LOWER[buf]
                start, end, row = words(low, offs, LETTERS)
                ids, known = encoded(low, start, end, LETTERS[low])
                width = max(1, len(known))
                seen, in_docs = numbers(row * width + ids)  # a term of a document
                place, terms = numbers(group[in_docs // width] * width + in_docs % width)  # a term of a group
                n = np.bincount(place, weights=np.bincount(seen), minlength=len(terms)).astype(np.int64)
                docs = np.bincount(place, minlength=len(terms))
                of = np.concatenate([groups[terms // width], groups])
                text = pa.chunked_array([known.take(pa.array(terms % width)).cast(pa.string()), pa.array([""] * len(groups))]).combine_chunks()
                none = np.zeros(len(groups), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(of // len(sources))), sources.take(pa.array(of % len(sources))), text, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs, none]))],
                    ["lang", "source", "term", "n", "docs"],
                )

    rows = documents.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _rises(t: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row of a sorted table differs from the one before in any of the columns."""
    out = np.ones(t.num_rows, bool)
    if t.num_rows > 1:
        out[1:] = np.logical_or.reduce([pc.not_equal(t[c].slice(1), t[c].slice(0, t.num_rows - 1)).to_numpy() for c in columns])
    return out


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


CHUNKS = "lang string, chunk long, source string, own long, ids array<int>, n array<long>, total array<long>, terms array<string>"


def _chunk(t: pa.Table, chunk: int) -> pa.RecordBatch:
    """Rows of one language -> a row for each source (ids, n, and the language's total of each id) and one of the terms."""
    term = t["term"].cast(pa.binary()).to_numpy(zero_copy_only=False)
    kept = term[_rises(t, ["term"])]
    ids = np.searchsorted(kept, term)
    n = t["n"].to_numpy()
    source, sources = _codes(t["source"].combine_chunks())
    total = np.zeros(len(kept), np.int64)
    np.add.at(total, ids, n)
    order = np.lexsort((ids, source))
    ids, n, counts = ids[order], n[order], np.bincount(source)
    own = np.add.reduceat(n, np.cumsum(counts) - counts)
    m = len(sources)
    lists = [_lists(x, np.append(counts, 0), k) for x, k in ((ids, pa.int32()), (n, pa.int64()), (total[ids], pa.int64()))]
    terms = _lists(kept, np.append(np.zeros(m, int), len(kept)), pa.binary()).cast(pa.list_(pa.string()))
    lang = pa.array([t["lang"][0].as_py()] * (m + 1))
    return pa.RecordBatch.from_arrays(
        [lang, pa.array([chunk] * (m + 1), pa.int64()), pa.array([*sources.to_pylist(), None], pa.string()), pa.array([*own.tolist(), 0]), *lists, terms],
        ["lang", "chunk", "source", "own", "ids", "n", "total", "terms"],
    )


def chunked(counts: DataFrame, least_docs: int = LEAST_DOCS, size: int = CHUNK) -> DataFrame:
    """CHUNKS: the kept terms of each language in chunks of up to `size`, and the counts of the groups in them, as a stored table.

    A row without a source holds a chunk's terms. Chunks are numbered in the order of their terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        carry, held, n_held = None, [], 0

        def flush():
            nonlocal number, held, n_held
            if held:
                yield _chunk(pa.concat_tables(held), number)
                number, held, n_held = number + 1, [], 0

        for batch in chain(batches, [None]):
            new = pa.Table.from_batches([batch]) if batch is not None else None
            t = pa.concat_tables([x for x in (carry, new) if x is not None]) if carry is not None or new is not None else None
            if t is None or not t.num_rows:
                continue
            starts = _rises(t, ["lang", "term"])
            if batch is not None:  # the last term may go on
                cut = int(np.flatnonzero(starts)[-1])
                t, carry, starts = t.slice(0, cut), t.slice(cut).combine_chunks(), starts[:cut]
            term = np.cumsum(starts) - 1
            docs = np.zeros(int(starts.sum()), np.int64)
            np.add.at(docs, term, t["docs"].to_numpy())
            t = t.filter(pa.array((docs >= least_docs)[term]))
            if not t.num_rows:
                continue
            langs, terms = _rises(t, ["lang"]), np.cumsum(_rises(t, ["lang", "term"])) - 1
            edges = np.append(np.flatnonzero(langs), t.num_rows)
            for lo, hi in zip(edges[:-1], edges[1:]):
                if held and held[-1]["lang"][0].as_py() != t["lang"][int(lo)].as_py():
                    yield from flush()
                while lo < hi:
                    last = int(np.searchsorted(terms[:hi], terms[lo] + size - n_held))
                    held.append(t.slice(int(lo), last - int(lo)))
                    n_held += int(terms[last - 1] - terms[lo]) + 1
                    lo = last
                    if n_held == size:
                        yield from flush()
        yield from flush()

    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counts.repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term", "source")
    return written(rows.select("lang", "source", "term", "n", "docs").mapInArrow(run, CHUNKS), "chunks")


def group_sizes(counts: DataFrame, chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, size (its kept occurrences), idx (in UTF-8 order, from 0), block, blocks, all (of the language), width (its kept terms)."""
    groups = counts.filter("term = ''").select("lang", "source")
    own = chunks.filter("source is not null").groupBy("lang", "source").agg(F.sum("own").alias("size"))
    width = chunks.filter("source is null").groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("width"))
    rows = groups.join(own, ["lang", "source"], "left").join(width, "lang", "left").fillna(0, ["size", "width"])
    of = Window.partitionBy("lang")
    rows = rows.withColumn("idx", F.row_number().over(of.orderBy("source")) - 1).withColumn("all", F.sum("size").over(of)).withColumn("block", F.expr(f"cast(idx div {block} as int)"))
    return written(rows.withColumn("blocks", F.max("block").over(of) + 1), "groups")


def shares(count: np.ndarray, size: int, width: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (size + 5 width)), by long division in steps of 1000: exact up to sizes of 9 * 10^15."""
    rest, whole = count + ADDED, size + ADDED * width
    out = np.zeros_like(rest)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def top_terms(chunks: DataFrame, groups: DataFrame, top: int = 50) -> DataFrame:
    """lang, source, item, value, rank: the terms whose share in the group exceeds that in the language most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch[c].values.to_numpy(zero_copy_only=False) for c in ("ids", "n", "total")]
            offs = batch["ids"].offsets.to_numpy()
            meta = [batch[c].to_pylist() for c in ("size", "all", "width")]
            found, counts = [], []
            for k, (size, everything, width) in enumerate(zip(*meta)):
                ids, n, total = (x[offs[k] : offs[k + 1]] for x in lists)
                more = shares(n, size, width) - shares(total, everything, width)
                best = np.lexsort((ids, -more))[:top]
                best = best[more[best] > 0]
                found.append((ids[best], more[best]))
                counts.append(len(best))
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            ids, value = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in ("lang", "source", "chunk")), pa.array(ids, pa.int32()), pa.array(value, pa.int64())], ["lang", "source", "chunk", "id", "value"])

    rows = chunks.filter("source is not null").select("lang", "source", "chunk", "ids", "n", "total").join(groups.select("lang", "source", "size", "all", "width"), ["lang", "source"])
    best = rows.mapInArrow(run, "lang string, source string, chunk long, id int, value long")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "chunk", "id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    terms = chunks.filter("source is null").select("lang", "chunk", F.posexplode("terms").alias("id", "item"))
    return best.join(terms, ["lang", "chunk", "id"]).select("lang", "source", "item", "value", "rank")


def source_distances(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: the summed differences of each source of a language to each other one."""
    key = ["lang", "chunk", "b1", "b2"]
    sizes = groups.groupBy("lang", "block", "width").agg(F.array_sort(F.collect_list(F.struct("idx", "size"))).alias("members"))  # BLOCK at most
    one, two = (sizes.select("lang", F.col("block").alias(f"b{k}"), F.col("members").alias(f"m{k}"), *(["width"] if k == 1 else [])) for k in (1, 2))
    blocks = one.join(two, "lang").filter("b1 <= b2")
    terms = chunks.filter("source is null").select("lang", "chunk", F.size("terms").alias("terms"))
    work = blocks.join(terms, "lang", "left").fillna({"chunk": -1, "terms": 0})
    rows = chunks.filter("source is not null").select("lang", "chunk", "source", "ids", "n").join(groups.select("lang", "source", "idx", "block", "blocks"), ["lang", "source"])
    rows = rows.select("lang", "chunk", "idx", "block", "ids", "n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("lang", "chunk", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "idx", "ids", "n")

    def compare(job: pa.Table, own: pa.Table) -> pa.Table:
        job = job.to_pylist()[0]
        at = {m["idx"]: m["size"] for m in (*job["m1"], *job["m2"])}
        dense = {k: np.repeat(shares(np.zeros(1, np.int64), size, job["width"]), job["terms"]) if job["terms"] else np.zeros(0, np.int64) for k, size in at.items()}
        own = own.combine_chunks()
        for k, i in enumerate(own["idx"].to_pylist()):
            dense[i][own["ids"][k].values.to_numpy()] = shares(own["n"][k].values.to_numpy(), at[i], job["width"])
        left, right = ([m["idx"] for m in job[x]] for x in ("m1", "m2"))
        table = np.stack([dense[j] for j in right])
        out = [np.abs(table - dense[i]).sum(axis=1) for i in left]
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        once = i < j
        return pa.table({"lang": pa.array([job["lang"]] * int(once.sum()), pa.string()), "i": pa.array(i[once], pa.int32()), "j": pa.array(j[once], pa.int32()), "value": pa.array(np.concatenate(out)[once], pa.int64())})

    parts = work.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(compare, "lang string, i int, j int, value long")
    sums = parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("x")).select("lang", "x.i", "x.j", "value")
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "i").orderBy(F.col("value").desc(), "j")))
    names = groups.select("lang", "idx", "source")
    both = both.join(names.withColumnRenamed("idx", "i"), ["lang", "i"])
    return both.join(names.select("lang", F.col("idx").alias("j"), F.col("source").alias("item")), ["lang", "j"]).select("lang", "source", "item", "value", "rank")


def divergence(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = 50, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: for each group, its distance to each other source of its language (part
    `pair`) and the terms it has most above the language's share (part `term`, ranks to `top`).

    Terms are runs of letters of ASCII and of all characters above it, A-Z in lower case; a language keeps those in at
    least least_docs of its documents. Null text, lang and source count as ''. A group without kept terms is compared
    like others; in a language without kept terms all distances are 0. A language with one source has no pairs. Ties go
    by the item in UTF-8 order. Every row is a document, repeated ones too; doc_id is not read, texts are read whole, and
    other columns are ignored. An empty table gives an empty result.
    """
    counts = written(term_counts(documents.select("lang", "source", "text")), "terms")
    chunks = chunked(counts, least_docs, chunk)
    groups = group_sizes(counts, chunks, block)
    discard(counts)
    pair = source_distances(chunks, groups).withColumn("part", F.lit("pair"))
    out = pair.unionByName(top_terms(chunks, groups, top).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op11(documents: DataFrame) -> DataFrame:
    """`divergence` of documents: terms of 30 documents of a language, 50 terms a group."""
    return divergence(documents)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS width FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (size + 5 * width) AS p FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // ((SELECT sum(size) FROM g WHERE g.lang = p.lang) + 5 * any_value(width)) AS q FROM p JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""
