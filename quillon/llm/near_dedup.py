"""Near duplicates: fast similarity sketches, banding and exact verification on whole shingle sets.

A sketch has t coordinates. In round i every element is hashed to one coordinate with a value in [i, i + 1); from round
t on, round i + t fills coordinate i from all elements. The least value of each coordinate stays, so that every
coordinate is filled and equal coordinates estimate the similarity with concentration bounds. Rounds that cannot change
the sketch any more are left out.

Texts with the same shingle set are one class. Classes that share a band are joined into candidate groups; in a group
every pair is compared on full sets, in blocks of bounded size, so that a large group is many tasks. Links become
components by least labels.

With 36 bands of 7 coordinates a link at similarity 0.85 is missed with probability 1e-6, at 0.9 with 1e-10.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, byte_slices, discard, keyed_join, mix, numbered, powers, row_spans, spare, word_hashes, words, written

BANDS, ROWS, SHINGLE = 36, 7, 5
#: Shingles of a block: two blocks are in a task's memory at a time.
BLOCK = 1 << 17


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Each row's set of k-word shingles, as sorted 64-bit hashes; fewer words are one shingle, no words none."""
    low = LOWER[buf]
    start, end, row = words(low, offs)
    h = word_hashes(low, start, end)
    spans = row_spans(row, len(offs) - 1)
    with np.errstate(over="ignore"):
        runs = sum((h[j : len(h) - k + 1 + j] * U64(2 * j + 3) * powers(k + 1)[j + 1] for j in range(k)), np.zeros(max(0, len(h) - k + 1), U64))
        runs = mix(runs)
        out = []
        for lo, hi in zip(spans[:-1], spans[1:]):
            if hi - lo >= k:
                out.append(np.unique(runs[lo : hi - k + 1]))
            elif hi > lo:
                few = h[lo:hi]
                out.append(mix(np.array([(few * powers(k + 2)[2 : 2 + len(few)]).sum() + U64(hi - lo)], U64)))
            else:
                out.append(h[:0])
    return out


def _text_hash():
    """Routes a text to its row; what it finds is checked by the set."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")


_SEEDS = mix(np.arange(1, 1 << 12, dtype=U64))


def sketch(s: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of a nonempty set: the round in the high 16 bits, below it the value."""
    out = np.full(t, np.iinfo(np.uint64).max, U64)
    n, done = len(s), 0
    while True:
        # As many rounds at once as mostly fill all coordinates.
        count = int(min(max(1, np.ceil((np.log(t) + 2) * t / n) - done), max(1, (1 << 16) // n), max(1, t - done)))
        if done >= t:
            for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
                out[b] = (U64(t + int(b)) << U64(48)) | (mix(s ^ _SEEDS[t + int(b)]) >> U64(16)).min()
            return out
        h = mix(s[None, :] ^ _SEEDS[done : done + count, None])
        coord = ((h >> U64(32)) * U64(t) >> U64(32)).astype(np.int64)
        value = (np.arange(done, done + count, dtype=U64)[:, None] << U64(48)) | (h & U64(0xFFFFFFFF)) << U64(16) | (s >> U64(48))
        np.minimum.at(out, coord.ravel(), value.ravel())
        done += count
        if out.max() < np.iinfo(np.uint64).max:
            return out


def bands(values: np.ndarray, count: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band; different bands never share one but by chance."""
    with np.errstate(over="ignore"):
        x = mix(values.reshape(count, rows) + np.arange(1, rows + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        return mix((x * (U64(2) * np.arange(rows, dtype=U64) + U64(1))).sum(1) + np.arange(count, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _set_key(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([s.sum(), mix(s).sum(), (mix(s + U64(7)) * (s | U64(1))).sum()], U64).tobytes() if len(s) else b""


def sketched(documents: DataFrame, row: str, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """rid (the column `row`), doc_id, th (a hash of the text), n_shingles, set_key (of equal sets equal; empty for the
    empty set) and bands."""

    def run(batches):
        for batch in batches:
            sizes, keys, marks = [], [], []
            for _, _, buf, offs in byte_slices(batch, limit=1 << 20):
                for s in shingles(buf, offs):
                    sizes.append(len(s))
                    keys.append(_set_key(s))
                    marks.append(bands(sketch(s, count * rows), count, rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
            at = np.concatenate([[0], np.cumsum([len(m) for m in marks])]) if marks else np.zeros(1)
            flat = np.concatenate(marks) if marks else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "doc_id", "th")), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["rid", "doc_id", "th", "n_shingles", "set_key", "bands"])

    ids = documents.schema["doc_id"].dataType.simpleString()
    return documents.select(F.col(row).alias("rid"), "doc_id", "text", _text_hash()).mapInArrow(run, f"rid long, doc_id {ids}, th long, n_shingles long, set_key binary, bands array<long>")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Edges (a, b) -> (node, label): the least node that each node reaches; only nodes with an edge are given.

    Every node takes the least label of its neighbours, then that label's own label, until nothing changes; each round
    is a stored table, and only the number of changes goes to the driver. The label of a node with a large share of all
    edges, and the label of a label that a large share of all nodes has, come by a broadcast.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(both, f"{name}-edges")
    nodes = both.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("degree"))
    state = written(nodes.select(F.col("a").alias("node"), F.least("a", "b").alias("label"), "degree"), f"{name}-labels")
    size, last = state.agg(F.sum("degree").alias("edges"), F.count("*").alias("nodes")).first(), [state]
    while True:
        labels = state.select(F.col("node").alias("b"), F.col("label").alias("l"), "degree")
        near = keyed_join(both, labels, ["b"], "degree", size["edges"] or 0).groupBy("a").agg(F.min("l").alias("l"))
        new = state.join(near, state["node"] == near["a"], "left").select("node", "degree", F.col("label").alias("old"), F.least("label", F.coalesce("l", "label")).alias("label"))
        new = written(new, f"{name}-near")
        last.append(new)
        ups = new.groupBy("label").agg(F.count("*").alias("times")).join(new.select(F.col("node").alias("label"), F.col("label").alias("up")), "label")
        new = written(keyed_join(new, ups, ["label"], "times", size["nodes"]).select("node", "degree", "old", F.least("label", "up").alias("label")), f"{name}-labels")
        done = new.filter("label < old").isEmpty()
        discard(*last)
        if done:
            discard(both)
            return new
        state, last = new.select("node", "label", "degree"), [new]


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links (100 * intersection >= percent * union) among the sets of a and b."""
    na, nb = len(a), len(b)
    parent = list(range(na + (0 if same else nb)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    flat = np.concatenate(b)
    elements, code = np.unique(flat, return_inverse=True)
    sizes = np.array([len(s) for s in b])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    mark, out = np.zeros(len(elements), bool), []
    for i, s in enumerate(a):
        at = np.searchsorted(elements, s)
        at = at[(at < len(elements))]
        at = at[np.isin(elements[at], s, assume_unique=True)]
        mark[at] = True
        j0 = i + 1 if same else 0
        if j0 < nb:
            common = np.add.reduceat(mark[code[begin[j0] :]], begin[j0:-1] - begin[j0], dtype=np.int64)
            union = len(s) + sizes[j0:] - common
            for j in np.flatnonzero(100 * common >= percent * union) + j0:
                x, y = root(i), root(int(j) if same else na + int(j))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((i, int(j)))
        mark[at] = False
    return out


def near_rows(docs: DataFrame, row: str, percent: int, count: int, rows: int, block: int) -> DataFrame:
    """rid, doc_id, n_shingles, component_id (null without words) and first: if the row is its component's that stays.

    docs is a stored table with a number for each row, so that rows with no doc_id, or with the same, take part in links
    like others. Equal sets are one class, known by the number of its first row.
    """
    sketches = written(sketched(docs, row, count, rows), "sketches")
    base = sketches.drop("bands")
    # The first row has the least doc_id, null last, of such rows the least text hash.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "rid", "bands")).alias("m")
    classes = sketches.filter("n_shingles > 0").groupBy("set_key").agg(least, F.max("n_shingles").alias("n"), F.count("*").alias("times"))
    classes = written(classes.select("set_key", F.col("m.rid").alias("rep"), F.struct("m.none", "m.doc_id", "m.th", "m.rid").alias("rank"), "m.bands", "n", "times"), "classes")
    marks = classes.select("rep", F.explode("bands").alias("band"))
    heads = written(marks.groupBy("band").agg(F.min("rep").alias("head"), F.count("*").alias("times")).filter("times > 1"), "heads")
    shared = heads.agg(F.sum("times")).first()[0] or 0
    # A class goes with the least head of its bands; the heads that it has seen together (one a band at most) are edges.
    stars = keyed_join(marks, heads, ["band"], "times", shared).groupBy("rep").agg(F.min("head").alias("head"), F.collect_set("head").alias("heads"))
    stars = written(stars, "stars")
    core = components(stars.select(F.col("head").alias("a"), F.explode("heads").alias("b")), "groups")
    followers = stars.groupBy("head").agg(F.count("*").alias("times"))
    labels = followers.join(core, F.col("head") == core["node"], "left").select("head", "times", F.coalesce("label", "head").alias("label"))
    groups = keyed_join(stars.select("rep", "head"), labels, ["head"], "times", stars.count())
    members = written(groups.select("rep", "label").join(classes.select("rep", "n"), "rep"), "members")
    # Blocks of a group: members by the hash of their number, as many blocks as its shingles need.
    need = members.groupBy("label").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"), F.count("*").alias("times"))
    placed = keyed_join(members, need, ["label"], "times", members.count())
    placed = placed.select(F.col("rep").alias("rep_"), "label", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("part"))
    placed = written(placed, "placed")  # its size is known then, and a small one moves no text
    texts = docs.select(F.col(row).alias("rep"), "text").join(placed, F.col("rep") == F.col("rep_")).drop("rep_")

    def sets_of(batches):
        for batch in batches:
            out = [s.tobytes() for _, _, buf, offs in byte_slices(batch, limit=1 << 20) for s in shingles(buf, offs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "label", "blocks", "part")), pa.array(out, pa.binary())], names=["rep", "label", "blocks", "part", "body"])

    sets = texts.mapInArrow(sets_of, "rep long, label long, blocks int, part int, body binary")
    # A block meets each block of its group once: task (i, j), i <= j.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = sets.withColumn("o", other).select("label", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "rep", "body")

    def compare(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        part, rep = t["part"].to_numpy(), t["rep"].to_pylist()
        body = [np.frombuffer(x.as_py(), U64) for x in t["body"]]
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        found = []
        if len(left) and len(right):
            found = linked([body[k] for k in left], [body[k] for k in right], percent, i == j)
        return pa.table([pa.array([rep[left[x]] for x, _ in found], pa.int64()), pa.array([rep[right[y]] for _, y in found], pa.int64())], names=["a", "b"])

    links = written(sent.groupBy("label", "i", "j").applyInArrow(compare, "a long, b long"), "links")
    final = components(links, "components")
    own = written(classes.join(final, classes["rep"] == final["node"], "left").select("set_key", "rank", F.coalesce("label", "rep").alias("label"), F.col("times").alias("rows")), "labels")
    tops = own.groupBy("label").agg(F.min("rank").alias("top"), F.count("*").alias("times"))
    own = keyed_join(own, tops, ["label"], "times", own.count()).select("set_key", "top", "rows")
    own = written(own, "own")
    discard(classes, heads, stars, core, members, placed, links, final)
    full = keyed_join(base.filter("n_shingles > 0"), own, ["set_key"], "rows", base.count())
    full = full.select("rid", "doc_id", "n_shingles", F.col("top.doc_id").alias("component_id"), (F.col("rid") == F.col("top.rid")).alias("first"))
    return full.unionByName(base.filter("n_shingles = 0").select("rid", "doc_id", "n_shingles"), allowMissingColumns=True)


def near_groups(documents: DataFrame, percent: int = 85, count: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are what `[^\\x20\\x09-\\x0D]+` matches, A-Z in lower case. component_id is the least doc_id reachable over
    links; a text without words links with nothing. Null text counts as empty; a row with a null doc_id takes part in
    links, and has its component's id or null. Of a component without any doc_id one row is kept. A doc_id may be of any
    type that has an order, and rows that share one are rows like others: all of them are kept if it is the component's
    least. Other columns are ignored; an empty table gives an empty result.
    """
    docs, row = numbered(documents.select("doc_id", "text"), "documents")
    out = near_rows(docs, row, percent, count, rows, block)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    nameless = F.col("doc_id").isNull() & F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(True)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, nameless).alias("kept"))


def kept_documents(documents: DataFrame, percent: int = 85, count: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """The rows of documents that stay, one of each group, with all their columns, whatever their names.

    Rows without words all stay. Rows are told apart by a number of their own, as doc_id may be null or repeat.
    """
    docs, row = numbered(documents, "rows")
    gone = written(near_rows(docs, row, percent, count, rows, block).filter("n_shingles > 0 and not first").select(F.col("rid").alias(spare(docs.columns, "gone_"))), "gone")
    return docs.join(gone, docs[row] == gone[gone.columns[0]], "left_anti").drop(row)


#: All pairs that share a shingle, counted, and everything that links reach; for small tables.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS rid, min(doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN k USING (rid) LEFT JOIN n USING (rid)
"""
