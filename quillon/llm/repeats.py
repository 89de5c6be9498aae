"""Repeated passages: every 50-byte string that also starts in a document with a smaller doc_id is removed.

Suffixes are compared to a depth of 50 bytes in blocks, in three steps.

1. Cover sample. Positions of a document that are in a difference cover modulo 21 are named by their next 30 bytes. Two
   equal 50-byte strings have, at some shift under 21, a sample position in both, and so an equal name. Names are
   counted over the corpus; where no sample name repeats, no string does.
2. Suffix buckets. The suffixes that the sample leaves open are dealt into buckets by the least hash among their 16-byte
   strings, so that equal suffixes share a bucket and neighbours travel as one piece of text. One bucket is sorted at a
   time: by the first bytes, and long ties by the ranks of the cover samples that two suffixes have at one shift; equal
   suffixes are one class, and its least doc_id is its owner.
3. The answers go back to the documents as bits, in the order in which the pieces were sent.

Documents are dealt into groups of bounded bytes; a group sends a name, or a piece, once however often it has it. Only
packed arrays are shuffled. The memory of a task is bounded by a group's or a bucket's size.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, mix, powers, ranked_rows, written

DEPTH = 50
#: A difference cover modulo 21: every difference occurs between two of its members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
SAMPLE = DEPTH - PERIOD + 1
#: Bytes whose least hash in a 50-byte string deals it to a bucket.
KEY = 16
#: Bytes of text of a group of documents.
GROUP = 8 << 20
#: Starts of a piece.
PIECE = 128


def window_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` bytes, by doubling; one for each start."""
    base = powers(size + 1)
    with np.errstate(over="ignore"):
        part = buf.astype(U64) + U64(1)
        out, done, width = None, 0, 1
        while True:
            if size & width:
                if out is None:
                    out = part
                else:
                    n = max(0, len(part) - done)
                    out = out[:n] + base[done] * part[done : done + n]
                done += width
            width *= 2
            if width > size:
                return mix(out)
            half = width // 2
            part = part[: len(part) - half] + base[half] * part[half:] if len(part) > half else part[:0]


def _sampled(offs: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """Sample positions of all rows whose SAMPLE bytes are inside the row; places count from the row's start."""
    out = []
    for c in np.flatnonzero(cover):
        lo, hi = offs[:-1] + c, offs[1:] - SAMPLE
        count = np.maximum(0, (hi - lo) // PERIOD + 1)
        row = np.repeat(np.arange(len(count)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        out.append(lo[row] + k * PERIOD)
    return np.concatenate(out)


_COVER = np.zeros(PERIOD, bool)
_COVER[list(COVER)] = True


def _slices(offs: np.ndarray, limit: int = 1 << 16):
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def sample_names(buf: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The names (high bits of the hash) of all sample positions, and the positions."""
    names, places = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for lo, hi in _slices(offs):
        at = offs[lo : hi + 1] - offs[lo]
        h = window_hashes(buf[offs[lo] : offs[hi]], SAMPLE)
        pos = _sampled(at, _COVER)
        names.append(h[pos] >> U64(64 - bits))
        places.append(pos + offs[lo])
    return np.concatenate(names), np.concatenate(places)


def _pack(sorted_values: np.ndarray) -> bytes:
    """Sorted integers as differences, byte by byte of all, compressed."""
    d = np.diff(sorted_values, prepend=U64(0))
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return _squeeze(bytes([width]) + d.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    data = _expand(data)
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return np.cumsum(out.view(U64).ravel(), dtype=U64)


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _texts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a group's texts and their offsets."""
    col = t["text"].combine_chunks().cast(pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def open_starts(buf: np.ndarray, offs: np.ndarray, repeated: np.ndarray, bits: int) -> np.ndarray:
    """Starts of 50-byte strings, inside a row, in which a sample name is among `repeated` (sorted)."""
    if not len(repeated) or not len(buf):
        return np.zeros(0, np.int64)
    names, pos = sample_names(buf, offs, bits)
    maybe = np.zeros(1 << 22, bool)  # most names are told apart by a small table
    maybe[(repeated & U64((1 << 22) - 1)).astype(np.int64)] = True
    some = maybe[(names & U64((1 << 22) - 1)).astype(np.int64)]
    names, pos = names[some], pos[some]
    k = np.minimum(np.searchsorted(repeated, names), len(repeated) - 1)
    pos = pos[repeated[k] == names]
    change = np.zeros(len(buf) + 2, np.int32)
    row = np.searchsorted(offs, pos, "right") - 1
    np.add.at(change, np.maximum(pos - (PERIOD - 1), offs[row]), 1)
    np.add.at(change, pos + 1, -1)
    live = np.cumsum(change[: len(buf)], dtype=np.int32) > 0
    last = np.maximum(offs[1:] - DEPTH + 1, offs[:-1])
    shut = np.zeros(len(buf) + 1, np.int32)
    np.add.at(shut, last, 1)
    np.add.at(shut, offs[1:], -1)
    return np.flatnonzero(live & (np.cumsum(shut[: len(buf)], dtype=np.int32) == 0))


def pieces(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring starts with one least KEY-byte hash: (first start, number of starts, that hash)."""
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64)
    least = np.empty(len(starts), U64)
    for lo, hi in _slices(offs):
        a, b = np.searchsorted(starts, (offs[lo], offs[hi]))
        if a == b:
            continue
        m = window_hashes(buf[offs[lo] : offs[hi]], KEY)
        width = 1
        while 2 * width <= DEPTH - KEY + 1:
            m = np.minimum(m[: len(m) - width], m[width:])
            width *= 2
        at = starts[a:b] - offs[lo]
        least[a:b] = np.minimum(m[at], m[at + DEPTH - KEY + 1 - width])
    row = np.searchsorted(offs, starts, "right")
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    # Long runs (periodic text) are cut at fixed lengths.
    parts = -(-size // PIECE)
    run = np.repeat(np.arange(len(first)), parts)
    k = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[run] + k * PIECE
    return starts[begin], np.minimum(PIECE, size[run] - k * PIECE), least[begin]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size of them) of each, one after the other."""
    begin = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - begin, size)


def distinct_pieces(buf: np.ndarray, first: np.ndarray, count: np.ndarray, least: np.ndarray, doc: np.ndarray):
    """Equal pieces (same bytes) as one: (index of the piece kept for each, indices kept); kept ones have the least doc."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = count + DEPTH - 1
    key, power = np.empty(len(first), U64), powers(int(size.max()) + 1)
    for lo in range(0, len(first), 1 << 14):  # bounded memory
        f, n, hi = first[lo : lo + (1 << 14)], size[lo : lo + (1 << 14)], lo + (1 << 14)
        flat = _ranges(f, n)
        with np.errstate(over="ignore"):
            key[lo:hi] = mix(np.add.reduceat((buf[flat].astype(U64) + U64(1)) * power[flat - np.repeat(f, n)], np.cumsum(n) - n) ^ least[lo:hi])
    order = np.lexsort((doc, key))
    head = np.ones(len(order), bool)
    head[1:] = key[order][1:] != key[order][:-1]
    rep = np.empty(len(order), np.int64)
    rep[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    # Exact: a piece whose bytes differ from its representative's stands for itself.
    other = np.flatnonzero((rep != np.arange(len(rep))) & (size == size[rep]))
    for lo in range(0, len(other), 1 << 14):
        k = other[lo : lo + (1 << 14)]
        unlike = np.add.reduceat(buf[_ranges(first[k], size[k])] != buf[_ranges(first[rep[k]], size[k])], np.cumsum(size[k]) - size[k]) > 0
        rep[k[unlike]] = k[unlike]
    odd = size != size[rep]
    rep[odd] = np.flatnonzero(odd)
    return rep, np.flatnonzero(rep == np.arange(len(rep)))


def _bytes_8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number in the order of bytes."""
    w = np.concatenate([text, np.zeros(7, np.uint8)]).astype(U64)
    for k in (1, 2, 4):
        w = (w[: len(w) - k] << U64(8 * k)) | w[k:]
    return w


#: For the phases of two suffixes (their places modulo PERIOD) the least shift at which both are in the cover.
SHIFT = np.array([[next(k for k in range(PERIOD) if (a + k) % PERIOD in COVER and (b + k) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def _sample_ranks(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """At the places of the cover that the suffixes at `at` reach, the rank of the sample's bytes in their order."""
    reach = np.zeros(len(first) + PERIOD + 1, np.int32)
    np.add.at(reach, at, 1)
    np.add.at(reach, at + PERIOD, -1)
    place = np.flatnonzero((np.cumsum(reach[: len(first)], dtype=np.int32) > 0) & _COVER[np.arange(len(first)) % PERIOD])
    words = [first[place + k] for k in (SAMPLE - 8, 16, 8, 0)]
    order = np.lexsort(words)
    new = np.zeros(len(order), bool)
    for w in words:
        new[1:] |= w[order][1:] != w[order][:-1]
    rank = np.zeros(len(first), np.int32)
    rank[place[order]] = np.cumsum(new, dtype=np.int32)
    return rank


def suffix_classes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The class of each suffix to the depth of 50 bytes, as the number of one of its suffixes: one bucket's sort.

    Sorted by the first 16 bytes. Long ties are parted by three-way quicksort, all of them in one step: a suffix meets
    its tie's pivot at the next four bytes, then at the rank of the cover sample that both have at the shift of their
    phases, and at the 20 bytes that a sample may not reach. The ranks are of bytes in order, so the order is that of the
    strings and nothing rests on a hash.
    """
    first = _bytes_8(text)
    order = np.lexsort((first[at + 8], first[at]))
    head, other = first[at[order]], first[at[order] + 8]
    tie = np.cumsum(np.append(True, (head[1:] != head[:-1]) | (other[1:] != other[:-1])))
    rep, live, rank = np.arange(len(at)), order, None
    while True:
        begin = np.flatnonzero(np.append(True, tie[1:] != tie[:-1]))
        size = np.diff(np.append(begin, len(tie)))
        many = np.repeat(size > 1, size)
        if not many.any():
            return rep
        pivot = np.repeat(live[begin + size // 2], size)[many]
        live, tie = live[many], tie[many]
        x, y = at[live], at[pivot]
        rank = _sample_ranks(first, x) if rank is None else rank
        k = SHIFT[x % PERIOD, y % PERIOD]
        side = np.zeros(len(live), np.int8)
        for values, i, j in ((first, x + 12, y + 12), (rank, x + k, y + k), (first, x + 30, y + 30), (first, x + 38, y + 38), (first, x + 42, y + 42)):
            u, v = values[i], values[j]
            side = np.where(side == 0, (u > v).astype(np.int8) - (u < v).astype(np.int8), side)
        same = side == 0
        rep[live[same]] = pivot[same]
        live, tie, side = live[~same], tie[~same], side[~same]
        if not len(live):
            return rep
        order = np.lexsort((side, tie))
        live, tie, side = live[order], tie[order], side[order]
        tie = np.cumsum(np.append(True, (tie[1:] != tie[:-1]) | (side[1:] != side[:-1])))


def owned_elsewhere(text: np.ndarray, begin: np.ndarray, count: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix of one bucket (piece by piece): does its 50-byte string also start in a smaller doc?

    Pieces with equal bytes, from copies of a text, are sorted once, for the least of their docs.
    """
    if not len(begin):
        return np.zeros(0, bool)
    rep, kept = distinct_pieces(text, begin, count, np.zeros(len(begin), U64), doc)
    owner, classes = np.repeat(doc[kept], count[kept]), suffix_classes(text, _ranges(begin[kept], count[kept]))
    least = np.full(len(owner), np.iinfo(np.int64).max)
    np.minimum.at(least, classes, owner)
    where = np.zeros(len(begin), np.int64)  # of the first suffix of a kept piece
    where[kept] = np.cumsum(count[kept]) - count[kept]
    return least[classes][_ranges(where[rep], count)] < np.repeat(doc, count)


def removed_runs(buf_len: int, offs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each byte is inside a 50-byte string that begins at one of starts."""
    change = np.zeros(buf_len + DEPTH + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + DEPTH, -1)
    return np.cumsum(change[:buf_len], dtype=np.int32) > 0


def repeated_passages(documents: DataFrame, group: int = GROUP, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, with texts=True).

    Texts are UTF-8 bytes, of any length, and read whole; null counts as empty. A null doc_id is larger than all others;
    ids that are not whole numbers are compared by their rank. Strings are judged on the input; rows with the same
    doc_id, repeated ones too, do not remove from each other. Other columns are ignored. An empty table gives an empty
    result.
    """
    if not isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        ids = documents.select("doc_id").filter("doc_id is not null").distinct()
        ranks = ranked_rows(ids, [F.col("doc_id").asc()], "key").select(F.col("doc_id").alias("id_"), "key")
        named = documents.select("doc_id", "text").join(ranks, F.col("doc_id") == F.col("id_"), "left").select("doc_id", "text", "key")
        stored = written(named, "ranked")
        out = repeated_passages(stored.select(F.col("key").alias("doc_id"), "text"), group, texts).withColumnRenamed("doc_id", "key_")
        return out.join(ranks, F.col("key_") == F.col("key"), "left").select(F.col("id_").alias("doc_id"), *(c for c in out.columns if c != "key_"))
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(4, -(-total // group))
    bits = min(64, max(32, int(total // 4 + 1).bit_length() + 11))
    buckets = groups
    name_bucket = U64(-(-(1 << bits) // buckets))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).max).cast("long"))
    docs = documents.select("doc_id", key.alias("key"), "text", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(groups)).cast("int").alias("grp"))
    # The number of partitions goes with the bytes, two for a group so that few share one: no task grows with the corpus.
    dealt = lambda d, by: d.repartition(2 * groups, by)
    docs = dealt(docs, "grp")

    def ordered(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """The rows in one order in every pass; rows that tie are alike."""
        t = t.sort_by([("key", "ascending"), ("text", "ascending")])
        return t, *_texts(t)

    def send_names(t: pa.Table) -> pa.Table:
        g = t["grp"][0].as_py()
        _, buf, offs = ordered(t)
        names = np.sort(sample_names(buf, offs, bits)[0])
        head = np.ones(len(names), bool)
        head[1:] = names[1:] != names[:-1]
        uniq = names[head]
        many = np.diff(np.append(np.flatnonzero(head), len(names))) > 1
        cut = np.searchsorted(uniq, np.arange(buckets + 1).astype(U64) * name_bucket) if len(uniq) else np.zeros(buckets + 1, int)
        cut[-1] = len(uniq)
        rows = [(b, g, _pack(uniq[lo:hi] - U64(b) * name_bucket), np.packbits(many[lo:hi]).tobytes()) for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if hi > lo]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "grp", "body", "many"])

    def find_names(t: pa.Table) -> pa.Table:
        b = t["bucket"][0].as_py()
        lists = [_unpack(x.as_py()) for x in t["body"]]
        flags = [np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(v)).astype(bool) for m, v in zip(t["many"], lists)]
        every = np.sort(np.concatenate(lists))
        again = np.union1d(every[1:][every[1:] == every[:-1]], np.concatenate([v[f] for v, f in zip(lists, flags)]))
        out = []
        for v in lists:
            k = np.minimum(np.searchsorted(again, v), max(0, len(again) - 1))
            hit = v[again[k] == v] if len(again) else v[:0]
            out.append(_pack(hit) if len(hit) else None)
        return pa.Table.from_arrays([t["grp"].combine_chunks(), pa.array([b] * len(lists), pa.int32()), pa.array(out, pa.binary())], names=["grp", "bucket", "body"])

    def to_pieces(t: pa.Table, found: pa.Table):
        t, buf, offs = ordered(t)
        parts = [_unpack(x.as_py()) + U64(b.as_py()) * name_bucket for x, b in zip(found["body"], found["bucket"])]
        repeated = np.sort(np.concatenate(parts)) if parts else np.zeros(0, U64)
        starts = open_starts(buf, offs, repeated, bits)
        first, count, least = pieces(buf, offs, starts)
        doc = t["key"].to_numpy()[np.searchsorted(offs, first, "right") - 1] if len(first) else np.zeros(0, np.int64)
        rep, kept = distinct_pieces(buf, first, count, least, doc)
        # Kept pieces by bucket; the order is the order of the answers.
        bucket = (mix(least[kept]) >> U64(32)) * U64(buckets) >> U64(32)
        order = kept[np.argsort(bucket, kind="stable")]
        return t, buf, offs, first, count, doc, rep, order, np.sort(bucket).astype(np.int64)

    def send_pieces(key_, t: pa.Table, found: pa.Table) -> pa.Table:
        names = ["bucket", "grp", "text", "sizes", "docs"]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        rows = []
        if t.num_rows:
            g = t["grp"][0].as_py()
            _, buf, _, first, count, doc, rep, order, bucket = to_pieces(t, found)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])):
                if hi > lo:
                    k = order[lo:hi]
                    rows.append((b, g, _squeeze(buf[_ranges(first[k], count[k] + DEPTH - 1)].tobytes()), count[k].astype(np.uint8).tobytes(), _squeeze(doc[k].tobytes())))
            # What the group itself needs later passes through with the pieces, under a key of its own.
            state = np.diff(first, prepend=0).astype(np.int32), count.astype(np.uint8), rep.astype(np.int32), order.astype(np.int32), cut
            rows.append((-1 - g, g, _squeeze(pickle.dumps(state)), b"", b""))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def sort_bucket(t: pa.Table) -> pa.Table:
        b = t["bucket"][0].as_py()
        if b < 0:
            return pa.Table.from_arrays([t["grp"].combine_chunks(), t["bucket"].combine_chunks(), t["text"].combine_chunks()], names=["grp", "bucket", "bits"])
        text = np.concatenate([np.frombuffer(_expand(x.as_py()), np.uint8) for x in t["text"]])
        sizes = [np.frombuffer(x.as_py(), np.uint8).astype(np.int64) for x in t["sizes"]]
        count, doc = np.concatenate(sizes), np.concatenate([np.frombuffer(_expand(x.as_py()), np.int64) for x in t["docs"]])
        whole = count + DEPTH - 1
        bits_ = owned_elsewhere(text, np.cumsum(whole) - whole, count, doc)
        ends = np.cumsum([int(s.sum()) for s in sizes])
        out = [np.packbits(x).tobytes() for x in np.split(bits_, ends[:-1])]
        return pa.Table.from_arrays([t["grp"].combine_chunks(), pa.array([b] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["grp", "bucket", "bits"])

    ids = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ids}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def finish(key_, t: pa.Table, answers: pa.Table) -> pa.Table:
        cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts]
        kinds = [t.schema.field("doc_id").type if t.num_rows else pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * texts]
        if not t.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=cols)
        t, buf, offs = ordered(t)
        at = {b.as_py(): x.as_py() for b, x in zip(answers["bucket"], answers["bits"])}
        first, count, rep, order, cut = pickle.loads(_expand(at[-1 - t["grp"][0].as_py()]))
        first, count = np.cumsum(first, dtype=np.int64), count.astype(np.int64)
        gone = np.zeros(0, np.int64)
        if len(first):
            doc = t["key"].to_numpy()[np.searchsorted(offs, first, "right") - 1]
            flags = [np.unpackbits(np.frombuffer(at[b], np.uint8), count=int(count[order[lo:hi]].sum())).astype(bool) for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if hi > lo]
            flags = np.concatenate(flags)
            where = np.zeros(len(first), np.int64)  # of the piece's first answer
            where[order] = np.cumsum(count[order]) - count[order]
            answer = flags[_ranges(where[rep], count)] | np.repeat(doc[rep] < doc, count)
            gone = _ranges(first, count)[answer]
        removed = removed_runs(len(buf), offs, gone)
        edge = removed.copy()
        edge[1:] &= ~removed[:-1]
        begin = offs[:-1][np.diff(offs) > 0]
        edge[begin] = removed[begin]
        total_ = np.concatenate([[0], np.cumsum(removed)])
        spans = np.concatenate([[0], np.cumsum(edge)])
        n_removed, n_spans = total_[offs[1:]] - total_[offs[:-1]], spans[offs[1:]] - spans[offs[:-1]]
        left = [buf[lo:hi][~removed[lo:hi]].tobytes() if r else buf[lo:hi].tobytes() for lo, hi, r in zip(offs[:-1], offs[1:], n_removed)]
        out = [t["doc_id"].combine_chunks(), pa.array(np.diff(offs)), pa.array(n_removed), pa.array(n_spans), pa.array([hashlib.sha256(x).hexdigest() for x in left])]
        return pa.Table.from_arrays([*out, *[pa.array(left, pa.binary())] * texts], names=cols)

    names = docs.groupBy("grp").applyInArrow(send_names, "bucket int, grp int, body binary, many binary")
    found = dealt(names, "bucket").groupBy("bucket").applyInArrow(find_names, "grp int, bucket int, body binary").filter("body is not null")
    sent = docs.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(send_pieces, "bucket int, grp int, text binary, sizes binary, docs binary")
    bits_ = dealt(sent, "bucket").groupBy("bucket").applyInArrow(sort_bucket, "grp int, bucket int, bits binary")
    return docs.groupBy("grp").cogroup(bits_.groupBy("grp")).applyInArrow(finish, schema)


#: Every 50-byte string with its least doc_id, and the runs of removed bytes; for small tables without null doc_ids.
SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT rid, doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM (SELECT rid, doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS p FROM d)),
o AS (SELECT w, min(doc_id) AS o FROM s GROUP BY w),
g AS (SELECT rid, p, p > coalesce(lag(p) OVER (PARTITION BY rid ORDER BY p) + 50, -1) AS new FROM s JOIN o USING (w) WHERE o < doc_id),
r AS (SELECT rid, run, min(p) AS lo, max(p) + 50 AS hi FROM (SELECT rid, p, sum(new::INT) OVER (PARTITION BY rid ORDER BY p) AS run FROM g) GROUP BY 1, 2),
q AS (SELECT *, lead(lo) OVER (PARTITION BY rid ORDER BY lo) AS next FROM r),
k AS (SELECT rid, sum(hi - lo) AS n_removed, count(*) AS n_spans, min(lo) AS first, string_agg(substr(h, 2 * hi + 1, 2 * (coalesce(next, n) - hi)), '' ORDER BY lo) AS rest FROM q JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN rest IS NULL THEN h ELSE substr(h, 1, 2 * first) || rest END)) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
