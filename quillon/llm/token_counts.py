"""Token counts by a compiled finite-state transducer of a word-level byte-pair tokenizer.

The last token of a prefix of a word depends on the last tokens of the shorter prefixes that a token may still start
from; these are finitely many, so the tokenizer is a deterministic transducer over bytes. A transition carries the
change of the number of emitted tokens; the last byte of a word is a symbol of its own, after which the state is the
start again. States and transitions are compiled when first met and then kept in one table of integers.

The bytes of many texts are cut into chunks of one length, which run in step, one table look-up a byte for every chunk
at once. A chunk is a map of states: from its first word start on it is constant, so that part runs at once; the rest,
the end of a word that an earlier chunk began, runs when a scan over the chunks has composed the maps before it. The
counts of texts are differences of the prefix sums of the changes.

Every character of a text goes through the transducer. The library is asked about single characters when they are first
met (lower case, letter or digit or space), and about the normal form of words with combining characters.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import byte_slices, row_sums

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: Moves the character of a word's last byte out of the others' way.
LAST = 0x2000


def _byte_chars() -> list[str]:
    """The character that a byte-level vocabulary uses for each byte: itself if visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in visible:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


def _tables():
    """For code points under 0x180: class, and the lower-case code point."""
    kind, lower = np.zeros(0x180, np.uint8), np.arange(0x180)
    for c in range(0x180):
        low = chr(c).lower()
        lower[c] = ord(low) if len(low) == 1 and ord(low) < 0x180 else c
        cat = unicodedata.category(chr(lower[c]))
        kind[c] = LETTER if cat[0] == "L" else DIGIT if cat[0] == "N" else SPACE if chr(c) in " \t\n\x0b\x0c\r" else OTHER
    return kind, lower


KIND, LOWER = _tables()


def pieces(code: np.ndarray, kind: np.ndarray, head: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each unit starts a piece, ends one, and is in one (spaces are in none); pieces never cross rows.

    code: lower-case bytes or characters; head: whether the unit begins a character.
    """
    n = len(code)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = SPACE, kind[:-1]
    before[first[:n]] = SPACE
    start = head & (kind != SPACE) & ((kind == DIGIT) | (kind != before))
    quote = np.flatnonzero(start & (code == 39))
    if len(quote):
        row_end = offs[np.searchsorted(offs, quote, "right")]
        at = lambda k: np.where(quote + k < row_end, code[np.minimum(quote + k, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long_ = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 2, np.where(long_, 3, 0))
        hit, size = quote[size > 0], size[size > 0]
        start[hit + 1] = False
        after = hit + size
        after = after[after < n]
        start[after[(kind[after] == LETTER) & ~first[after]]] = True
    inside = kind != SPACE
    end = np.empty(n, bool)
    end[-1] = True
    end[:-1] = start[1:] | ~inside[1:]
    end |= first[1:]
    return start, end & inside, inside


def narrow(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of code points under 0x180 alone: lower-case bytes, start, end and inside."""
    b = buf.copy()
    lead = np.flatnonzero(b >= 0xC0)
    cp = np.minimum(b, 127).astype(np.int64)
    if len(lead):
        code = ((b[lead].astype(np.int64) & 0x1F) << 6) | (b[lead + 1] & 0x3F)
        cp[lead] = code
        low = LOWER[code]
        b[lead], b[lead + 1] = 0xC0 | (low >> 6), 0x80 | (low & 0x3F)
    kind = KIND[cp]
    kind[lead + 1] = kind[lead]
    ascii_ = buf < 128
    b[ascii_] = LOWER[buf[ascii_]]
    return b, *pieces(b, kind, (b & 0xC0) != 0x80, offs)


def decoded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the rows' offsets among them."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    padded = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int32)
    b0, b1, b2, b3 = (padded[lead + k] for k in range(4))
    low = lambda *x: sum((y & 0x3F) << (6 * (len(x) - 1 - k)) for k, y in enumerate(x))
    cp = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | low(b1), np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | low(b1, b2), (b0 & 0x07) << 18 | low(b1, b2, b3))))
    return cp, np.searchsorted(lead, offs)


def encoded(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of code points, and the place of each one's first byte (and the end)."""
    size = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for n, mark in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        k = np.flatnonzero(size == n)
        c, where = cp[k], at[:-1][k]
        out[where] = mark | (c >> (6 * (n - 1)))
        for j in range(1, n):
            out[where + j] = 0x80 | ((c >> (6 * (n - 1 - j))) & 0x3F)
    return out, at


@cache
def _joining() -> frozenset[int]:
    """Code points that may compose with the one before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset({int(p[1], 16) for p in pairs if len(p) == 2 and p[0][0] != "<"} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)})


class Alphabet:
    """What the tokenizer makes of a character, compiled when first met: its class, its lower case, and whether the word
    around it has to be normalised as a whole."""

    def __init__(self, library):
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.kind, self.low, self.odd = np.full(0x110000, 255, np.uint8), np.zeros(0x110000, np.int32), np.zeros(0x110000, bool)

    def kind_of(self, c: str) -> int:
        between = self.split(f"a{c}a")
        if len(between) == 1:
            return LETTER
        if len(between) == 2:
            return SPACE
        return DIGIT if len(self.split(c + c)) == 2 else OTHER

    def compile(self, cp: np.ndarray) -> None:
        for c in np.unique(cp[self.kind[cp] == 255]):
            char = chr(c)
            new = self.normal(char)
            self.odd[c] = len(new) != 1 or unicodedata.combining(char) > 0 or int(c) in _joining() or unicodedata.category(char) == "Cn"
            self.low[c] = ord(new) if len(new) == 1 else c
            self.kind[c] = self.kind_of(new if len(new) == 1 else char)

    def normalised(self, cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points in lower case; words with odd characters (between spaces of ASCII) in their normal form."""
        self.compile(cp)
        odd = np.flatnonzero(self.odd[cp])
        if len(odd):
            edge = np.union1d(np.flatnonzero((cp == 32) | ((cp >= 9) & (cp <= 13))), offs)
            k = np.unique(np.searchsorted(edge, odd, "right"))
            parts, at, shift = [], 0, np.zeros(len(cp) + 1, np.int64)
            for lo, hi in zip(np.maximum(edge[k - 1], 0), edge[k]):
                new = np.array([ord(c) for c in self.normal("".join(map(chr, cp[lo:hi])))], np.int32)
                parts += [cp[at:lo], new]
                shift[hi] += len(new) - (hi - lo)
                at = hi
            cp = np.concatenate([*parts, cp[at:]])
            offs = offs + np.cumsum(shift)[offs]
            self.compile(cp)
        low = self.low[cp]
        self.compile(low)
        return low, offs


def wide(buf: np.ndarray, offs: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For any text: lower-case bytes, start, end and inside, and the rows' offsets among these bytes."""
    cp, at = alphabet.normalised(*decoded(buf, offs))
    start, end, inside = pieces(cp, alphabet.kind[cp], np.ones(len(cp), bool), at)
    b, place = encoded(cp)
    first, last = np.zeros(len(b), bool), np.zeros(len(b), bool)
    first[place[:-1][start]] = True
    last[place[1:][end] - 1] = True
    return b, first, last, np.repeat(inside, np.diff(place)), place[at]


class Transducer:
    """Compiled lazily from the vocabulary file; `run` counts the tokens of pieces."""

    def __init__(self, path: str, lanes: int = 8192):
        model = json.load(open(path, encoding="utf-8"))["model"]
        suffix = model["end_of_word_suffix"]
        chars = _byte_chars()

        def own(token: str) -> str:
            return token[: -len(suffix) - 1] + chr(ord(token[-len(suffix) - 1]) + LAST) if token.endswith(suffix) and len(token) > len(suffix) else token

        self.rank = {(own(a), own(b)): k for k, (a, b) in enumerate(model["merges"])}
        self.vocab = {own(t) for t in model["vocab"]}
        self.prefixes = {t[:k] for t in self.vocab for k in range(len(t) + 1)}
        self.symbol = [*chars, *(chr(ord(c) + LAST) for c in chars)]
        self.lanes, self.compat_of = lanes, {}
        self.column = np.full(512, -1, np.int64)
        self.columns = 0
        self.states: dict[tuple, int] = {}
        self.data: list[tuple] = []
        self.table = np.full((1024, 64), -1, np.int32)
        self.state(("", (("", 0),)))

    def state(self, key: tuple) -> int:
        k = self.states.get(key)
        if k is None:
            k = self.states[key] = len(self.data)
            self.data.append(key)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.full((1 << 15, self.table.shape[1]), -1, np.int32)])
        return k

    def merged(self, word: str) -> list[str]:
        """Byte-pair merges of a word, by least rank, leftmost first."""
        parts = list(word)
        while len(parts) > 1:
            rank, k = min((self.rank.get((a, b), 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether the tokens stay as they are side by side."""
        ok = self.compat_of.get((a, b))
        if ok is None:
            ok = self.compat_of[a, b] = self.merged(a + b) == [a, b]
        return ok

    def compile(self, state: int, sym: int) -> int:
        """The table's entry: next state * 64 + 32 + change of the count."""
        s, hist = self.data[state]
        s = s + self.symbol[sym]
        drop = 0
        while s[drop:] not in self.prefixes:
            drop += 1
        for j in range(drop, len(s)):
            token = s[j:]
            if token in self.vocab and (not hist[j][0] or self.compatible(hist[j][0], token)):
                change = hist[j][1] + 1
                break
        else:
            raise ValueError(f"no token ends after {s!r}")
        if sym >= 256:
            return 32 + change
        past = tuple((hist[j][0], hist[j][1] - change) if s[j:] in self.prefixes else None for j in range(drop, len(s)))
        return self.state((s[drop:], (*past, (token, 0)))) * 64 + 32 + change

    def missing(self, state: np.ndarray, sym: np.ndarray) -> None:
        for key in np.unique(state.astype(np.int64) * 512 + sym):
            st, sy = divmod(int(key), 512)
            if self.column[sy] < 0:
                self.column[sy], self.columns = self.columns, self.columns + 1
                if self.columns > self.table.shape[1]:
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            entry = self.compile(st, sy)
            self.table[st, self.column[sy]] = entry

    def steps(self, syms: np.ndarray, begin: np.ndarray, stop: np.ndarray, state: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Runs syms[begin:stop] of every lane from its state, in step; writes the changes to out, returns the last states."""
        size = stop - begin
        order = np.argsort(-size, kind="stable")
        begin, size, now = begin[order], size[order], state[order].astype(np.int64)
        most = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, most + 1), "right")
        for t in range(most):
            k = alive[t]
            pos = begin[:k] + t
            sym = syms[pos]
            st = now[:k]
            while True:
                col = self.column[sym]
                entry = self.table.ravel()[st * self.table.shape[1] + col]
                bad = (entry < 0) | (col < 0)
                if not bad.any():
                    break
                self.missing(st[bad], sym[bad])
            out[pos] = (entry & 63) - 32
            now[:k] = entry >> 6
        left = np.empty(len(order), np.int64)
        left[order] = now
        return left

    def run(self, syms: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The change of the count at each symbol. syms begin with a piece; start marks the first symbol of each."""
        n = len(syms)
        out = np.zeros(n, np.int32)
        if not n:
            return out
        cut = np.arange(0, n, max(64, -(-n // self.lanes)))
        stop = np.append(cut[1:], n)
        at = np.append(np.flatnonzero(start), n)
        # From its first piece start a chunk's map is constant; a chunk inside one piece has none.
        first = np.minimum(at[np.searchsorted(at, cut)], stop)
        known = first < stop
        leave = np.zeros(len(cut), np.int64)
        leave[known] = self.steps(syms, first[known], stop[known], np.zeros(int(known.sum()), np.int64), out)
        # The scan: what is before that runs once the state that the chunks before it lead to is known.
        todo = np.flatnonzero(first > cut)
        while len(todo):
            ready = todo[known[todo - 1]]
            got = self.steps(syms, cut[ready], first[ready], leave[ready - 1], out)
            inner = ~known[ready]
            leave[ready[inner]] = got[inner]
            todo = todo[~known[todo - 1]]
            known[ready] = True
        return out


_loaded: dict[str, tuple] = {}
#: States beyond which a worker compiles afresh, so that its memory stays bounded; counts don't change.
MOST_STATES = 250_000


def _load(path: str):
    if path not in _loaded or len(_loaded[path][0].data) > MOST_STATES:
        from tokenizers import Tokenizer

        special = [t["content"].encode() for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        _loaded[path] = Transducer(path), Alphabet(Tokenizer.from_file(path)), special
    return _loaded[path]


def counts(buf: np.ndarray, offs: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each row."""
    machine, alphabet, special = _load(path)
    out = np.zeros(len(offs) - 1, np.int64)
    if not len(buf):
        return out
    # A special string is a token of its own, and separates what is around it.
    if len(np.flatnonzero((buf[:-1] == ord("<")) & (buf[1:] == ord("|")))):
        body = buf.tobytes()
        for text in special:
            for found in re.finditer(re.escape(text), body):
                row = int(np.searchsorted(offs, found.start(), "right")) - 1
                if found.end() <= offs[row + 1]:
                    out[row] += 1
                    buf = buf if buf.flags.writeable else buf.copy()
                    buf[found.start() : found.end()] = 32
    beyond = (buf >= 0xC6) | ((buf >= 0x1C) & (buf <= 0x1F))
    beyond[:-1] |= (buf[:-1] == 0xC2) & ((buf[1:] == 0x85) | (buf[1:] == 0xA0)) | (buf[:-1] == 0xC4) & (buf[1:] == 0xB0)
    many = row_sums(beyond, offs) > 0
    for rows in (~many, many):
        body, at = buf, offs
        if not rows.all():
            size = np.diff(offs)[rows]
            body, at = buf[np.repeat(rows, np.diff(offs))], np.concatenate([[0], np.cumsum(size)])
        if not len(body):
            continue
        if rows is many:
            b, start, end, inside, at = wide(body, at, alphabet)
        else:
            b, start, end, inside = narrow(body, at)
        change = np.zeros(len(b), np.int32)
        change[inside] = machine.run(b[inside].astype(np.int64) + 256 * end[inside], start[inside])
        out[rows] += row_sums(change, at)
    return out


def token_counts(documents: DataFrame, path: str, keep: list[str], limit: int = 2048) -> DataFrame:
    """`keep` columns of documents, n_bytes, n_tokens and over_limit, one row per row; texts of any length are counted whole.

    Null text counts as empty and has no token, so has an empty one. Repeated rows and null keys are rows like others,
    other columns are ignored, and an empty table gives an empty result.
    """
    schema = T.StructType([*(documents.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        for batch in batches:
            size, toks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, buf, offs in byte_slices(batch, limit=1 << 22):
                size.append(np.diff(offs))
                toks.append(counts(buf, offs, path))
            s, t = np.concatenate(size), np.concatenate(toks)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array(t), pa.array(t > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op4(documents: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts(documents, path, ["doc_id"])
