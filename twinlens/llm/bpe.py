"""Encoding a corpus with a public byte-level BPE vocabulary (problem 6).

Texts are cut into pre-tokens with array operations on code points, and only the distinct
pre-tokens of a batch are encoded. The encoder groups pre-tokens by length into padded
integer matrices; in each round every row merges its leftmost pair of least rank, found in a
hashed pair table, and rows without a mergeable pair leave the matrix. Where that pair stands in a row many times, as in
very long words, all its places are merged in one round if none of the merges makes a pair of equal or lesser rank, as the order then
doesn't matter; so rounds are bounded by the different merges of a word and not by its length.

Pre-tokens are looked up by a hash and then compared, sign by sign, with what was remembered under it.

Defined cases: a null and an empty text give an empty list; strings that look like special
tokens are ordinary text; extra columns of the input don't matter; repeated rows give
repeated rows; an empty table gives an empty table; text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.textcodes import codes, prefix_hash, span_hash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Distinct pre-tokens a worker remembers; beyond that it forgets all and starts again.
CACHE_WORDS = 400_000
#: Code points handled at once.
BLOCK_CHARS = 1 << 20
#: Places of a row's least pair from which on they are merged together.
MANY_PLACES = 8

NONE = np.int32(np.iinfo(np.int32).max)
_MULT = np.uint64(0x9E3779B97F4A7C15)

# Character classes.
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# The code points with the Unicode property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for i in range(0x110000):
        k = unicodedata.category(chr(i))[0]
        if k == "L":
            out[i] = LETTER
        elif k == "N":
            out[i] = NUMBER
    out[WHITE] = SPACE
    return out


def pretoken_starts(c: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the concatenated texts begin.

    Equals matching, from the left, contractions, then runs of letters, of numbers or of other
    signs, each with one space before it, then white space without the last sign before a
    non-space, then white space.
    """
    n = len(c)
    if not n:
        return np.zeros(0, dtype=np.int64)
    k = char_classes()[c]
    first = np.zeros(n + 1, dtype=bool)
    first[doc_starts[doc_starts < n]] = True
    first[n] = True
    run = first[:n].copy()  # a run of one class begins
    run[1:] |= k[1:] != k[:-1]
    start = run.copy()
    space = k == SPACE
    # the last white space before a non-space of the same text begins a pre-token
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start |= last
    # a plain space takes the run behind it
    attached = np.zeros(n, dtype=bool)
    attached[1:] = last[:-1] & (c[:-1] == 32)
    start &= ~attached
    # contractions: an apostrophe that begins a pre-token
    apos = np.flatnonzero((c == 39) & run & ~attached)
    if len(apos):
        pad = np.zeros(n + 3, dtype=np.int64)
        pad[:n] = c
        ends = first.nonzero()[0]
        stop = ends[np.searchsorted(ends, apos, side="right")]
        x, y = pad[apos + 1], pad[apos + 2]
        one = np.isin(x, [ord("s"), ord("d"), ord("m"), ord("t")]) & (apos + 2 <= stop)
        two = ((x == ord("l")) & (y == ord("l")) | (x == ord("v")) & (y == ord("e")) | (x == ord("r")) & (y == ord("e"))) & (apos + 3 <= stop)
        for hit, length in ((one, 2), (two, 3)):
            p = apos[hit]
            start[p + 1] = False
            q = p + length
            q = q[q < n]
            start[q] = True
    return np.flatnonzero(start)


class Ranks:
    """The vocabulary as arrays: ids of single bytes and a hashed table of mergeable pairs."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        left, right, new = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    new.append(rank)
        keys = (np.array(left, dtype=np.uint64) << np.uint64(32)) | np.array(right, dtype=np.uint64)
        vals = np.array(new, dtype=np.int32)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, ~np.uint64(0))
        self.vals = np.full(size, NONE)
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):
            slot = (self._home(keys[todo]) + self.probes) & (size - 1)
            free = self.keys[slot] == ~np.uint64(0)
            s, who = slot[free], todo[free]
            self.keys[s] = keys[who]  # of several, the last stays
            won = self.keys[s] == keys[who]
            self.vals[s[won]] = vals[who[won]]
            placed = np.zeros(len(keys), dtype=bool)
            placed[who[won]] = True
            todo = todo[~placed[todo]]
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it isn't mergeable (padding is negative)."""
        shape = a.shape
        a, b = a.ravel(), b.ravel()
        out = np.full(len(a), NONE)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        key = (a[at].astype(np.uint64) << np.uint64(32)) | b[at].astype(np.uint64)
        home, mask = self._home(key), (1 << self.bits) - 1
        for i in range(self.probes):
            slot = (home + i) & mask
            found = self.keys[slot]
            hit = found == key
            out[at[hit]] = self.vals[slot[hit]]
            go = ~hit & (found != ~np.uint64(0))
            if not go.any():
                break
            at, key, home = at[go], key[go], home[go]
        return out.reshape(shape)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        counts = np.zeros(len(words), dtype=np.int64)
        flat = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        begin = np.cumsum(n) - n
        done_rows: list[np.ndarray] = []
        done_mats: list[np.ndarray] = []
        bucket = np.where(n <= 8, n, np.where(n <= 32, (n + 3) // 4 * 4, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)))
        for width in np.unique(bucket[bucket > 0]):
            rows = np.flatnonzero(bucket == width)
            for part in np.array_split(rows, max(1, len(rows) * int(width) // 2_000_000 + 1)):
                self._rounds(part, int(width), flat, begin, n, done_rows, done_mats)
        for rows, mat in zip(done_rows, done_mats):
            counts[rows] = (mat >= 0).sum(axis=1)
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int32)
        for rows, mat in zip(done_rows, done_mats):
            good = mat >= 0
            out[(at[rows][:, None] + np.arange(mat.shape[1]))[good]] = mat[good]
        return out, counts

    def _rounds(self, rows, width, flat, begin, n, done_rows, done_mats) -> None:
        cols = np.arange(width)
        inside = cols < n[rows][:, None]
        mat = np.full((len(rows), width), np.int32(-1))
        mat[inside] = flat[(begin[rows][:, None] + cols)[inside]]
        rank = np.full((len(rows), width), NONE)
        rank[:, :-1] = self.pair(mat[:, :-1], mat[:, 1:])
        while len(rows):
            best = rank.argmin(axis=1)
            at = np.arange(len(rows))
            low = rank[at, best]
            over = low == NONE
            if over.any():
                done_rows.append(rows[over])
                done_mats.append(mat[over])
                go = ~over
                rows, mat, rank, best, low = rows[go], mat[go], rank[go], best[go], low[go]
                if not len(rows):
                    return
                at = np.arange(len(rows))
            if mat.shape[1] > 2 * MANY_PLACES:
                merged = False
                for i in np.flatnonzero((rank == low[:, None]).sum(axis=1) >= MANY_PLACES):
                    if (both := self._merge_all(mat[i], rank[i], low[i])) is not None:
                        mat[i], rank[i] = both
                        merged = True
                if merged:  # the other rows merge in a later round
                    used = max(1, int((mat >= 0).sum(axis=1).max()))
                    mat, rank = np.ascontiguousarray(mat[:, :used]), np.ascontiguousarray(rank[:, :used])
                    continue
            mat[at, best] = low
            width = mat.shape[1]
            src = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
            mat = np.take_along_axis(mat, src, axis=1)
            rank = np.take_along_axis(rank, src, axis=1)
            width -= 1
            right = np.minimum(best + 1, width - 1)
            rank[at, best] = np.where(best + 1 < width, self.pair(mat[at, best], mat[at, right]), NONE)
            b = np.flatnonzero(best > 0)
            rank[b, best[b] - 1] = self.pair(mat[b, best[b] - 1], mat[b, best[b]])

    def _merge_all(self, ids: np.ndarray, rank: np.ndarray, low: np.int32) -> tuple[np.ndarray, np.ndarray] | None:
        """One row with all places of its least pair merged from the left; None if a merge would make a pair of
        equal or lesser rank, which would come before the places behind it."""
        p = np.flatnonzero(rank == low)
        # of places in a row every other one: they overlap
        start = np.flatnonzero(np.append(True, np.diff(p) > 1))
        p = p[(np.arange(len(p)) - np.repeat(start, np.diff(np.append(start, len(p))))) % 2 == 0]
        before = np.append(ids, np.int32(-1))
        after = ids.copy()
        after[p] = low
        after = np.append(np.delete(after, p + 1), np.int32(-1))
        q = p - np.arange(len(p))
        left = np.where(q > 0, self.pair(after[q - 1], after[q]), NONE)
        right, next_before = self.pair(after[q], after[q + 1]), self.pair(after[q], before[np.minimum(p + 2, len(ids))])
        if min(left.min(), right.min(), next_before.min()) <= low:
            return None
        new = np.delete(rank, p + 1)
        new[q] = right
        new[q[q > 0] - 1] = left[q > 0]
        width = len(ids)
        out, ranks = np.full(width, np.int32(-1)), np.full(width, NONE)
        out[: len(after) - 1], ranks[: len(new)] = after[:-1], new
        return out, ranks


class Encoder:
    """Encodes texts; remembers the distinct pre-tokens it has met, up to a bound."""

    def __init__(self, raw: bytes):
        self.ranks = Ranks(raw)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.start = np.zeros(1024, dtype=np.int64)
        self.count = np.zeros(1024, dtype=np.int64)
        self.pool = np.zeros(4096, dtype=np.int32)
        self.used = 0
        # the signs of each word remembered
        self.signs = np.zeros(4096, dtype=np.uint32)
        self.sign_start = np.zeros(1024, dtype=np.int64)
        self.length = np.zeros(1024, dtype=np.int64)
        self.signs_used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, 2 * len(a)), dtype=a.dtype)
        out[: len(a)] = a
        return out

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        at, n = len(self.known), len(words)
        signs, length = codes("".join(words)), np.fromiter(map(len, words), dtype=np.int64, count=n)
        self.sign_start, self.length = self._room(self.sign_start, at + n), self._room(self.length, at + n)
        self.signs = self._room(self.signs, self.signs_used + len(signs))
        self.signs[self.signs_used : self.signs_used + len(signs)] = signs
        self.sign_start[at : at + n] = self.signs_used + np.cumsum(length) - length
        self.length[at : at + n] = length
        self.signs_used += len(signs)
        words = [w.encode("utf-8", "surrogatepass") for w in words]
        ids, counts = self.ranks.encode_words(words)
        self.start, self.count = self._room(self.start, at + n), self._room(self.count, at + n)
        self.pool = self._room(self.pool, self.used + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        self.count[at : at + n] = counts
        self.start[at : at + n] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.known.update(zip(hashes, range(at, at + n)))

    def _same(self, c: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> bool:
        """Whether every pre-token is the word remembered for it."""
        n = ends - starts
        if not np.array_equal(n, self.length[word]):
            return False
        # pre-tokens are one behind the other, so that their signs are the block itself
        return np.array_equal(self.signs[np.repeat(self.sign_start[word] - starts, n) + np.arange(starts[0], ends[-1])], c[starts[0] : ends[-1]])

    def _words(self, h: np.ndarray, whole: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the word remembered for each pre-token's hash; new ones are learnt."""
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(uniq) > CACHE_WORDS:
            self._forget()
        keys = uniq.tolist()
        new = [i for i, x in enumerate(keys) if x not in self.known]
        if new:
            at = first[new]
            self._learn([keys[i] for i in new], [whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        return np.fromiter(map(self.known.__getitem__, keys), dtype=np.int64, count=len(keys))[inverse]

    def _block(self, texts: list[str], want_ids: bool) -> tuple[np.ndarray | None, np.ndarray]:
        lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        whole = "".join(texts)
        c = codes(whole)
        doc = np.cumsum(lens) - lens
        starts = pretoken_starts(c, doc[lens > 0])
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        ends = np.append(starts[1:], len(c))
        h = span_hash(prefix_hash(c), starts, ends)
        word = self._words(h, whole, starts, ends)
        clash = not self._same(c, starts, ends, word)
        if clash:  # two words under one hash: number the words of this block and forget them afterwards
            self._forget()
            number: dict[str, int] = {}
            h = np.array([number.setdefault(whole[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.uint64)
            word = self._words(h, whole, starts, ends)
        n = self.count[word]
        total = np.concatenate(([0], np.cumsum(n)))
        edge = np.searchsorted(starts, np.append(doc, len(c)))
        per_doc = total[edge[1:]] - total[edge[:-1]]
        ids = self.pool[np.repeat(self.start[word] - total[:-1], n) + np.arange(total[-1])] if want_ids else None
        if clash:
            self._forget()
        return ids, per_doc

    def encode(self, texts: list[str | None], want_ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of all texts, one after the other (None unless wanted), and how many each has."""
        ids, counts, block, size = [], [], [], 0
        for i, t in enumerate(texts):
            block.append(t or "")
            size += len(block[-1])
            if size >= BLOCK_CHARS or i + 1 == len(texts):
                a, b = self._block(block, want_ids)
                ids.append(a)
                counts.append(b)
                block, size = [], 0
        if not counts:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        return (np.concatenate(ids) if want_ids else None), np.concatenate(counts)


_ENCODERS: dict[int, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The worker's encoder for this vocabulary, made once."""
    key = zlib.crc32(raw) ^ len(raw)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(raw)
    return _ENCODERS[key]


def _columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def encode_column(df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids ARRAY<INT>): the ids of each text by the vocabulary, whole, in one narrow stage."""
    raw = df.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids, n = enc.encode(part.column(1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return _columns(df, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens BIGINT): the length of each text in tokens; 0 for null and empty texts."""
    raw = df.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for b in batches:
            _, n = enc.encode(b.column(1).to_pylist(), want_ids=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int64())], names=[id_col, "n_tokens"])

    return _columns(df, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")
