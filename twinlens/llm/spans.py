"""Long exact spans shared between texts (problem 8).

Every run of ``min_chars`` characters (a window) has one winnowed anchor: of the k-grams in it
the one with the least hash, the leftmost of equals. As that depends on the window alone, two
texts share a window only if they share its anchor, so joining on anchors loses nothing.
Consecutive windows with the same anchor form one seed span, which is what is shuffled: about one
row for every eighty characters.

Seeds of anchors that stand in one document only are dropped. A seed whose whole content stands in
two documents is shared as a whole. The others are where a repeat begins or ends: their text
is brought together by anchor, with one witness of each whole seed of the anchor, which stands for two documents, and extended from
it both ways, window by window, against all seeds of the anchor at once, never pair by pair. The maximal runs so found are merged to the
maximal shared spans of each document. Anchors with more than ``HOT_SEEDS`` seeds (a footer under
a third of all messages) are extended through a distributed aggregate of their windows instead.

Whole seeds are compared by two hashes of 64 bits, of the seed and of its anchor; windows that hash
alike are compared character by character, and those of the anchors with very many seeds by two hashes of 64 bits.

Defined cases: null, empty and short texts have no shared span; a text's repeats within itself
don't count, nor do other rows of the same id (identical rows count once, different texts of one
id add up); rows without an id are left out; extra columns don't matter; an empty table
gives no rows. Texts are taken whole, in segments with overlap if very long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinlens.llm.textcodes import U64, codes, prefix_hash, span_hash
from twinlens.operators.skew import salted_join
from twinlens.workspace import Workspace

MIN_CHARS = 200
GRAM = 32
HOT_SEEDS = 20_000
BLOCK_CHARS = 1 << 20
SEGMENT_CHARS = 1 << 22
_POS_BITS = 24

SEEDS = "doc bigint, body int, chars int, anchor bigint, span bigint, start int, n int"


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(v)
    pad = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    pad[:n] = v
    grid = pad.reshape(-1, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def seed_spans(c: np.ndarray, begin: np.ndarray, length: np.ndarray, min_chars: int, gram: int):
    """Seeds of the segments [begin, begin + length) of ``c``, each at least ``min_chars`` long:
    segment, first window, windows, hash of the anchor, hash of the span."""
    prefix = prefix_hash(c)
    at = np.arange(len(c) - gram + 1)
    h = span_hash(prefix, at, at + gram)
    coded = (h >> U64(_POS_BITS) << U64(_POS_BITS)) | at.astype(np.uint64)
    least = sliding_min(coded, min_chars - gram + 1)
    n = length - min_chars + 1
    seg = np.repeat(np.arange(len(begin)), n)
    win = np.arange(len(seg)) + np.repeat(begin - (np.cumsum(n) - n), n)
    anchor = (least[win] & U64((1 << _POS_BITS) - 1)).astype(np.int64)
    new = np.ones(len(seg), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(seg)))
    a = win[first]
    return seg[first], a, count, h[anchor[first]], span_hash(prefix, a, a + count + min_chars - 1), prefix


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _blocks(ids: list, texts: list[str], min_chars: int):
    """(ids, texts) of about BLOCK_CHARS, without the short ones."""
    a, b, size = [], [], 0
    for i, t in zip(ids, texts):
        if t is None or i is None or len(t) < min_chars:
            continue
        a.append(i)
        b.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield a, b
            a, b, size = [], [], 0
    if a:
        yield a, b


def _body_hash(prefix: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """32 bits, to tell different texts of one id apart."""
    return (span_hash(prefix, begin, begin + length) >> U64(32)).astype(np.uint32).view(np.int32)


def _find_seeds(min_chars: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SEEDS.split(", ")]
        for b in batches:
            for ids, texts in _blocks(b.column(0).to_pylist(), b.column(1).to_pylist(), min_chars):
                chars = np.array([len(t) for t in texts])
                body = np.empty(len(texts), dtype=np.int32)
                # segments: whole texts together, or parts of one very long text
                if chars.max() <= SEGMENT_CHARS:
                    parts = [("".join(texts), np.arange(len(texts)), np.cumsum(chars) - chars, chars, np.zeros(len(texts), dtype=np.int64))]
                else:
                    parts = []
                    for k, t in enumerate(texts):
                        for s in range(0, max(1, len(t) - min_chars + 1), SEGMENT_CHARS - min_chars + 1):
                            piece = t[s : s + SEGMENT_CHARS]
                            parts.append((piece, np.array([k]), np.array([0]), np.array([len(piece)]), np.array([s])))
                found = []
                for text, doc, begin, length, shift in parts:
                    c = codes(text)
                    seg, a, count, anchor, span, prefix = seed_spans(c, begin, length, min_chars, gram)
                    found.append((doc[seg], a - begin[seg] + shift[seg], count, anchor, span))
                    if len(parts) == 1:
                        body[:] = _body_hash(prefix, begin, length)
                if len(parts) > 1:
                    for k, t in enumerate(texts):
                        p = prefix_hash(codes(t))
                        body[k] = _body_hash(p, np.array([0]), np.array([len(t)]))[0]
                doc, start, count, anchor, span = (np.concatenate(x) for x in zip(*found))
                cols = [np.array(ids, dtype=np.int64)[doc], body[doc], chars[doc].astype(np.int32), _signed(anchor), _signed(span), start.astype(np.int32), count.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    return run


CUTS = "anchor bigint, doc bigint, other bigint, body int, chars int, start int, n int, piece string"


def _cut(min_chars: int):
    """Cut the text of the listed seeds out of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CUTS.split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                out = [[] for _ in names]
                c = codes("".join(texts))
                length = np.array([len(t) for t in texts])
                begin = np.cumsum(length) - length
                same = _body_hash(prefix_hash(c), begin, length).tolist()
                seeds = part.column(4)
                off = seeds.offsets.to_pylist()
                flat = seeds.values if off[0] == 0 and off[-1] == len(seeds.values) else seeds.values.slice(0)
                fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
                docs, bodies, chars = (part.column(k).to_pylist() for k in (0, 2, 3))
                for r, t in enumerate(texts):
                    if same[r] != bodies[r]:
                        continue  # another text of the same id
                    s = slice(off[r], off[r + 1])
                    starts, ns, anchors, others = (x[s].tolist() for x in fields)
                    m = len(starts)
                    out[0] += anchors
                    out[1] += [docs[r]] * m
                    out[2] += others
                    out[3] += [bodies[r]] * m
                    out[4] += [chars[r]] * m
                    out[5] += starts
                    out[6] += ns
                    out[7] += [t[a : a + k + min_chars - 1] for a, k in zip(starts, ns)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(out, kinds)], names=names)

    return run


def _windows(pieces: list[str], n: np.ndarray, min_chars: int):
    """Code points of the seeds, and of each of their windows: seed, place within it and place in the code points."""
    c = codes("".join(pieces))
    length = n + min_chars - 1
    begin = np.cumsum(length) - length
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return c, row, j, begin[row] + j


def _groups(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal codes follow each other, and where each group begins."""
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))


def _equal_windows(c: np.ndarray, row: np.ndarray, at: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """``_groups`` of windows with the same characters: by hash, each then compared with the first of its group.
    Where the window before it was compared with the window before that one, only the last character is new."""
    h = span_hash(prefix_hash(c), at, at + min_chars)
    order, edge = _groups(h)
    group = np.empty(len(h), dtype=np.int64)
    group[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(h))))
    first = order[edge][group]
    w = np.flatnonzero(first != np.arange(len(h)))  # to be compared, and with what
    f = first[w]
    goes_on = (row[w] == row[w - 1]) & (first[w - 1] == f - 1) & (row[f] == row[f - 1])
    equal = c[at[w] + (min_chars - 1)] == c[at[f] + (min_chars - 1)]
    new, span = np.flatnonzero(~goes_on), np.arange(min_chars)
    for k in range(0, len(new), 4096):
        some = new[k : k + 4096]
        equal[some] = (c[at[w[some]][:, None] + span] == c[at[f[some]][:, None] + span]).all(axis=1)
    if equal.all():
        return order, edge
    # different windows of one hash: number those of the groups in question by their characters
    number: dict[bytes, int] = {}
    for i in np.flatnonzero(np.isin(group, group[w[~equal]])):
        group[i] = len(edge) + number.setdefault(c[at[i] : at[i] + min_chars].tobytes(), len(number))
    return _groups(group)


FOUND = "doc bigint, body int, chars int, start int, length int"


def _extend(min_chars: int):
    """Extend the seeds of each anchor, in partitions sorted by anchor."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        doc, n = t.column("doc").to_numpy(), t.column("n").to_numpy().astype(np.int64)
        c, row, j, at = _windows(t.column("piece").to_pylist(), n, min_chars)
        order, edge = _equal_windows(c, row, at, min_chars)
        other = t.column("other").to_numpy()
        least, most = np.minimum(doc, other)[row[order]], np.maximum(doc, other)[row[order]]
        many = np.minimum.reduceat(least, edge) != np.maximum.reduceat(most, edge)
        hit = np.empty(len(row), dtype=bool)
        hit[order] = np.repeat(many, np.diff(np.append(edge, len(row))))
        hit &= (doc == other)[row]  # a witness is shared as a whole, which is known already
        prev = np.append(False, hit[:-1]) & (j > 0)
        first = np.flatnonzero(hit & ~prev)
        follows = np.append(hit[1:] & (j[1:] > 0), False)
        last = np.flatnonzero(hit & ~follows)
        r = row[first]
        cols = [doc[r], t.column("body").to_numpy()[r], t.column("chars").to_numpy()[r], (t.column("start").to_numpy()[r] + j[first]).astype(np.int32), (j[last] - j[first] + min_chars).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[x.split()[0] for x in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < 10_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            anchor = t.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                yield solve(t.slice(0, cut).combine_chunks())
                t = t.slice(cut).combine_chunks()
            held, rows = t.to_batches(), t.num_rows
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _hashed_windows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                p = b.slice(at, 4096)
                cols = {k: p.column(p.schema.get_field_index(k)) for k in ("doc", "other", "body", "chars", "start", "n")}
                n = cols["n"].to_numpy().astype(np.int64)
                c, row, j, first = _windows(p.column(p.schema.get_field_index("piece")).to_pylist(), n, min_chars)
                h, mark = (_signed(span_hash(prefix_hash(c, family), first, first + min_chars)) for family in (0, 1))
                out = [h, mark, *(cols[k].to_numpy()[row] for k in ("doc", "other", "body", "chars")), (cols["start"].to_numpy()[row] + j).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["window", "mark", "doc", "other", "body", "chars", "start"])

    return run


def shared_spans(df: DataFrame, min_chars: int = MIN_CHARS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot_seeds: int = HOT_SEEDS) -> DataFrame:
    """(doc, body, chars, start, length): stretches of shared spans, overlapping and adjacent ones
    not yet merged; ``body`` tells different texts of one id apart."""
    if not 1 <= gram < min_chars:
        raise ValueError("gram must be shorter than min_chars")
    ws = Workspace(df.sparkSession, "spans")
    texts = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).where(
        F.col("doc").isNotNull() & (F.length("text") >= min_chars)
    )
    seeds = ws.save(texts.mapInArrow(_find_seeds(min_chars, gram), SEEDS), "seeds")
    several = seeds.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("all_seeds")).where("lo <> hi")
    kept = ws.save(salted_join(seeds, several.select("anchor", "all_seeds"), "anchor", "all_seeds", F.col("doc")).drop("all_seeds"), "kept")
    ws.drop(seeds)
    by_span = kept.groupBy("anchor", "span").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("seeds"))
    by_anchor = by_span.groupBy("anchor").agg(
        F.count("*").alias("spans"),
        F.sum(F.expr("CASE WHEN lo = hi THEN seeds ELSE 1 END")).alias("open_seeds"),
        F.count_if(F.expr("lo = hi")).alias("open_spans"),
    )
    state = salted_join(by_span, by_anchor, "anchor", "spans", F.col("span")).select(
        "anchor",
        "span",
        "seeds",
        "lo",
        "hi",
        (F.col("lo") != F.col("hi")).alias("whole"),
        (F.col("open_spans") > 0).alias("open"),
        (F.col("open_seeds") > hot_seeds).alias("hot"),
    )
    marked = ws.save(
        salted_join(kept.drop("anchor"), state, "span", "seeds", F.col("doc"))
        .withColumn("cut", F.expr("open and (not whole or doc = lo)"))
        .withColumn("other", F.expr("case when whole then hi else doc end"))
        .drop("span", "seeds", "lo", "hi", "open"),
        "marked",
    )
    ws.drop(kept)
    whole = marked.where("whole").select("doc", "body", "chars", "start", (F.col("n") + (min_chars - 1)).alias("length"))

    def cut(part: DataFrame) -> DataFrame:
        listed = part.groupBy("doc", "body", "chars").agg(F.collect_list(F.struct("start", "n", "anchor", "other")).alias("seeds"))
        return listed.join(texts, "doc").select("doc", "text", "body", "chars", "seeds").mapInArrow(_cut(min_chars), CUTS)

    ends = marked.where("cut")
    out = whole.unionByName(
        cut(ends.where("not hot")).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_extend(min_chars), FOUND)
    )
    if not ends.where("hot").isEmpty():
        windows = ws.save(cut(ends.where("hot")).mapInArrow(_hashed_windows(min_chars), "window bigint, mark bigint, doc bigint, other bigint, body int, chars int, start int").withColumn("window", F.struct("window", "mark")), "hot")
        many = windows.groupBy("window").agg(F.min(F.least("doc", "other")).alias("lo"), F.max(F.greatest("doc", "other")).alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("window", "rows")
        hit = salted_join(windows.where("doc = other"), many, "window", "rows", F.col("doc"))
        out = out.unionByName(hit.select("doc", "body", "chars", "start", F.lit(min_chars).alias("length")))
    return out


def shared_share(df: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id_col, chars BIGINT, shared_chars BIGINT) of each document with a shared span: its length
    and how many of its characters lie in shared spans, overlapping ones counted once."""
    spans = shared_spans(df, min_chars, id_col=id_col, text_col=text_col, **how)
    before = Window.partitionBy("doc", "body").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("start") + F.col("length")
    merged = spans.withColumn("covered", F.max(stop).over(before)).withColumn(
        "new", F.greatest(F.lit(0), stop - F.greatest(F.col("start"), F.coalesce("covered", F.lit(0))))
    )
    per_text = merged.groupBy("doc", "body", "chars").agg(F.sum("new").alias("shared"))
    return per_text.groupBy(F.col("doc").alias(id_col)).agg(F.sum("chars").alias("chars"), F.sum("shared").alias("shared_chars"))
