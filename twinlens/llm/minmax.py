"""Near-duplicate fingerprints by min-max hashing (problem 1).

A record's four 64-bit fingerprints form one weighted set of 256 elements, (fingerprint, bit, value),
with weights in the proportion of the fused similarity. A permutation is one random order of the
elements, each standing in it as often as it weighs; the first and the last element present are
both kept, two values of the signature from one order. Either agrees for two records with the
probability of their weighted Jaccard similarity J; a fused similarity s gives J = s / (2 - s), so 0.90
gives 0.818. Unrelated records (J about 1/3) should meet a few at a time whatever the size of the
collection, so a band has more values the more records there are (10 up to 236,000, two more for each
ninefold), and there are as many bands as keep the chance to miss a pair at the threshold below MISS
(64 with 10 values). Work grows with the power 1.2 of the records, not with their square.

Records of equal fingerprints are one class, and only classes are hashed and compared. A class enters a
band with its number and its first fingerprint, which alone turns away nearly all unrelated ones: it may
differ by 14 bits at most. Partitions sorted by band pair their classes in blocks of arrays. A band of
more than BAND_ROWS classes isn't paired there but in square cells of two blocks of its classes each,
spread over tasks, and so are the members of classes with very many records. The exact distance decides.

Defined cases: a record with a fingerprint that is null, empty or no number of at most 64 bits
has no pairs; repeated rows of one id count once; ties don't matter, as all pairs above the
threshold are found; extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.llm.textcodes import U64, mix64
from twinlens.operators.skew import salted_join
from twinlens.workspace import Workspace

PRINTS = ["phash", "dhash", "whash", "ahash"]
#: Weights in hundredths, in the order of PRINTS.
WEIGHTS = [45, 25, 20, 10]
#: Weighted differing bits that a similarity of 0.90 allows: 0.10 * 64 * 100.
MAX_DISTANCE = 640
#: Chance to miss a pair exactly at the threshold.
MISS = 1e-4
#: Unrelated records that a record may meet in a band.
STRANGERS = 4
#: Classes of a band, and members of a class, that are paired at one place.
BAND_ROWS = 2000
MEMBER_ROWS = 1000
#: Bits of a band's key.
KEY_BITS = 40
SEED = 20_240_611


def readable(c: Column) -> Column:
    """The number a fingerprint's text stands for as BIGINT (its 64 bits), or null: white space,
    separators, quotes, letter case, leading zeros and a leading 0x are set aside."""
    text = F.regexp_replace(F.lower(c), r"""[\s\p{Z}\p{Cc}\p{Cf}:_\-'"]+""", "")
    digits = F.regexp_extract(text, r"^(?:0x)?0*([0-9a-f]{1,16})$", 1)
    # most are plain already
    return F.when(c.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(c, 16, -10).cast("bigint")).otherwise(F.when(digits != "", F.conv(digits, 16, -10).cast("bigint")))


def distance(a: str, b: str) -> Column:
    """Weighted differing bits between two sets of fingerprint columns with these prefixes."""
    d = F.lit(0)
    for name, w in zip(PRINTS, WEIGHTS):
        d = d + F.bit_count(F.col(a + name).bitwiseXOR(F.col(b + name))) * w
    return d


def signature_shape(records: int, max_distance: int = MAX_DISTANCE) -> tuple[int, int]:
    """(bands, values a band) for a number of records."""
    far = max_distance / (64 * sum(WEIGHTS))
    near = (1 - far) / (1 + far)
    values = max(10, 2 * ceil(log(max(records, 1) / STRANGERS, 3) / 2))
    return (ceil(log(MISS) / log1p(-(near**values))) if far else 1), values


@lru_cache(maxsize=2)
def _orders(permutations: int) -> list[np.ndarray]:
    """Orders of the elements, written bit * 2 + value, each as often as it weighs."""
    copies = np.repeat(np.arange(512), np.repeat(np.array(WEIGHTS) // np.gcd.reduce(WEIGHTS), 128))
    rng = np.random.default_rng(SEED)
    return [rng.permutation(copies) for _ in range(permutations)]


def _first_present(order: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Place in ``order`` of the first element each record has; ``bits`` is 256 x records, all or no bits set."""
    out = np.full(bits.shape[1], 0xFFFF, dtype=np.uint16)
    for t, e in enumerate(order):
        absent = bits[e >> 1] ^ np.uint16(0xFFFF * (e & 1))  # 0 where the record has the element
        np.minimum(out, np.maximum(absent, np.uint16(t)), out=out)
        if t >= 11 and out.max() < 0xFFFF:
            break
    return out


def _spread_bits(prints: np.ndarray) -> np.ndarray:
    """256 x records, 0xFFFF for a set bit, of uint64 fingerprints (records x 4)."""
    shifts = np.arange(64, dtype=np.uint64)
    bits = ((prints.T[:, None, :] >> shifts[None, :, None]) & U64(1)).astype(np.uint16).reshape(256, -1)
    return bits * np.uint16(0xFFFF)


def band_keys(prints: np.ndarray, bands: int, values: int) -> np.ndarray:
    """records x bands keys of the min-max signature of uint64 fingerprints (records x 4)."""
    bits = _spread_bits(prints)
    keys = np.empty((len(prints), bands), dtype=np.uint64)
    orders = iter(_orders(bands * values // 2))
    for b in range(bands):
        k = np.full(len(prints), U64(b + 1))
        for _ in range(values // 2):
            order = next(orders)
            for end in (order, order[::-1]):
                k = k * U64(0x100000001B3) + _first_present(end, bits).astype(np.uint64)
        keys[:, b] = mix64(k) >> U64(64 - KEY_BITS)
    return keys


BANDED = "band bigint, id bigint, phash bigint"


def _emit(bands: int, values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                prints = np.stack([part.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(1, 5)], axis=1)
                keys = band_keys(prints, bands, values).view(np.int64)
                cols = [keys.ravel(), np.repeat(part.column(0).to_numpy(), bands), np.repeat(prints[:, 0].view(np.int64), bands)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["band", "id", "phash"])

    return run


#: A pair of classes (``band`` null), or a class of a band too large to be paired at once (``other`` null).
MET = "band bigint, id bigint, other bigint, phash bigint"


def _pair_bands(most_bits: int, band_rows: int):
    """Pair the classes of each band, in partitions sorted by band; classes of large bands are passed on."""

    def pairs(band: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
        found, at = [], np.arange(len(band) - 1)
        for lag in range(1, len(band)):
            at = at[: np.searchsorted(at, len(band) - lag)]
            at = at[band[at] == band[at + lag]]  # a group shorter than the lag is done
            if not len(at):
                break
            hit = at[np.bitwise_count(marks[at] ^ marks[at + lag]) <= most_bits]
            found.append(np.stack((ids[hit], ids[hit + lag])))
        both = np.sort(np.concatenate(found, axis=1), axis=0) if found else np.zeros((2, 0), dtype=np.int64)
        return np.unique(both, axis=1)

    def out(kind: str, *cols: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(cols[0]), pa.int64())
        a = [pa.array(c) for c in cols]
        filled = [none, a[0], a[1], none] if kind == "pair" else [a[0], a[1], none, a[2]]
        return pa.RecordBatch.from_arrays(filled, names=["band", "id", "other", "phash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 3
        hot = None  # the large band that is being passed on

        def solve(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            band, ids, marks = cols
            if not len(band):
                return
            edge = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
            size = np.diff(np.append(edge, len(band)))
            large = np.repeat((size > band_rows) | (band[edge] == hot if hot is not None else False), size)
            if large.any():
                yield out("hot", band[large], ids[large], marks[large])
            a, b = pairs(band[~large], ids[~large], marks[~large].view(np.uint64))
            if len(a):
                yield out("pair", a, b)

        for b in batches:
            if not b.num_rows:
                continue
            held = [np.concatenate((h, b.column(i).to_numpy())) for i, h in enumerate(held)]
            band = held[0]
            if len(band) < 100_000:
                continue
            cut = int(np.searchsorted(band, band[-1]))  # the last band may go on
            if cut == 0 or len(band) - cut > band_rows:
                cut = len(band)  # large already: pass on what there is
            yield from solve([h[:cut] for h in held])
            hot = band[-1] if cut == len(band) else None
            held = [h[cut:] for h in held]
        yield from solve(held)

    return run


def _cells(df: DataFrame, blocks: str, side: str) -> DataFrame:
    """Each row in the cells (i, j), i <= j, of its band in which its block takes part: as i on the
    left side, as j on the right one."""
    span = F.sequence("__block", F.col(blocks) - 1) if side == "left" else F.sequence(F.lit(0), F.col("__block"))
    i, j = ("__block", "__at") if side == "left" else ("__at", "__block")
    return df.withColumn("__at", F.explode(span)).withColumns({"__i": F.col(i), "__j": F.col(j)}).drop("__block", "__at", blocks)


def _large_band_pairs(hot: DataFrame, most_bits: int, band_rows: int) -> DataFrame:
    sizes = hot.groupBy("band").agg(F.count("*").alias("n"))
    rows = salted_join(hot, sizes, "band", "n", F.col("id")).select(
        "band", "id", "phash", F.ceil(F.col("n") / band_rows).cast("int").alias("blocks")
    )
    rows = rows.withColumn("__block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = _cells(rows, "blocks", "left").withColumnRenamed("id", "x").withColumnRenamed("phash", "p")
    right = _cells(rows, "blocks", "right").withColumnRenamed("id", "y").withColumnRenamed("phash", "q")
    met = left.join(right.hint("merge"), ["band", "__i", "__j"]).where("(__i < __j or x < y) and bit_count(p ^ q) <= %d" % most_bits)
    return met.select(F.least("x", "y").alias("id"), F.greatest("x", "y").alias("other"))


def near_classes(ws: Workspace, classes: DataFrame, max_distance: int = MAX_DISTANCE, band_rows: int = BAND_ROWS) -> DataFrame:
    """(a, b) numbers of classes within the distance, a < b. ``classes`` is a written table of id and prints."""
    bands, values = signature_shape(classes.count(), max_distance)
    most_bits = max_distance // WEIGHTS[0]
    banded = classes.select("id", *PRINTS).mapInArrow(_emit(bands, values), BANDED)
    met = ws.save(banded.repartition("band").sortWithinPartitions("band").mapInArrow(_pair_bands(most_bits, band_rows), MET), "met")
    large = _large_band_pairs(met.where("other IS NULL").select("band", "id", "phash"), most_bits, band_rows)
    pairs = met.where("other IS NOT NULL").select("id", "other").unionAll(large).select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    for side in ("a", "b"):
        prints = classes.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in PRINTS))
        pairs = pairs.join(prints.hint("merge"), side)
    return pairs.where(distance("a_", "b_") <= max_distance).select("a", "b")


def readable_candidates(candidates: DataFrame) -> DataFrame:
    """(cid, four fingerprints as BIGINT) of the records that have all four."""
    rows = candidates.select("cid", *(readable(F.col(c)).alias(c) for c in PRINTS)).dropna()
    return rows.distinct()


def _classes(ws: Workspace, rows: DataFrame) -> DataFrame:
    """(id, class_cid, records, prints): each set of equal fingerprints, numbered in the written table."""
    own = rows.groupBy(*PRINTS).agg(F.min("cid").alias("class_cid"), F.count("*").alias("records"))
    return ws.save(own.withColumn("id", F.monotonically_increasing_id()), "classes")


def near_candidates(candidates: DataFrame, band_rows: int = BAND_ROWS, member_rows: int = MEMBER_ROWS) -> DataFrame:
    """(cid_a, cid_b), cid_a < cid_b: all pairs of records near enough, those of equal fingerprints included."""
    ws = Workspace(candidates.sparkSession, "minmax")
    rows = ws.save(readable_candidates(candidates), "prints")
    classes = _classes(ws, rows)
    near = near_classes(ws, classes, band_rows=band_rows)
    # members of each class in blocks; a pair of classes becomes cells of two blocks
    blocks = F.ceil(F.col("records") / member_rows).cast("int")
    keyed = classes.select(F.struct(*PRINTS).alias("key"), "id", "records", blocks.alias("blocks"))
    members = salted_join(rows.select("cid", F.struct(*PRINTS).alias("key")), keyed, "key", "records", F.col("cid")).select(
        "cid", "id", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block")
    )
    members = ws.save(members, "members")
    ws.drop(rows)
    size = classes.select("id", blocks.alias("blocks"))
    a, b = size.toDF("a", "na"), size.toDF("b", "nb")
    across = near.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    within = classes.where("records > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), blocks.alias("na"), blocks.alias("nb"))
    cells = (
        across.select("a", "b", "na", "nb")
        .unionAll(within)
        .withColumn("i", F.explode(F.expr("sequence(0, na - 1)")))
        .withColumn("j", F.explode(F.expr("sequence(if(a = b, i, 0), nb - 1)")))
        .drop("na", "nb")
    )
    x, y = members.toDF("x", "a", "i"), members.toDF("y", "b", "j")
    met = cells.join(x.hint("merge"), ["a", "i"]).join(y.hint("merge"), ["b", "j"]).where("a <> b or i <> j or x < y")
    return met.select(F.least("x", "y").alias("cid_a"), F.greatest("x", "y").alias("cid_b"))


def candidate_classes(candidates: DataFrame) -> DataFrame:
    """(class_cid, records, links) of each set of equal fingerprints: its least id, its records, and
    the number of other classes near it."""
    ws = Workspace(candidates.sparkSession, "minmax")
    classes = _classes(ws, readable_candidates(candidates))
    near = near_classes(ws, classes)
    ends = near.select(F.explode(F.array("a", "b")).alias("id"))
    links = ends.groupBy("id").agg(F.count("*").alias("links"))
    return classes.join(links.hint("merge"), "id", "left").select("class_cid", "records", F.coalesce("links", F.lit(0)).alias("links"))
