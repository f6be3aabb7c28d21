"""64-bit fingerprints as BIGINT: text forms, differences, fused similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinlens.config import HASH, normalised

#: Order in which a tie for the best or worst hash is settled.
ORDER = ["ahash", "dhash", "phash", "whash"]


def from_hex(text: Column) -> Column:
    """BIGINT of up to 16 hexadecimal digits; null if it isn't one."""
    ok = F.regexp_extract(F.lower(F.trim(text)), r"^(?:0x)?([0-9a-f]{1,16})$", 1)
    return F.when(ok != "", F.conv(ok, 16, -10).cast("bigint"))


def to_hex(bits: Column) -> Column:
    """16 lower-case digits."""
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def from_bits(bits: Column) -> Column:
    """BIGINT of a string of up to 64 zeros and ones, the first the highest."""
    return F.conv(bits, 2, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column, bits: int = HASH.bits) -> Column:
    """Share of equal bits, in [0, 1]."""
    return 1.0 - hamming(a, b) / float(bits)


def compare(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """fused, best, worst and best_name over the four hashes."""
    w = normalised(HASH.weights)
    sims = {k: similarity(a[k], b[k]) for k in ORDER}
    fused = reduce(lambda x, y: x + y, (sims[k] * w[k] for k in HASH.weights))
    best = F.greatest(*sims.values())
    name = reduce(lambda rest, k: F.when(sims[k] == best, k).otherwise(rest), reversed(ORDER[:-1]), F.lit(ORDER[-1]))
    return {"fused": fused, "best": best, "worst": F.least(*sims.values()), "best_name": name}


def rehydrate(text: Column) -> Column:
    """Fingerprint struct from its JSON report form: hashes in hexadecimal; the colour histogram isn't
    in the report and becomes zeros; null if anything needed is missing or unreadable."""
    raw = F.from_json(text, "sha256 string, width int, height int, ahash string, dhash string, phash string, whash string, luma_mean double, luma_std double")
    bits = {k: from_hex(raw[k]) for k in ORDER}
    ready = reduce(lambda x, y: x & y, (b.isNotNull() for b in bits.values()))
    return F.when(
        ready & raw["width"].isNotNull() & raw["height"].isNotNull(),
        F.struct(
            raw["sha256"].alias("sha256"),
            raw["width"].alias("width"),
            raw["height"].alias("height"),
            *(bits[k].alias(k) for k in ORDER),
            F.array_repeat(F.lit(0.0).cast("float"), 64).alias("color_hist"),
            raw["luma_mean"].alias("luma_mean"),
            raw["luma_std"].alias("luma_std"),
        ),
    )
