"""Duplicates hidden by formatting differences, counted batch by batch (problem 2).

A ledger keeps one row a canonical key: how many records have it and the earliest of them. It
lies in buckets by key, each a folder of its own, and so does the list of records already counted, by record
number. A new batch is reduced to its records not seen before, aggregated by key, and joined full outer with the
ledger's buckets that it meets; counts are added and the earliest representative stays. Only the buckets met are read
and written again. A record delivered again, in the same or a later batch, changes nothing.

The key is the 128-bit MD5 of the canonical text. The same key in a third of all records meets
partial aggregation before the shuffle, and a salted join when copies are listed.

Defined cases: a record without a number or without an address is never a copy; null and empty
page addresses are equal; ties don't arise, as record numbers are unique after reduction; of
deliveries with one number but different content the least key counts; extra columns
don't matter; an empty table gives no rows; addresses of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm.urlkeys import with_canonical
from twinlens.operators.skew import salted_join
from twinlens.workspace import Workspace

#: Folders of the ledger and of the list of records; more of them make small batches touch less.
BUCKETS = 32
MEMBERS = "seq bigint, key binary"
LEDGER = "key binary, copies bigint, first_seq bigint"


def text_key(*parts: Column) -> Column:
    """128-bit key of canonical texts."""
    return F.unhex(F.md5(F.concat_ws("\x04", *parts)))


def address_pairs(df: DataFrame) -> DataFrame:
    """(seq, key, and ``loaded_at`` if there): the key of a hit is that of both its addresses, null
    where it has no address of its own."""
    named = df.select("seq", *[c for c in df.columns if c == "loaded_at"], F.col("url").alias("__u"), F.when(F.col("page_url") != "", F.col("page_url")).alias("__p"))
    canon = with_canonical(named.where(F.col("__u").isNotNull()), "__u", "__p")
    return canon.withColumn("key", text_key(F.col("__u"), F.coalesce("__p", F.lit("")))).drop("__u", "__p")


def record_key(*cols: Column) -> Column:
    """Key of a record of any fields: white space, letter case, punctuation and the order of fields
    are set aside, and null equals empty."""
    plain = [F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[\s\p{Z}\p{P}\p{S}\p{Cc}\p{Cf}]+", "") for c in cols]
    return text_key(F.array_join(F.array_sort(F.array(*plain)), "\x05"))


class CopyLedger:
    """The state: for each bucket its folder of ``ledger`` (key, copies, first_seq) and its folders of ``members``
    (seq, key)."""

    def __init__(self, spark: SparkSession, buckets: int = BUCKETS):
        self.spark, self.ws, self.buckets = spark, Workspace(spark, "ledger"), buckets
        self._ledger: dict[int, str] = {}
        self._members: dict[int, list[str]] = {}

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, name: str) -> dict[int, str]:
        """Write a table partitioned by its ``bucket``; the folders by bucket. A bucket is one file while it is small and
        several, of several tasks, when it is large."""
        path = self.ws.path(name)
        self.ws.write(df.hint("rebalance", "bucket").write.partitionBy("bucket"), path)
        return {int(f.rsplit("=", 1)[1]): f for f in self.ws.folders(path) if "bucket=" in f}

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def ledger(self) -> DataFrame:
        return self._read(list(self._ledger.values()), LEDGER)

    @property
    def members(self) -> DataFrame:
        return self._read([f for folders in self._members.values() for f in folders], MEMBERS)

    def update(self, batch: DataFrame, seq: Column, key: Column) -> CopyLedger:
        """Count a batch; ``batch`` may hold any columns."""
        rows = (
            batch.select(seq.cast("bigint").alias("seq"), key.alias("key"))
            .where(F.col("seq").isNotNull())
            .groupBy("seq")
            .agg(F.min("key").alias("key"))
            .where(F.col("key").isNotNull())  # above the aggregate: below, it would copy the key's expression
        )
        new = self._write(rows.withColumn("bucket", self._bucket("seq")), "batch")
        before = [f for b in new for f in self._members.get(b, [])]
        if before:
            batch_folders = list(new.values())
            fresh = self._read(batch_folders, MEMBERS).join(self._read(before, MEMBERS).select("seq").hint("merge"), "seq", "left_anti")
            new = self._write(fresh.withColumn("bucket", self._bucket("seq")), "new")
            self.ws.drop_paths(batch_folders)
        for b, folder in new.items():
            self._members.setdefault(b, []).append(folder)
        rows = self._read(list(new.values()), MEMBERS)
        met = [r[0] for r in rows.select(self._bucket("key")).distinct().collect()]
        fresh = rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("seq").alias("first_seq"))
        a, b = self._read([self._ledger[k] for k in met if k in self._ledger], LEDGER).alias("a"), fresh.alias("b")
        merged = a.join(b.hint("merge"), "key", "full_outer").select(
            "key",
            (F.coalesce("a.copies", F.lit(0)) + F.coalesce("b.copies", F.lit(0))).alias("copies"),
            F.least("a.first_seq", "b.first_seq").alias("first_seq"),
        )
        written = self._write(merged.withColumn("bucket", self._bucket("key")), "ledger")
        self.ws.drop_paths([self._ledger[k] for k in written if k in self._ledger])
        self._ledger |= written
        return self

    def copies(self) -> DataFrame:
        """(first_seq, seq): each record that repeats an earlier one."""
        repeated = self.ledger.where("copies > 1").select("key", "copies", "first_seq")
        return salted_join(self.members, repeated, "key", "copies", F.col("seq")).where("seq > first_seq").select("first_seq", "seq")

    def representatives(self) -> DataFrame:
        """(first_seq, copies): each distinct record once, with the number of its copies."""
        return self.ledger.select("first_seq", "copies")


def batch_number(df: DataFrame, time_col: str, n: int) -> Column:
    """Which of ``n`` equal spans of time a row falls into, from 0; rows without a time are in the last."""
    t = F.unix_micros(F.col(time_col).cast("timestamp"))
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    if lo is None or lo == hi:
        return F.lit(0)
    step = (hi - lo) / n
    return F.coalesce(F.least(F.floor((t - lo) / step), F.lit(n - 1)), F.lit(n - 1)).cast("int")


def hit_ledger(hits: DataFrame, batches: int = 3) -> CopyLedger:
    """A ledger of hits, brought up to date delivery by delivery in the order of loaded_at. The keys are made in one
    pass over the hits, which are laid out by batch."""
    book = CopyLedger(hits.sparkSession)
    keyed = address_pairs(hits.select("seq", "url", "page_url", "loaded_at"))
    path = book.ws.path("deliveries")
    keyed.select("seq", "key", batch_number(hits, "loaded_at", batches).alias("batch")).write.partitionBy("batch").parquet(path)
    for folder in sorted(f for f in book.ws.folders(path) if "batch=" in f):
        book.update(book._read([folder], MEMBERS), F.col("seq"), F.col("key"))
    book.ws.drop_paths([path])
    return book
