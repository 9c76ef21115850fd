"""Exact deduplication against everything written before, batch by batch.

An index holds the digest of every text that was ever kept.  A Bloom filter of
it, a table of 64-bit words that is kept up with each batch, is read first:
texts it has never seen skip the join with the index, and only the others are
joined, exactly.  The filter has a fixed number of bits, so it can be broadcast
whatever the index holds; when it fills up more texts take the join, and the
result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.publish import publish, read_published

#: Bits of the filter (2 MB), and how many of them a digest sets.
BITS, HASHES = 1 << 24, 5


def with_digest(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``sha`` and ``len``: equal for equal texts (null is a text of its own)."""
    return rows.withColumns({"sha": F.sha2(F.coalesce(F.col(text), F.lit("")), 256), "len": F.coalesce(F.octet_length(text), F.lit(-1)).cast("long")})


def _places(bits: int) -> Column:
    """The bits that a digest sets."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), "sha", "len"), F.lit(bits)) for k in range(HASHES)])


def bloom_words(digests: DataFrame, bits: int = BITS) -> DataFrame:
    """``word, mask``: the filter of the digests, 64 bits a row."""
    place = digests.select(F.explode(_places(bits)).alias("p"))
    word, bit = F.floor(F.col("p") / 64), (F.col("p") % 64).cast("int")
    return place.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("mask"))


class SeenTexts:
    """The index at ``path``, of one number of bits."""

    def __init__(self, spark: SparkSession, path: str, bits: int = BITS):
        self.spark, self.path, self.bits = spark, path.rstrip("/"), bits

    def digests(self) -> DataFrame:
        """``sha, len`` of every text kept so far."""
        return read_published(self.spark, f"{self.path}/digests", "sha string, len long").select("sha", "len")

    def filter(self) -> DataFrame:
        """One row: the filter's words as an array."""
        kept = read_published(self.spark, f"{self.path}/bloom", "word long, mask long")
        words = kept.groupBy("word").agg(F.bit_or("mask").alias("mask"))
        every = self.spark.range(-(-self.bits // 64)).withColumnRenamed("id", "word").join(words, "word", "left")
        # At most BITS / 64 rows, which is the bound of what is broadcast.
        pairs = F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask"))))
        return every.agg(F.transform(pairs, lambda p: p["mask"]).alias("bloom"))

    def unseen(self, rows: DataFrame, text: str, key: str) -> DataFrame:
        """The rows whose text was not kept before; of equal ones among them the lowest ``key`` (ties: any, once)."""
        first = with_digest(rows, text).withColumn("_all", F.struct(*rows.columns))
        # The digest travels with the key; the row itself only once it is known to stay.
        least = first.groupBy("sha", "len").agg(F.min(key).alias("_key"))
        word = lambda p: F.get(F.col("bloom"), F.floor(p / 64).cast("int"))
        bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))
        maybe = F.forall(_places(self.bits), lambda p: word(p).bitwiseAND(bit(p)) != 0)
        tested = least.join(F.broadcast(self.filter()), how="left").select("sha", "len", "_key", maybe.alias("maybe"))
        old = tested.where("maybe").join(self.digests(), ["sha", "len"], "left_anti")
        kept = tested.where("NOT maybe").unionByName(old).select("sha", "len", "_key")
        chosen = first.join(kept, ["sha", "len"]).where(F.col(key).eqNullSafe(F.col("_key")))
        return chosen.groupBy("sha", "len").agg(F.min("_all").alias("_all")).select("_all.*")

    def add(self, kept: DataFrame, text: str, batch: str) -> bool:
        """Puts the texts of ``kept`` into the index as ``batch``; False if that batch is there already."""
        digests = with_digest(kept, text).select("sha", "len").distinct()
        # The filter goes first: one that knows more than the index only sends more texts through the join.
        publish(bloom_words(digests, self.bits), f"{self.path}/bloom", batch)
        return publish(digests, f"{self.path}/digests", batch)
