"""The Bloom filter of the sync protocol, as expressions: 10 bits an entry, 7 probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.session import large

# fixed values of the protocol
BITS_PER_ENTRY = 10
NUM_PROBES = 7


def bits(entries: Column) -> Column:
    return (F.ceil(entries * BITS_PER_ENTRY / 8) * 8).cast("long")


def word(hash_: Column, i: int) -> Column:
    """The i-th little-endian 32-bit word of a hash in hex."""
    pairs = [F.substring(hash_, 8 * i + 2 * j + 1, 2) for j in (3, 2, 1, 0)]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")


def probes(hash_: Column, m: Column) -> Column:
    """The bit positions of an entry in a filter of m bits, as an array."""
    x, y, z = (F.pmod(word(hash_, i), m) for i in range(3))
    return F.array(*[F.pmod(x + i * y + (i * (i - 1) // 2) * z, m) for i in range(NUM_PROBES)])


def build(entries: DataFrame) -> DataFrame:
    """doc_id, m, set_bits of the filter over (doc_id, hash); duplicates of a bit go before the shuffle."""
    n = entries.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", bits(F.col("n")).alias("m"))
    return entries.join(n, "doc_id").select("doc_id", "m", F.explode(probes(F.col("hash"), F.col("m"))).alias("bit")).distinct()


def may_contain(entries: DataFrame, filters: DataFrame) -> DataFrame:
    """(doc_id, hash, maybe) for each entry; an empty filter contains nothing."""
    m = filters.select("doc_id", "m").distinct()
    p = entries.select("doc_id", "hash").join(m, "doc_id", "left").select("doc_id", "hash", F.explode_outer(F.array_distinct(probes(F.col("hash"), F.col("m")))).alias("bit"))
    hit = p.join(large(filters.select("doc_id", "bit", F.lit(1).alias("hit"))), ["doc_id", "bit"], "left")
    return hit.groupBy("doc_id", "hash").agg((F.sum(F.coalesce("hit", F.lit(0))) == F.count("*")).alias("maybe"))
