"""Sharding by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import bits_for, running
from weftlog.session import settle


def deal(sizes: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """Longest-processing-time scheduling of (size, number of groups of exactly that size), largest size first.

    Returns for each size how many of its groups each shard gets. Groups go one by one to the
    least-loaded shard of a heap. Of many groups of one size, those whose shards are below a common level before
    they come go at once: they are the ones that the heap would take first.
    """
    loads = [0] * shards
    out = []
    for size, n in sizes:
        counts = [0] * shards
        left = n
        if n > 4 * shards and size > 0:
            lo, hi = min(loads), max(loads) + size * (n // shards + 1)
            while hi - lo > 1:  # the highest level up to which all fit
                mid = (lo + hi) // 2
                if sum(max(0, (mid - x) // size) for x in loads) <= n:
                    lo = mid
                else:
                    hi = mid
            counts = [max(0, (lo - x) // size) for x in loads]
            left = n - sum(counts)
            loads = [x + c * size for x, c in zip(loads, counts, strict=True)]
        heap = [(x, i) for i, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(left):
            x, i = heap[0]
            counts[i] += 1
            loads[i] = x + size
            heapq.heapreplace(heap, (loads[i], i))
        out.append(counts)
    return out


def assign(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Puts every document into one of `shards` shards of nearly equal bytes; equal texts share a shard.

    Size: UTF-8 bytes of the text plus 8. Groups (equal texts; null texts are one, apart from
    empty ones) are totalled with partial sums and counted by their exact total; the driver schedules them
    longest first through a heap, and a group's rank among those of its total says which shard it goes to.
    The driver holds one row a distinct total. Distinct totals add up to the corpus at most, so there are no more than
    the square root of twice its bytes (14 million for 100 TB, 16 bytes each); Spark joins them back by
    broadcast only below its own threshold. One group cannot be divided: if it is larger than the mean shard,
    its shard is larger too. Groups of equal totals are told apart by their texts' hashes, so reruns agree.

    Returns doc_id, size, text_crc32 (null for a null text), law ("bytes"), shard, slot (gapless
    from 0 in each shard), grown_shard (null). An empty table gives no rows. Rows that repeat a
    doc_id each get a slot; a null doc_id stays null. Other columns of `docs` are not read.
    """
    d = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col(text).cast("binary")).cast("long").alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit(b"")).otherwise(F.unhex(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 32))).alias("_key"),
    )
    d = settle(d, compact=True)
    groups = settle(d.groupBy("_key").agg(F.sum("size").alias("_total"), F.count("*").alias("_copies")), narrow=True)
    spark = docs.sparkSession
    totals = groups.groupBy("_total").agg(F.count("*").alias("n"), F.sum("_copies").alias("rows")).collect()
    totals.sort(key=lambda r: -r["_total"])
    rows = []
    for r, counts in zip(totals, deal([(r["_total"], r["n"]) for r in totals], shards), strict=True):
        ends, own, at = [], [], 0
        for i, c in enumerate(counts):
            if c:
                ends.append(at := at + c)
                own.append(i)
        rows.append((r["_total"], ends, own))
    plan = spark.createDataFrame(rows, "_total long, _ends array<long>, _shards array<int>")
    ranked = running(groups, ["_total"], F.xxhash64("_key", F.lit(17)), ["_key"], bits_for(sum(r["n"] for r in totals)), name="_rank")
    shard = F.expr("_shards[int(size(filter(_ends, x -> x <= _rank)))]")
    placed = ranked.join(plan, "_total").select("_key", shard.alias("shard"))
    d = settle(d.join(placed, "_key").drop("_key"), narrow=True)
    d = running(d, ["shard"], F.xxhash64("doc_id", F.lit(19)), ["doc_id", "size", "text_crc32"], bits_for(sum(r["rows"] for r in totals)), name="slot")
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
