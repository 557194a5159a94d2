"""What the operators of this folder share: tables, ranks without large groups, components, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from weftlog.session import settle

#: Words of most contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step takes at most, but for a single longer text.
STEP_BYTES = 1 << 19
#: Whole texts that one Arrow batch holds at most: batches lie outside the heap, once on each side.
BATCH_TEXTS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bits_for(rows: int) -> int:
    """Bits of a hash to deal a group by: one group with all rows leaves some 50,000 to a bucket."""
    return min(20, max(8, (rows // 50_000).bit_length()))


def running(df: DataFrame, group: list[str], key: Column, ties: list, bits: int, value: str | None = None, name: str = "before") -> DataFrame:
    """Adds, for each row, the sum of `value` (or number of rows) before it within its group.

    The order is that of `key`, a 64-bit hash, then of `ties`. A group of any size is spread over
    2 ** bits windows by the hash's first bits: their sums (so many rows a group) give each its
    start. Columns in `group` must not be null. Rows that tie in everything are interchangeable.
    """
    df = df.withColumn("_hash", key).withColumn("_bucket", F.shiftright("_hash", 64 - bits))
    one = F.col(value) if value else F.lit(1).cast("long")
    starts = df.groupBy(*group, "_bucket").agg(F.sum(one).alias("_sum"))
    w = W.Window.partitionBy(*group).orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = starts.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_start"))
    inner = W.Window.partitionBy(*group, "_bucket").orderBy("_hash", *ties).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    joined = df.join(starts, [*group, "_bucket"])
    return joined.withColumn(name, (F.col("_start") + F.sum(one).over(inner) - one).cast("long")).drop("_bucket", "_start", "_hash")


def least_of_each(df: DataFrame, group: str, sizes: dict, key: Column, most: int) -> DataFrame:
    """The rows of each group with the smallest hashes `key`: about `most` and never more, but all of a group that is no larger.

    `sizes`: rows by group. A threshold cuts each group to some more than `most`, so that the ranks that follow are over few rows,
    whatever the group's size.
    """
    cut = F.lit(False)
    for value, n in sizes.items():
        part = min(1.0, (most + 8 * most**0.5 + 64) / max(1, n))
        cut = cut | ((F.col(group) == F.lit(value)) & (F.col("_key") <= F.lit(int(-(2**63) + part * (2**64 - 1)) if part < 1 else 2**63 - 1)))
    w = W.Window.partitionBy(group).orderBy("_key", *[c for c in df.columns if c != group])
    return df.withColumn("_key", key).where(cut).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_key", "_rank")


#: Bits of the map below: 8 MB as it is sent.
MAP_BITS = 26


def mark_ids(df: DataFrame, key: str, ids: DataFrame, other: str, name: str) -> DataFrame:
    """Adds boolean `name`: false only if the row's key is not among `ids`.

    A bit map of hashes of fixed size (2 ** MAP_BITS bits, as at most 2 ** (MAP_BITS - 6) rows) is broadcast;
    with more ids than it can tell apart it marks more rows, never fewer.
    """
    place = F.shiftright(F.xxhash64(F.col(other), F.lit(5)), 64 - MAP_BITS)
    words = ids.select(place.alias("_p")).select(F.shiftright("_p", 6).alias("_word"), F.expr("shiftleft(1L, int(_p & 63))").alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    own = F.shiftright(F.xxhash64(F.col(key), F.lit(5)), 64 - MAP_BITS)
    df = df.withColumn("_own", own).withColumn("_word", F.shiftright("_own", 6))
    out = df.join(F.broadcast(words), "_word", "left")
    return out.withColumn(name, F.expr("coalesce((_bits & shiftleft(1L, int(_own & 63))) <> 0, false)")).drop("_own", "_word", "_bits")


def without_ids(df: DataFrame, key: str, ids: DataFrame, other: str) -> DataFrame:
    """Rows whose key is not among `ids` (settled); only rows that may be are shuffled."""
    marked = mark_ids(df, key, ids, other, "_maybe")
    sure = marked.where("not _maybe").drop("_maybe")
    rest = marked.where("_maybe").drop("_maybe").join(ids.select(F.col(other).alias("_other")), F.col(key) == F.col("_other"), "left_anti")
    return sure.unionByName(rest)


def components(edges: DataFrame, a: str, b: str, parts: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable; nodes without an edge are not listed.

    Alternates large-star and small-star steps until the edges stay as they are; each step
    is cut off in the shared folder, in at most `parts` files. The work of a step grows with the edges, the number of
    steps with the logarithm of the longest path. Joins run on freshly cut tables, so that
    adaptive execution can split the partition of a node with very many neighbours.
    """

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    e = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), parts=parts)
    was = mark(e)
    while was[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of a node goes to the smallest of its neighbourhood
        e = settle(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), parts=parts)
        # small star: the smaller neighbours and the node itself go to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = settle(e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.*").where("u <> v").distinct(), parts=parts)
        now = mark(e)
        if now == was:
            break
        was = now
    leaves = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return leaves.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def map_texts(df: DataFrame, keep: list[str], text: str, fields: list[T.StructField], make: Callable[[list], list]) -> DataFrame:
    """Applies `make` (texts in, one list per field out) to whole texts, in Arrow batches cut by size.

    Columns in `keep`, the text among them or not, go through unchanged. Texts come as UTF-8 bytes (None where null).
    """
    names = keep if text in keep else [*keep, text]
    df = df.select(*names)
    conf, batch = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(batch, "10000")) <= BATCH_TEXTS:
        conf.set(batch, str(BATCH_TEXTS))
    at, schema = names.index(text), T.StructType([*[f for c in keep for f in df.schema.fields if f.name == c], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                made = make(part.column(at).cast(pa.large_binary()).to_pylist())
                new = [pa.array(x, f.type) for x, f in zip(made, list(arrow)[len(keep) :], strict=True)]
                kept = [a.cast(f.type) for a, f in zip(part.columns, list(arrow)[: len(keep)], strict=False)]
                yield pa.RecordBatch.from_arrays([*kept, *new], schema=arrow)

    return df.mapInArrow(run, schema)


def pieces(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
