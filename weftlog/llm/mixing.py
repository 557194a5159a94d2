"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlog.llm.common import bits_for, running, word_count
from weftlog.session import settle

#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
SLOTS = 1 << 18
CYCLE = (1, 2, 3)
MOST_REPEATS = 3


def targets(sizes: dict, weights: dict, most: int = MOST_REPEATS) -> dict:
    """Shares of the total of all sizes by weight; none above `most` times its size, the excess reshared by weight."""
    rest, out = float(sum(sizes.values())), {}
    open_ = {k for k in sizes}
    while open_:
        per = rest / sum(weights[k] for k in open_)
        full = {k for k in open_ if per * weights[k] > most * sizes[k]}
        if not full:
            return out | {k: per * weights[k] for k in open_}
        out |= {k: float(most * sizes[k]) for k in full}
        rest -= sum(out[k] for k in full)
        open_ -= full
    return out


def schedule(spark: SparkSession, shares: list[tuple[int, float]], slots: int = SLOTS) -> DataFrame:
    """(slot, source_no, rank): golden-ratio points mapped through the cumulative shares, ranked per source.

    Any stretch of slots holds each source close to its share. `shares` is one row a source.
    """
    total = sum(x for _, x in shares)
    rows, at = [], 0.0
    for no, x in shares:
        rows.append((no, at / total, (at := at + x) / total))
    rows[-1] = (*rows[-1][:2], 1.0)
    ends = [r[2] for r in rows]
    turn = F.col("slot") * F.lit(GOLDEN)
    point = spark.range(slots).select(F.col("id").alias("slot")).withColumn("_p", turn - F.floor(turn))
    # a binary search among the cumulative shares
    cut = F.array(*[F.lit(x) for x in ends[:-1]]) if len(ends) > 1 else F.array().cast("array<double>")
    nos = F.array(*[F.lit(no) for no, _, _ in rows])
    point = point.withColumn("source_no", F.element_at(nos, F.size(F.filter(cut, lambda x: x <= F.col("_p"))) + 1)).drop("_p")
    # slots keep their order: the bucket is a stretch of slots
    stretch = max(1, slots // 512)
    point = point.withColumn("_stretch", F.floor(F.col("slot") / stretch))
    return ranked(point)


def ranked(point: DataFrame) -> DataFrame:
    """Gapless ranks of slots per source, stretch by stretch."""
    counts = point.groupBy("source_no", "_stretch").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("source_no").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_no", "_stretch", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_from"))
    inner = Window.partitionBy("source_no", "_stretch").orderBy("slot")
    return point.join(counts, ["source_no", "_stretch"]).select("slot", "source_no", (F.col("_from") + F.row_number().over(inner) - 1).cast("long").alias("rank"))


def blocks_of(total: int, slots: int) -> tuple[int, int, int]:
    """(words of a block, number of slots, words of the last slot) for a mix of `total` words in about `slots` slots."""
    block = max(1, round(total / slots))
    used = -(-total // block)
    return block, used, total - (used - 1) * block


def mix(docs: DataFrame, slots: int = SLOTS, text: str = "text", source: str = "source", doc_id: str = "doc_id", plan=schedule) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Sources in code-point order (null last) weigh 1, 2, 3, repeating. Each source's documents, in a
    seeded shuffle, form one stretch of words cut into blocks of equal tokens, which begins anew after its end, at
    most MOST_REPEATS times in all. `plan` gives the slots of the mix to the sources; a source's k-th slot takes
    its k-th block. What a document gives is the sum over the blocks that have met a slot: so the sources' words are
    what the schedule makes them, which is within a few blocks of the targets (a block is a `slots`-th of all words, or one word).

    Returns doc_id, source, size (words), source_size, target, taken, starts (for each time that the document
    is taken its place in the source's passes and the slot of the block in which it begins), first_slot (null if none is taken).
    Documents without words take none. A null text has no words; an empty table gives no rows. Rows that repeat a
    doc_id are documents of their own; other columns are not read. Only the sources' totals
    (one row a source) come to the driver, and the schedule (about `slots` rows) is broadcast. Same input, same result.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    d = settle(d, compact=True)
    spark = docs.sparkSession
    sums = {r["source"]: (r["s"], r["n"]) for r in d.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    names = sorted((k for k in sums if k is not None), key=lambda k: k.encode()) + [k for k in sums if k is None]
    no = {k: i for i, k in enumerate(names)}
    goal = targets({k: sums[k][0] for k in names}, {k: CYCLE[no[k] % len(CYCLE)] for k in names})
    total = sum(s for s, _ in sums.values())
    info = spark.createDataFrame([(no[k], k, sums[k][0], goal[k]) for k in names], "_no int, _source string, source_size long, target double")
    d = d.join(F.broadcast(info), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    nothing = [F.lit(0).cast("long").alias("taken"), F.expr("cast(array() as array<struct<at: bigint, slot: bigint>>)").alias("starts"), F.lit(None).cast("long").alias("first_slot")]
    if not total:
        return d.select(*columns, *nothing)
    block, used, last = blocks_of(total, slots)
    sched = settle(plan(spark, [(no[k], goal[k]) for k in names if goal[k] > 0], used).withColumn("words", F.when(F.col("slot") == used - 1, last).otherwise(block).cast("long")), narrow=True)
    held = sched.groupBy("source_no").agg(F.count("*").alias("_held"))
    rows = sum(n for _, n in sums.values())
    d = running(d, ["_no"], turn_of(F.col("doc_id")), ["doc_id", "size"], bits_for(rows), value="size", name="_at")
    d = settle(d.join(F.broadcast(held), F.col("_no") == F.col("source_no"), "left").drop("source_no"), narrow=True)
    # as far as the source's slots reach, each time that a document comes up: from word _from to _to of the passes, and the blocks that hold it
    reach = F.least(F.coalesce("_held", F.lit(0)) * block, MOST_REPEATS * F.col("source_size"))
    d = d.withColumn("_reach", reach)
    idle = d.where("size = 0 or _at >= _reach").select(*columns, *nothing)
    again = F.floor((F.col("_reach") - 1 - F.col("_at")) / F.col("source_size")).cast("long")
    d = d.where("size > 0 and _at < _reach").withColumn("_from", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), again), lambda p: F.col("_at") + p * F.col("source_size"))))
    d = d.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_reach")))
    d = d.withColumn("rank", F.explode(F.sequence(F.floor(F.col("_from") / block).cast("long"), F.floor((F.col("_to") - 1) / block).cast("long"))))
    # the block meets its slot
    key = (F.col("source_no").cast("long") * F.lit(1 << 32) + F.col("rank")).alias("_block")
    d = d.withColumn("_block", F.col("_no").cast("long") * F.lit(1 << 32) + F.col("rank")).join(F.broadcast(sched.select(key, "slot", "words")), "_block")
    words = F.greatest(F.lit(0), F.least(F.col("_to"), F.col("rank") * block + F.col("words")) - F.greatest(F.col("_from"), F.col("rank") * block))
    begins = F.when((F.col("rank") == F.floor(F.col("_from") / block)) & (words > 0), F.struct(F.col("_from").alias("at"), F.col("slot").alias("slot")))
    # a document is its place in its source, as ids may repeat
    firsts = [F.first(c).alias(c) for c in columns]
    d = d.groupBy("_no", "_at").agg(*firsts, F.sum(words).cast("long").alias("taken"), F.sort_array(F.collect_list(begins)).alias("starts"), F.min(F.when(words > 0, F.col("slot"))).alias("first_slot"))
    return idle.unionByName(d.drop("_no", "_at"))


def turn_of(doc_id):
    """Where a document stands in the shuffle of its source."""
    return F.xxhash64(doc_id, F.lit(29))


def repeat(docs: DataFrame, mixed: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mixed corpus in the order of the schedule: each row of `docs` as often as its words were taken, to the nearest whole number.

    Every repeat stands where the block comes in which it begins, so any stretch of rows holds the sources close to their
    shares. Rows that agree in id, source and words are told apart by number. Documents without words go.
    """
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    plan = mixed.where("taken > 0").select(F.struct("doc_id", "source", "size").alias("_key"), F.slice("starts", F.lit(1), times).alias("_starts")).where("size(_starts) > 0")
    plan = plan.groupBy("_key").agg(F.sort_array(F.collect_list("_starts")).alias("_all"))
    names = docs.columns
    d = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    col = {c: f"_c{i}" for i, c in enumerate(names)}
    d = d.withColumn("_size", word_count(F.col(col[text]))).where("_size > 0")
    d = d.withColumn("_key", F.struct(F.col(col[doc_id]).alias("doc_id"), F.col(col[source]).alias("source"), F.col("_size").alias("size"))).drop("_size")
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(col[text]))))
    d = d.join(plan, "_key").withColumn("_start", F.explode(F.get("_all", F.col("_i") - 1)))
    return d.orderBy("_start.slot", col[source], "_start.at").select(*col.values()).toDF(*names)
