"""Lists and texts: order of elements, n-th element, insertion points."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftlog.operators.state import ID, OBJECT, op_id, visible
from weftlog.session import large


def by_group(df: DataFrame, keys: list[str], out: T.StructType, one: Callable[[dict[str, list]], list[tuple]]) -> DataFrame:
    """Applies `one` (a group's columns as lists) to each group: dealt by key, sorted within tasks, one group in memory at a time."""
    arrow = to_arrow_schema(out)
    names = df.columns

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, done = None, {}, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            lo = 0
            for key, stretch in itertools.groupby(zip(*(columns[names.index(k)] for k in keys), strict=True)):
                hi = lo + sum(1 for _ in stretch)
                part = {n: c[lo:hi] for n, c in zip(names, columns, strict=True)}
                lo = hi
                if held and key == here:
                    for n, c in part.items():
                        held[n] += c
                    continue
                if held:
                    done += one(held)
                here, held = key, part
            if len(done) >= 10_000:
                yield table(done)
                done = []
        yield table(done + (one(held) if held else []))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def walk(rows: list[tuple]) -> list[tuple]:
    """Elements (ctr, actor, ref_ctr, ref_actor) in list order: an element stands after its reference, later ids first."""
    after: dict = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        after.setdefault((r[2], r[3]), []).append((r[0], r[1]))
    head = min((k for k in after if k[0] == 0), default=None)
    out, stack = [], list(after.get(head, ()))
    while stack:
        e = stack.pop()
        out.append(e)
        stack.extend(after.get(e, ()))
    return out


def order(ops: DataFrame) -> DataFrame:
    """OBJECT, ctr, actor, place of every element that was ever inserted, tombstones too.

    The elements of a list form a tree under their references; the list is its walk, parents first and
    siblings by descending id. A list typed from left to right is a chain as deep as it is long, so the walk
    is done per list in linear time rather than by recursion over the whole log.
    """
    e = ops.where("insert").select(*OBJECT, *ID, F.col("key_ctr").alias("ref_ctr"), F.col("key_actor").alias("ref_actor"))
    schema = T.StructType([e.schema[c] for c in [*OBJECT, *ID]] + [T.StructField("place", T.LongType())])

    def one(rows: dict[str, list]) -> list[tuple]:
        found = walk(list(zip(rows["ctr"], rows["actor"], rows["ref_ctr"], rows["ref_actor"], strict=True)))
        own = tuple(rows[c][0] for c in OBJECT)
        return [(*own, *e, i) for i, e in enumerate(found)]

    return by_group(e, OBJECT, schema, one)


def elements(ops: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """OBJECT, ctr, actor, pos of elements with a visible operation, from 0; `shown` are the visible operations if known."""
    shown = (visible(ops) if shown is None else shown).where("key_str = ''").select(*OBJECT, F.col("key_ctr").alias("ctr"), F.col("key_actor").alias("actor")).distinct()
    w = Window.partitionBy(*OBJECT).orderBy("place")
    return order(ops).join(large(shown), [*OBJECT, *ID], "left_semi").select(*OBJECT, *ID, (F.row_number().over(w) - 1).cast("long").alias("pos"))


def nth(ops: DataFrame, n: int) -> DataFrame:
    """All visible values of the n-th element of each list."""
    at = elements(ops).where(F.col("pos") == n).withColumnsRenamed({"ctr": "key_ctr", "actor": "key_actor"})
    return visible(ops).where("key_str = ''").join(at, [*OBJECT, "key_ctr", "key_actor"])


def length(ops: DataFrame) -> DataFrame:
    """Number of elements with a visible operation; needs no order."""
    return visible(ops).where("key_str = ''").groupBy(*OBJECT).agg(F.countDistinct("key_ctr", "key_actor").alias("length"))


def lists(ops: DataFrame) -> DataFrame:
    """OBJECT of every list and text: made as one, or inserted into."""
    made = ops.where("action in ('make_list', 'make_text')").select("doc_id", F.col("ctr").alias("obj_ctr"), F.col("actor").alias("obj_actor"))
    return ops.where("insert").select(*OBJECT).union(made).distinct()


def insertion_points(ops: DataFrame) -> DataFrame:
    """For each index at which a list can be inserted into: the element that the new one refers to (0 and no actor: the head). An empty list has index 0."""
    e = elements(ops)
    after = e.select(*OBJECT, (F.col("pos") + 1).alias("index"), F.col("ctr").alias("ref_ctr"), F.col("actor").alias("ref_actor"))
    return lists(ops).select(*OBJECT, F.lit(0).cast("long").alias("index"), F.lit(0).cast("long").alias("ref_ctr"), F.lit(None).cast(e.schema["actor"].dataType).alias("ref_actor")).union(after)


def list_patches(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changes lists from one state of the log to another: OBJECT, kind, index, value, ctr, actor of the element.

    delete: the index is that of the element before; insert: that of the element after; put: the element shows another
    operation or value, at its index after. Deletes by descending and then inserts by ascending index lead from one state to the other.
    """

    def state(ops: DataFrame, name: str) -> DataFrame:
        best = visible(ops).where("key_str = ''").groupBy(*OBJECT, "key_ctr", "key_actor").agg(F.min(F.struct("ctr", "actor", "current")).alias(name))
        at = elements(ops).withColumnsRenamed({"ctr": "key_ctr", "actor": "key_actor", "pos": f"{name}_pos"})
        return at.join(best, [*OBJECT, "key_ctr", "key_actor"])

    both = state(before, "old").join(state(after, "new"), [*OBJECT, "key_ctr", "key_actor"], "full")
    kind = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").when(F.col("old") != F.col("new"), "put")
    return both.withColumn("kind", kind).where("kind is not null").select(*OBJECT, "kind", F.coalesce(F.when(F.col("kind") != "delete", F.col("new_pos")), F.col("old_pos")).alias("index"), F.col("new.current").alias("value"), F.col("key_ctr").alias("ctr"), F.col("key_actor").alias("actor"))


def text(ops: DataFrame) -> DataFrame:
    """Each text as one string: the winning string of each element, in order."""
    best = visible(ops).where("key_str = ''").groupBy(*OBJECT, "key_ctr", "key_actor").agg(F.min_by("value.s", op_id()).alias("s")).withColumnsRenamed({"key_ctr": "ctr", "key_actor": "actor"})
    parts = elements(ops).join(best, [*OBJECT, *ID]).groupBy(*OBJECT).agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("p"))
    return parts.select(*OBJECT, F.array_join(F.col("p.s"), "").alias("text"))
