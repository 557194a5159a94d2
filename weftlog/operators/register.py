"""Reads of maps and elements: winners, conflicts, keys, lengths. `sets`: the sets of predecessors that `ops` name, if any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.operators.state import ID, OBJECT, REGISTER, op_id, state, visible


def winner(ops: DataFrame, rule: str = "min", shown: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """The value of each register: its visible operation of the smallest id (`max`: the largest)."""
    pick = F.min_by if rule == "min" else F.max_by
    rows = visible(ops, sets) if shown is None else shown
    best = rows.groupBy(*REGISTER).agg(pick(F.struct(*ID, "action", "value", "current"), op_id()).alias("w"), F.count("*").alias("n_values"))
    return best.select(*REGISTER, "w.*", "n_values")


def conflicts(ops: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """All visible values of each register with their rank, largest id first; the last one wins."""
    w = Window.partitionBy(*REGISTER).orderBy(F.col("ctr").desc(), F.col("actor").desc())
    return visible(ops, sets).select(*REGISTER, *ID, "action", "value", "current", F.row_number().over(w).cast("long").alias("rank"))


def conflict_sets(ops: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """The conflict set of each register as an array, largest id first."""
    return visible(ops, sets).groupBy(*REGISTER).agg(F.sort_array(F.collect_list(F.struct(*ID, "current")), asc=False).alias("values"))


def conflict_counts(ops: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    return visible(ops, sets).groupBy(*REGISTER).agg(F.count("*").alias("n_values"))


def keys(ops: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Keys of maps that have a visible operation, once each."""
    return visible(ops, sets).where("key_str <> ''").select(*OBJECT, "key_str").distinct()


def ranked_keys(ops: DataFrame, reverse: bool = False, sets: DataFrame | None = None) -> DataFrame:
    """Keys with their place in byte order (or its reverse) within the object."""
    order = F.col("key_str").desc() if reverse else F.col("key_str")
    return keys(ops, sets).withColumn("pos", F.row_number().over(Window.partitionBy(*OBJECT).orderBy(order)).cast("long"))


def map_length(ops: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Number of keys, as a distinct count: partial sums before the shuffle."""
    return visible(ops, sets).where("key_str <> ''").groupBy(*OBJECT).agg(F.countDistinct("key_str").alias("length"))


def deleted_keys(ops: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Keys that were written and have no visible operation left."""
    return state(ops, sets=sets).where("key_str <> ''").groupBy(*OBJECT, "key_str").agg(F.count_if("visible").alias("n")).where("n = 0").drop("n")


def object_types(ops: DataFrame) -> DataFrame:
    """Objects, their types and their parents, from the operations that made them; the root is a map without a parent."""
    made = ops.where(F.col("action").startswith("make_")).select("doc_id", F.col("ctr").alias("obj_ctr"), F.col("actor").alias("obj_actor"), F.substring("action", 6, 10).alias("type"), F.col("obj_ctr").alias("parent_ctr"), F.col("obj_actor").alias("parent_actor"), "key_str")
    kind = ops.schema["actor"].dataType
    none = F.lit("" if kind.simpleString() == "string" else 0).cast(kind)
    return ops.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("obj_ctr"), none.alias("obj_actor"), F.lit("map").alias("type"), F.lit(None).cast("long").alias("parent_ctr"), F.lit(None).cast(kind).alias("parent_actor"), F.lit("").alias("key_str")).union(made)


def operation(ops: DataFrame, ctr: int, actor) -> DataFrame:
    """The operation of an id, in every document that has it."""
    return ops.where((F.col("ctr") == ctr) & (F.col("actor") == F.lit(actor)))


def text_id(ctr: str = "ctr", actor: str = "actor") -> Column:
    """ctr@actor, or _root for the root."""
    return F.when(F.col(ctr) == 0, F.lit("_root")).otherwise(F.concat(F.col(ctr).cast("string"), F.lit("@"), F.col(actor).cast("string")))


def parse_id(text: Column) -> Column:
    """The id that text_id printed, as struct<ctr, actor>; the root is (0, '')."""
    parts = F.split(text, "@")
    return F.when(text == "_root", F.struct(F.lit(0).cast("long").alias("ctr"), F.lit("").alias("actor"))).when(text.rlike("^[0-9]+@[0-9a-f]*$"), F.struct(parts[0].cast("long").alias("ctr"), parts[1].alias("actor")))


def parse_path(text: Column) -> Column:
    """`id`, `id/p1/p2` or `/p1/p2` as struct<id, path>: the object it begins at (the root without one) and the JSON pointer from there ('' for none)."""
    start = F.regexp_extract(text, "^[^/]*", 0)
    own = parse_id(F.when(start == "", F.lit("_root")).otherwise(start))
    return F.when(own.isNotNull(), F.struct(own.alias("id"), F.regexp_extract(text, "^[^/]*(.*)$", 1).alias("path")))
