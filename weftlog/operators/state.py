"""State of operations: successors, visibility and counters, as a function of the set of operations.

Tables have the canonical columns: doc_id, (ctr, actor) the operation's id, (obj_ctr, obj_actor) its object, key_str or
(key_ctr, key_actor) its key or element ('' and 0 where the other is used), insert, action (set, inc, del, make_*),
value and pred. Any actor type with the wanted order will do.

Where many operations overwrite the same ones, `pred` need not list them in each: an operation may name a set in its column pred_set
(null: none), beside what its pred lists. The sets are a table `sets` of REGISTER, pred_set, ctr, actor, one row a member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.session import large

OBJECT = ["doc_id", "obj_ctr", "obj_actor"]
REGISTER = [*OBJECT, "key_str", "key_ctr", "key_actor"]
ID = ["ctr", "actor"]


def op_id(prefix: str = "") -> Column:
    """The id as one value; its order is that of counters, then actors."""
    return F.struct(F.col(f"{prefix}ctr").alias("ctr"), F.col(f"{prefix}actor").alias("actor"))


def keyed(ops: DataFrame) -> DataFrame:
    """Each operation under the register it writes: an insertion's element is its own id. Keeps its reference as ref_ctr, ref_actor."""
    ref = ops.withColumn("ref_ctr", F.col("key_ctr")).withColumn("ref_actor", F.col("key_actor"))
    return ref.withColumn("key_ctr", F.when(F.col("insert"), F.col("ctr")).otherwise(F.col("key_ctr"))).withColumn("key_actor", F.when(F.col("insert"), F.col("actor")).otherwise(F.col("key_actor")))


def links(ops: DataFrame) -> DataFrame:
    """One row per (operation, predecessor) within one register: p_ctr, p_actor, and the operation's id, action and amount."""
    rows = keyed(ops).where(F.size("pred") > 0)
    return rows.select(*REGISTER, *ID, "action", F.col("value.i").alias("amount"), F.explode("pred").alias("p")).select(*REGISTER, *ID, "action", "amount", F.col("p.ctr").alias("p_ctr"), F.col("p.actor").alias("p_actor"))


def is_counter() -> Column:
    return (F.col("action") == "set") & (F.col("value.tag") == "counter")


def state(ops: DataFrame, successors: bool = False, sets: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    """All operations (or those `of` the log that are asked for) with n_succ, n_inc, visible and current (a counter's value with its increments); with `successors` also succ, ascending.

    Predecessor links are summed per overwritten operation before they meet it; both sides are dealt by
    register and id, so that a large document is spread over many tasks. Of a set, the operations that name it are summed before they meet its members.
    """
    inc = F.col("action") == "inc"
    sums = [F.count("*").alias("n_succ"), F.count_if(inc).alias("n_inc"), F.sum(F.when(inc, F.col("amount"))).alias("added")]
    if successors:
        sums.append(F.array_sort(F.collect_list(op_id())).alias("succ"))
    over = links(ops).groupBy(*REGISTER, "p_ctr", "p_actor").agg(*sums).withColumnsRenamed({"p_ctr": "ctr", "p_actor": "actor"})
    if sets is not None:
        named = keyed(ops).where("pred_set is not null").withColumn("amount", F.col("value.i")).groupBy(*REGISTER, "pred_set").agg(*sums)
        both = [F.sum(n).alias(n) for n in ("n_succ", "n_inc", "added")] + [F.array_sort(F.flatten(F.collect_list("succ"))).alias("succ")] * successors
        over = over.unionByName(sets.join(large(named), [*REGISTER, "pred_set"]).drop("pred_set")).groupBy(*REGISTER, *ID).agg(*both)
    out = keyed(ops if of is None else of).join(large(over), [*REGISTER, *ID], "left").fillna(0, ["n_succ", "n_inc", "added"])
    visible = F.when(F.col("action").isin("inc", "del"), False).when(is_counter(), F.col("n_succ") <= F.col("n_inc")).otherwise(F.col("n_succ") == 0)
    return out.withColumn("visible", visible).withColumn("current", F.when(is_counter(), F.col("value.i") + F.col("added")).otherwise(F.col("value.i")))


def visible(ops: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Operations that show. Increments and deletions never do: they are counted, and do not meet the counts."""
    return state(ops, sets=sets, of=ops.where(~F.col("action").isin("inc", "del"))).where("visible")


def dangling(ops: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Predecessors that no operation has: what deletions leave in a snapshot."""
    over = links(ops).select(*REGISTER, F.col("p_ctr").alias("ctr"), F.col("p_actor").alias("actor"))
    if sets is not None:
        named = keyed(ops).where("pred_set is not null").select(*REGISTER, "pred_set").distinct()
        over = over.unionByName(sets.join(large(named), [*REGISTER, "pred_set"], "left_semi").drop("pred_set"))
    return over.distinct().join(large(ops.select("doc_id", *ID)), ["doc_id", *ID], "left_anti")


def synthesised_deletes(snapshot: DataFrame) -> DataFrame:
    """Deletions that a snapshot implies: successor ids without a row of their own, with the operations they overwrite as pred."""
    rows = snapshot.select(*REGISTER, *ID, F.explode("succ").alias("s")).select(*REGISTER, op_id().alias("target"), F.col("s.ctr").alias("ctr"), F.col("s.actor").alias("actor"))
    return rows.join(large(snapshot.select("doc_id", *ID)), ["doc_id", *ID], "left_anti").groupBy(*REGISTER, *ID).agg(F.array_sort(F.collect_list("target")).alias("pred"))
