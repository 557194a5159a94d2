"""Changes and their graph: heads, ancestors, clocks, what another replica lacks, states of the past.

`changes` has doc_id, hash, actor, seq, start_op, num_ops, max_op, deps.

Where many changes depend on the same ones, dep_set may stand for deps: it names a set (null: none) of the table `sets` with doc_id, dep_set, dep, one row a member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlog.operators.sequence import by_group
from weftlog.operators.state import REGISTER, keyed, op_id, state
from weftlog.session import large


def factored(changes: DataFrame, sets: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Changes with dep_set, and the sets: lists of dependencies that are equal become one set."""
    if sets is not None:
        return changes, sets
    own = F.array_sort(F.array_distinct("deps"))
    c = changes.withColumn("dep_set", F.when(F.size("deps") > 0, F.sha2(F.array_join(own, " "), 256)))
    lists = c.where("dep_set is not null").groupBy("doc_id", "dep_set").agg(F.first("deps").alias("deps"))
    return c, lists.select("doc_id", "dep_set", F.explode("deps").alias("dep")).distinct()


def expanded(changes: DataFrame, sets: DataFrame) -> DataFrame:
    """Changes with their dependencies as lists, in order."""
    lists = sets.groupBy("doc_id", "dep_set").agg(F.array_sort(F.collect_list("dep")).alias("deps"))
    return changes.join(large(lists), ["doc_id", "dep_set"], "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>"))).drop("dep_set")


def depended(changes: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(doc_id, hash) that some change depends on, once each."""
    if sets is None:
        return changes.select("doc_id", F.explode("deps").alias("hash")).distinct()
    named = changes.where("dep_set is not null").select("doc_id", "dep_set").distinct()
    return sets.join(large(named), ["doc_id", "dep_set"], "left_semi").select("doc_id", F.col("dep").alias("hash")).distinct()


def heads(changes: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Changes on which no other depends."""
    return changes.join(large(depended(changes, sets)), ["doc_id", "hash"], "left_anti")


def closure(changes: DataFrame, start: DataFrame, down: bool = False, sets: DataFrame | None = None) -> DataFrame:
    """Changes reachable from `start` (doc_id, hash), itself included: ancestors, or with `down` dependents.

    History graphs have many paths to a change, so a recursive union would grow without bound; each
    document's graph is walked once instead. Its nodes are sets of dependencies, not changes: one set leads to another if a change of
    the first depends on the second. Changes that depend on the same ones are one step of the walk, however many they are.
    """
    c, s = factored(changes, sets)
    c = c.select("doc_id", "hash", "dep_set")
    begin = c.select("doc_id", "hash").join(large(start.select("doc_id", "hash").distinct()), ["doc_id", "hash"], "left_semi").distinct()
    steps = s.select("doc_id", F.col("dep_set").alias("above"), F.col("dep").alias("hash")).join(large(c.where("dep_set is not null")), ["doc_id", "hash"]).select("doc_id", "above", F.col("dep_set").alias("below")).distinct()
    if down:
        first = s.join(large(begin.withColumnRenamed("hash", "dep")), ["doc_id", "dep"], "left_semi").select("doc_id", "dep_set")
        steps = steps.select("doc_id", F.col("below").alias("a"), F.col("above").alias("b"))
    else:
        first = c.where("dep_set is not null").join(large(begin), ["doc_id", "hash"], "left_semi").select("doc_id", "dep_set")
        steps = steps.select("doc_id", F.col("above").alias("a"), F.col("below").alias("b"))
    graph = steps.union(first.distinct().select("doc_id", F.lit(None).cast(c.schema["dep_set"].dataType).alias("a"), F.col("dep_set").alias("b")))

    def one(rows: dict[str, list]) -> list[tuple]:
        to: dict = {}
        for a, b in zip(rows["a"], rows["b"], strict=True):
            to.setdefault(a, []).append(b)
        seen = set(to.get(None, ()))
        stack = list(seen)
        while stack:
            for x in to.get(stack.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        doc = rows["doc_id"][0]
        return [(doc, x) for x in seen]

    schema = T.StructType([T.StructField("doc_id", c.schema["doc_id"].dataType), T.StructField("dep_set", c.schema["dep_set"].dataType)])
    reached = by_group(graph, ["doc_id"], schema, one)
    if down:
        return c.join(large(reached), ["doc_id", "dep_set"], "left_semi").select("doc_id", "hash").union(begin).distinct()
    members = s.join(large(reached), ["doc_id", "dep_set"], "left_semi").select("doc_id", F.col("dep").alias("hash"))
    return members.join(large(c.select("doc_id", "hash")), ["doc_id", "hash"], "left_semi").union(begin).distinct()


def ancestors(changes: DataFrame, start: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    return closure(changes, start, sets=sets)


def dependents(changes: DataFrame, start: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Changes that build on one of `start`, those left out."""
    return closure(changes, start, True, sets).join(large(start.select("doc_id", "hash")), ["doc_id", "hash"], "left_anti")


def not_ancestors(changes: DataFrame, hashes: DataFrame, at: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Of `hashes` (doc_id, hash), those that the history up to `at` does not hold."""
    return hashes.join(large(closure(changes, at, sets=sets)), ["doc_id", "hash"], "left_anti")


def actors_of(ops: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(doc_id, hash, actors): the actors that the operations of a change name, its author among them, in order."""
    named = F.explode(F.array(F.struct(F.col("ctr"), F.col("actor")), F.struct(F.col("obj_ctr").alias("ctr"), F.col("obj_actor").alias("actor")), F.struct(F.col("key_ctr").alias("ctr"), F.col("key_actor").alias("actor"))))
    own = ops.select("doc_id", F.col("change_hash").alias("hash"), named.alias("x")).where("x.ctr > 0").select("doc_id", "hash", "x.actor")
    past = ops.select("doc_id", F.col("change_hash").alias("hash"), F.explode("pred").alias("x")).select("doc_id", "hash", "x.actor")
    named = own.union(past).distinct().groupBy("doc_id", "hash").agg(F.array_sort(F.collect_list("actor")).alias("actors"))
    if sets is None:
        return named
    # a change's actors are its own and those of a few sets. Changes with the same sets share one list, which they meet as they are
    # given out: the lists that differ go through the shuffle once, and not once a change
    refs = keyed(ops).where("pred_set is not null").select("doc_id", F.col("change_hash").alias("hash"), F.struct(*REGISTER[1:], "pred_set").alias("r")).distinct()
    refs = refs.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_list("r")).alias("refs"))
    of_set = sets.groupBy("doc_id", F.struct(*REGISTER[1:], "pred_set").alias("r")).agg(F.collect_set("actor").alias("a"))
    lists = refs.select("doc_id", "refs").distinct().withColumn("r", F.explode("refs")).join(large(of_set), ["doc_id", "r"]).groupBy("doc_id", "refs").agg(F.array_distinct(F.flatten(F.collect_list("a"))).alias("a"))
    both = named.join(large(refs), ["doc_id", "hash"], "left").join(large(lists), ["doc_id", "refs"], "left")
    return both.select("doc_id", "hash", F.when(F.col("a").isNull(), F.col("actors")).otherwise(F.array_sort(F.array_union("a", "actors"))).alias("actors"))


def same_documents(a: DataFrame, b: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(doc_id, equal): whether two replicas have the same heads, and with them the same history and state."""
    ha, hb = (heads(x, sets).groupBy("doc_id").agg(F.array_sort(F.collect_set("hash")).alias(n)) for x, n in ((a, "ha"), (b, "hb")))
    return ha.join(hb, "doc_id", "full").select("doc_id", F.col("ha").eqNullSafe(F.col("hb")).alias("equal"))


def clock(changes: DataFrame) -> DataFrame:
    """The vector clock of a set of changes: per actor the last operation and sequence number."""
    return changes.groupBy("doc_id", "actor").agg(F.max("max_op").alias("max_op"), F.max("seq").alias("seq"))


def clock_at(changes: DataFrame, at: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    return clock(changes.join(large(closure(changes, at, sets=sets)), ["doc_id", "hash"], "left_semi"))


def compare_clocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per document: equal, greater, less or concurrent; an actor that is missing counts as 0."""
    both = a.select("doc_id", "actor", F.col("max_op").alias("x")).join(b.select("doc_id", "actor", F.col("max_op").alias("y")), ["doc_id", "actor"], "full").fillna(0, ["x", "y"])
    sums = both.groupBy("doc_id").agg(F.bool_and(F.col("x") >= F.col("y")).alias("ge"), F.bool_and(F.col("x") <= F.col("y")).alias("le"))
    order = F.when(F.col("ge") & F.col("le"), "equal").when(F.col("ge"), "greater").when(F.col("le"), "less").otherwise("concurrent")
    return sums.select("doc_id", order.alias("order"))


def changes_since(changes: DataFrame, at: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Changes that are no ancestors of `at`: an actor's changes are a chain, so sequence numbers beyond its clock tell them."""
    known = clock_at(changes, at, sets).select("doc_id", "actor", F.col("seq").alias("known"))
    return changes.join(large(known), ["doc_id", "actor"], "left").where(F.col("seq") > F.coalesce("known", F.lit(0))).drop("known")


def changes_added(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Changes of the other replica that this one lacks."""
    return other.join(large(mine), ["doc_id", "hash"], "left_anti")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two sets of changes or operations with their hashes: commutative, associative, idempotent."""
    key = ["doc_id", "hash"] if "hash" in a.columns else ["doc_id", "ctr", "actor"]
    return a.unionByName(b).dropDuplicates(key)


def missing_deps(known: DataFrame, wanted: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """Hashes that known changes depend on (or `wanted` names) and nobody has."""
    need = depended(known, sets)
    need = need if wanted is None else need.union(wanted.select("doc_id", "hash"))
    return need.distinct().join(large(known), ["doc_id", "hash"], "left_anti")


def unready(changes: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Changes that wait: a dependency is missing, or waits itself. All that is not ready is a dependent of a change with a missing one."""
    c, s = factored(changes, sets)
    short = s.join(large(c.select("doc_id", F.col("hash").alias("dep"))), ["doc_id", "dep"], "left_anti").select("doc_id", "dep_set").distinct()
    return closure(c, c.join(large(short), ["doc_id", "dep_set"], "left_semi").select("doc_id", "hash"), True, s)


def ready(changes: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    return changes.join(large(unready(changes, sets)), ["doc_id", "hash"], "left_anti")


def op_to_change(ops: DataFrame, changes: DataFrame) -> DataFrame:
    """The change of each operation: of its actor's, the one whose range of numbers holds it. Ranges are disjoint, so it is one at most:
    the last that began, found in one pass over the actor's operations and changes together."""
    c = changes.select("doc_id", "actor", F.col("start_op").alias("ctr"), F.struct("hash", "max_op").alias("c"))
    both = c.unionByName(ops.select("doc_id", "actor", "ctr", F.lit(None).cast(c.schema["c"].dataType).alias("c")))
    w = Window.partitionBy("doc_id", "actor").orderBy("ctr", F.col("c").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("own", F.last("c", ignorenulls=True).over(w)).where("c is null and ctr <= own.max_op")
    return last.select("doc_id", "ctr", "actor", "own.hash")


def covered(ops: DataFrame, clocks: DataFrame) -> DataFrame:
    """Operations that a clock covers."""
    c = clocks.select("doc_id", "actor", F.col("max_op").alias("_known"))
    return ops.join(large(c), ["doc_id", "actor"]).where("ctr <= _known").drop("_known")


def ops_at(ops: DataFrame, changes: DataFrame, at: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """The log as it was at some heads: every read of the past is a read of these."""
    return covered(ops, clock_at(changes, at, sets))


def state_at(ops: DataFrame, changes: DataFrame, at: DataFrame, sets: DataFrame | None = None, pred_sets: DataFrame | None = None) -> DataFrame:
    return state(ops_at(ops, changes, at, sets), sets=pred_sets)


def lamport_order(ops: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ctr", "actor")
    return ops.select("doc_id", "ctr", "actor", F.row_number().over(w).cast("long").alias("pos"))


def causal_order(changes: DataFrame) -> DataFrame:
    """A topological order: a change starts after all it depends on."""
    w = Window.partitionBy("doc_id").orderBy("start_op", "actor", "seq")
    return changes.withColumn("pos", F.row_number().over(w).cast("long"))


def change_by_hash(changes: DataFrame, hash_: str) -> DataFrame:
    return changes.where(F.col("hash") == hash_)


def hash_of(changes: DataFrame, actor, seq: int) -> DataFrame:
    return changes.where((F.col("actor") == F.lit(actor)) & (F.col("seq") == seq)).select("doc_id", "hash")


def last_of_actor(changes: DataFrame) -> DataFrame:
    """Each actor's last change."""
    return changes.groupBy("doc_id", "actor").agg(F.max_by("hash", "seq").alias("hash"), F.max("seq").alias("seq"))


def duplicate_seq(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming changes whose sequence number their actor has already used under another hash."""
    new = incoming.join(large(known), ["doc_id", "hash"], "left_anti")
    used = known.groupBy("doc_id", "actor").agg(F.max("seq").alias("used"))
    return new.join(large(used), ["doc_id", "actor"]).where("seq <= used").drop("used")


def max_op(changes: DataFrame) -> DataFrame:
    return changes.groupBy("doc_id").agg(F.max("max_op").alias("max_op"))


def next_change(changes: DataFrame, actor, sets: DataFrame | None = None) -> DataFrame:
    """What a new change of `actor` would begin with: seq, start_op, deps (heads and its own last change)."""
    own = changes.where(F.col("actor") == F.lit(actor)).groupBy("doc_id").agg(F.max("seq").alias("last"), F.max_by("hash", "seq").alias("own"))
    h = heads(changes, sets).groupBy("doc_id").agg(F.array_sort(F.collect_list("hash")).alias("heads"))
    out = max_op(changes).join(large(h), "doc_id").join(large(own), "doc_id", "left")
    return out.select("doc_id", (F.coalesce("last", F.lit(0)) + 1).alias("seq"), (F.col("max_op") + 1).alias("start_op"), F.array_sort(F.array_distinct(F.concat("heads", F.array_compact(F.array("own"))))).alias("deps"))


def patches(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of two states (keys..., current, n_values) as put, delete and conflict rows."""
    a, b = before.select(*keys, F.col("current").alias("old"), F.col("id").alias("old_id")), after.select(*keys, F.col("current").alias("new"), F.col("id").alias("new_id"), "n_values")
    both = a.join(b, keys, "full")
    kind = F.when(F.col("new_id").isNull(), "delete").when(F.col("old_id").isNull() | (F.col("old_id") != F.col("new_id")), "put").when(F.col("old") != F.col("new"), "increment")
    return both.withColumn("kind", kind).where("kind is not null").select(*keys, "kind", F.col("new").alias("value"), (F.coalesce("n_values", F.lit(0)) > 1).alias("conflict"))


def id_column(df: DataFrame) -> DataFrame:
    return df.withColumn("id", op_id())
