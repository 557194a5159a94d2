"""Histories and logs whose rows name sets of dependencies and predecessors, against the same with lists in each row."""

import datetime
import os
import random

from pyspark.sql import functions as F

from weftlog.operators import history, register, state
from weftlog.plans.logs import map_log
from weftlog.session import shared_folder

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def stored(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder.removeprefix("file:")) for f in fs)


def test_log_grows_with_its_events(spark, tmp_path):
    """Writers of one document that meet each day: each row's dependencies and predecessors as lists would be 1,200 long."""
    day = datetime.datetime(2024, 1, 1)
    events = [(d * 1200 + u, day + datetime.timedelta(days=d), 3 * u, "view", 1.0, '{"k": 1}') for d in range(3) for u in range(1200)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    before = stored(shared_folder(spark))
    log = map_log(spark, str(tmp_path))
    assert history.heads(log.history, log.dep_sets).count() == 1200
    assert stored(shared_folder(spark)) - before < 3_000_000
    assert register.conflict_counts(log.ops, log.pred_sets).where("key_str = 'r1'").collect()[0].n_values == 1200
    actors = history.actors_of(log.ops.where("layer = 2"), log.pred_sets)
    assert actors.count() == actors.where(F.size("actors") == 1200).count() == 1200


def graph(rng, n):
    """A history with many shared and some missing dependencies."""
    out = []
    for i in range(n):
        deps = rng.choice([[f"h{j}" for j in range(max(0, i // 8 * 8 - 8), i // 8 * 8)], [f"h{j}" for j in rng.sample(range(i), min(i, 2))], [f"gone{i % 3}"] if i % 11 == 5 else []])
        out.append((i % 2, f"h{i}", [d for d in deps if d.startswith("gone") or int(d[1:]) % 2 == i % 2]))
    return out


def reach(known, start, down):
    found = set(start)
    while True:
        more = {(d, x) for d, h in found for x in known[d, h]} if not down else {(d, h) for (d, h), deps in known.items() if any((d, x) in found for x in deps)}
        more = {k for k in more if k in known} - found
        if not more:
            return found
        found |= more


def test_closure_with_lists_and_sets(spark):
    made = graph(random.Random(3), 90)
    known = {(d, h): deps for d, h, deps in made}
    changes = spark.createDataFrame(made, "doc_id long, hash string, deps array<string>")
    some = [(d, h) for d, h, _ in made if h in ("h40", "h41", "h44")]
    start = spark.createDataFrame([*some, (0, "unknown"), some[0]], "doc_id long, hash string")
    c, sets = history.factored(changes, None)
    short = {k for k, deps in known.items() if any((k[0], x) not in known for x in deps)}
    for s in (None, sets):
        use = changes if s is None else c.drop("deps")
        for down in (False, True):
            assert sorted(map(tuple, history.closure(use, start, down, s).collect())) == sorted(reach(known, some, down))
        assert {tuple(r) for r in history.heads(use, s).select("doc_id", "hash").collect()} == set(known) - {(d, x) for (d, _), deps in known.items() for x in deps}
        assert {tuple(r) for r in history.unready(use, s).collect()} == reach(known, short, True)
        assert {r.hash for r in history.missing_deps(use, sets=s).collect()} <= {"gone0", "gone1", "gone2"}


def test_sets_of_predecessors_are_lists(spark):
    log = map_log(spark, SMALL)
    pred = log.pred_sets.groupBy(*state.REGISTER, "pred_set").agg(F.collect_list(state.op_id()).alias("more"))
    listed = log.ops.join(pred, [*state.REGISTER, "pred_set"], "left").withColumn("pred", F.when(F.col("more").isNull(), F.col("pred")).otherwise(F.concat("pred", "more"))).drop("more", "pred_set")
    assert rows(history.actors_of(listed)) == rows(history.actors_of(log.ops, log.pred_sets))
    odd = "layer % 3 <> 1"
    assert rows(state.dangling(listed.where(odd))) == rows(state.dangling(log.ops.where(odd), log.pred_sets))
    want, got = (state.state(o, successors=True, sets=s).select("doc_id", "ctr", "actor", "n_succ", "n_inc", "added", "visible", "current", "succ") for o, s in ((listed, None), (log.ops, log.pred_sets)))
    assert rows(want) == rows(got)
