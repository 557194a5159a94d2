"""Change streams: idempotent delivery, a buffer for changes that come before their dependencies, refresh of touched documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("pos", T.LongType())])
#: Hashes applied so far, and waiting ones with their missing dependencies.
STATE = T.StructType([T.StructField("known", T.ArrayType(T.StringType())), T.StructField("waiting", T.ArrayType(T.StringType())), T.StructField("deps", T.ArrayType(T.ArrayType(T.StringType())))])


def release(known: dict, waiting: dict[str, list], new: list[tuple[str, list]]) -> list[str]:
    """Adds changes (hash, deps) and returns, in causal order, the hashes that can be applied now. Repeats are passed over.

    Each change is looked at again only when a dependency it waits for has come, so the work is linear in its dependencies.
    """
    for h, deps in new:
        if h not in known and h not in waiting:
            waiting[h] = list(deps)
    left, after = {}, {}
    for h, deps in waiting.items():
        short = [d for d in set(deps) if d not in known]
        left[h] = len(short)
        for d in short:
            after.setdefault(d, []).append(h)
    stack, out = sorted((h for h, n in left.items() if n == 0), reverse=True), []
    while stack:
        h = stack.pop()
        del waiting[h]
        known[h] = True
        out.append(h)
        for k in after.get(h, ()):
            left[k] -= 1
            if left[k] == 0:
                stack.append(k)
    return out


def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known, waiting, deps = state.get if state.exists else ([], [], [])
    known, waiting = dict.fromkeys(known, True), dict(zip(waiting, map(list, deps), strict=True))
    n = len(known)
    new = [(h, list(d)) for f in frames for h, d in zip(f["hash"], f["deps"], strict=True)]
    out = release(known, waiting, new)
    state.update((list(known), list(waiting), list(waiting.values())))
    yield pd.DataFrame({"doc_id": [key[0]] * len(out), "hash": out, "pos": range(n, n + len(out))})


def causal(changes: DataFrame) -> DataFrame:
    """Changes (doc_id, hash, deps) of a stream as they become applicable, once each, with their place in the document's history.

    A change that comes too early waits, without a time limit, until the last of its dependencies has come;
    nothing is dropped as late. State is kept per document.
    """
    return changes.select("doc_id", "hash", "deps").groupBy("doc_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def once(changes: DataFrame) -> DataFrame:
    """Idempotent delivery: a change counts once, whatever the number of times it comes."""
    return changes.dropDuplicates(["doc_id", "hash"])


def touched(refresh: Callable[[DataFrame, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: calls `refresh` with a batch, the ids of the documents it touches, and the batch's number."""

    def sink(batch: DataFrame, number: int) -> None:
        refresh(batch, batch.select("doc_id").distinct(), number)

    return sink


def activity(changes: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Changes and operations per document and window of their time (seconds since 1970), with a watermark."""
    timed = changes.withColumn("at", F.timestamp_seconds("time")).withWatermark("at", late)
    return timed.groupBy("doc_id", F.window("at", every)).agg(F.count("*").alias("n_changes"), F.sum("num_ops").alias("n_ops"))
