import random

from pyspark.sql import functions as F

from weftlog.plans.logs import map_log
from weftlog.streaming import causal

SMALL = "/root/testdata/sf0.001"


def test_release_in_causal_order():
    rng = random.Random(2)
    for _ in range(50):
        deps = {f"h{i}": [f"h{j}" for j in range(i) if rng.random() < 0.3] for i in range(20)}
        order = [*deps, *rng.sample(list(deps), 5)]
        rng.shuffle(order)
        known, waiting, out = {}, {}, []
        for lo in range(0, len(order), 4):
            out += causal.release(known, waiting, [(h, deps[h]) for h in order[lo : lo + 4]])
        assert sorted(out) == sorted(deps) and not waiting
        assert all(out.index(d) < out.index(h) for h in deps for d in deps[h])


def test_stream_equals_batch(spark, tmp_path):
    changes = map_log(spark, SMALL).changes.select("doc_id", "hash", "deps", "layer")
    # the files come with the last layers first, and one of them twice
    cut = [changes.where("layer >= 15"), changes.where("layer < 7"), changes.where("layer between 7 and 14"), changes.where("layer < 3")]
    for i, part in enumerate(cut):
        part.drop("layer").coalesce(1).write.parquet(f"{tmp_path}/in/batch={i}")
    stream = spark.readStream.schema("doc_id long, hash string, deps array<string>, batch int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    q = causal.causal(stream).writeStream.option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(causal.touched(lambda b, ids, n: seen.append((b.collect(), ids.count())))).start()
    q.processAllAvailable()
    q.stop()
    rows = [r for b, _ in seen for r in b]
    want = changes.select("doc_id", "hash").collect()
    assert sorted((r.doc_id, r.hash) for r in rows) == sorted(map(tuple, want))
    place = {(r.doc_id, r.hash): r.pos for r in rows}
    for r in changes.collect():
        assert all(place[r.doc_id, d] < place[r.doc_id, r.hash] for d in r.deps)


def test_idempotent_stream_and_windows(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("h"), F.col("id") % 10).alias("hash"), (F.col("id") % 10 * 600).alias("time"), F.lit(2).alias("num_ops"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = causal.once(stream).writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == rows.select("doc_id", "hash").distinct().count()
    assert causal.activity(rows).agg(F.sum("n_changes")).first()[0] == 20
