"""Near-duplicate detection by bottom-k sketches of one hash function."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlog.llm.common import components, map_texts, mark_ids, pieces, without_ids
from weftlog.llm.vector_text import LOWER, Words, mix, windows
from weftlog.session import release, settle

SHINGLE = 5
#: Values that a sketch retains: the smallest hashes of a document's shingles.
KEEP = 32
#: A pair goes on if its sketches share at least this part of the smaller count that the similarity makes likely.
LEAST_SHARED = 0.5
#: Bands of the first round: retained values by remainder, so many of the smallest of each.
BANDS, BAND_ROWS = 8, 3
#: Inverted lists of at most so many documents are joined as they are; longer ones go by prefixes of the full sets.
LIST = 64
#: Columns of a set's signature, 64 bits each.
SIGNATURE = [f"g{i}" for i in range(8)]
#: Documents to a file of the tables that are settled on the way.
PART = 20_000
PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
#: Counters of the table by which shingles of documents in long lists are ordered: what each task sends, and what is broadcast, at 4 bytes each.
COUNTERS = 1 << 20
#: Pairs of one document that one stretch of the verification takes, and pairs in an Arrow batch.
STRETCH = 256


def sketches(docs: DataFrame, keep: list[str], text: str = "text", size: int = KEEP) -> DataFrame:
    """`keep` columns, n_shingles, key (digest of the word sequence; null without words), sketch (the `size` smallest hashes, ascending)."""

    def make(texts: list) -> list:
        w = Words(texts, LOWER)
        h = w.hashes()
        data = w.buf.tobytes()
        sizes, keys, sketch = [], [], []
        every = windows(h, SHINGLE)
        for i in range(len(texts)):
            a, b = w.bounds[i], w.bounds[i + 1]
            if a == b:
                sizes.append(0), keys.append(None), sketch.append([])
                continue
            sh = shingles(h, every, a, b)
            sizes.append(len(sh))
            keys.append(hashlib.blake2b(b" ".join(data[w.first[i] : w.first[i + 1]].split()), digest_size=16).digest())
            sketch.append(sh[:size].view(np.int64))
        return [sizes, keys, sketch]

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))]
    return map_texts(docs, keep, text, fields, make)


def shingle_set(words: list) -> set:
    """The exact set of a document: distinct shingles, or the whole sequence if it is shorter."""
    if not words:
        return set()
    if len(words) < SHINGLE:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def fetch(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), one row for each of `nodes` (node, doc_id, look; distinct and settled), settled. Other texts stay where they are."""
    n = nodes.select("node", F.col("doc_id").alias("_id"), F.col("look").alias("_look"))
    some = mark_ids(docs, "look", n, "_look", "_maybe").where("_maybe")
    # by a merge, after which the few rows that meet stand in few partitions
    found = settle(some.join(n.hint("merge"), (F.col("look") == F.col("_look")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text"))
    # rows that repeat both id and text come several times
    return settle(found.dropDuplicates(["node"])) if found.count() > n.count() else found


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, parts: int, texts: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of nodes whose full shingle sets have 100 * intersection >= percent * union, settled.

    Pairs are dealt by their first document, STRETCH of them at a time: a stretch begins with that document's text, sent once,
    and each of its rows holds one more. So a document with very many pairs is spread over tasks, and a task holds two texts' sets.
    """
    pairs = settle(pairs.distinct(), parts=parts)
    if texts is None:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = fetch(docs, settle(nodes.select("node", "doc_id", "look").join(ids, "node", "left_semi"), parts=parts))
    t = texts.select(F.col("node").alias("_node"), "text")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / STRETCH).cast("int").alias("_many"))
    dealt = pairs.join(many, "a").withColumn("_own", F.pmod(F.xxhash64("b", F.lit(3)), F.col("_many")).cast("int"))
    heads = many.join(t, many["a"] == t["_node"]).select("a", F.explode(F.sequence(F.lit(0), F.col("_many") - 1)).alias("_own"), F.lit(None).cast("long").alias("b"), "text")
    rows = dealt.join(t, dealt["b"] == t["_node"]).select("a", "_own", "b", "text")
    rows = heads.union(rows).repartition("a", "_own").sortWithinPartitions("a", "_own", F.col("b").asc_nulls_first())

    def run(batches):
        import pyarrow as pa

        known = np.zeros(0, np.uint64)
        for batch in batches:
            a, b, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.large_binary())
            left, right = [], []
            for i in range(len(a)):
                (own,) = sets_of([texts[i].as_py()])
                if b[i] is None:
                    known = own
                    continue
                n = len(np.intersect1d(known, own, assume_unique=True))
                if n and 100 * n >= percent * (len(known) + len(own) - n):
                    left.append(a[i]), right.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return settle(rows.mapInArrow(run, PAIRS).distinct(), parts=parts)


def of_band(i: int):
    """A second parameter of the function itself would be the value's place."""
    return lambda v: F.pmod(v, F.lit(BANDS)) == i


def band_pairs(nodes: DataFrame) -> DataFrame:
    """First round: a star of pairs around the smallest document of each band."""
    values = [F.slice(F.filter("sketch", of_band(i)), 1, BAND_ROWS) for i in range(BANDS)]
    keys = F.array(*[F.when(F.size(v) > 0, F.xxhash64(v, F.lit(i))) for i, v in enumerate(values)])
    rows = nodes.select("node", F.explode(F.array_compact(keys)).alias("band"))
    first = rows.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, "band").where("a < node").select("a", F.col("node").alias("b"))


def inverted_lists(nodes: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Rows (node, component, n, sketch, head, v) of inverted lists of retained values, and the lists (v, len) worth reading.

    Sketches of a pair that is similar enough share LEAST_SHARED of their values (a chance of about 5e-7 a pair at the
    threshold not to). So, with values in the order of their frequency, one of the first
    (1 - LEAST_SHARED) * size + 1 of each, its head, is common: only those are listed, the rare ones first, and passages
    that very many documents share list nothing. A list whose members are all of one component links nothing new and is dropped.
    """
    values = nodes.select("node", F.explode("sketch").alias("v"))
    often = settle(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), parts=parts)
    # values of one document alone come first in the order and link nothing: their number is the sketch's size less the others
    shared = values.join(often, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s"))
    shared = shared.join(nodes, "node").withColumn("_room", F.size("sketch") - F.floor(F.size("sketch") * LEAST_SHARED) + 1 - (F.size("sketch") - F.size("s")))
    shared = shared.where("_room > 0").withColumn("head", F.slice(F.col("s.v"), F.lit(1), F.greatest(F.lit(0), F.least(F.col("_room").cast("int"), F.size("s")))))
    shared = settle(shared.select("node", "component", "n", "sketch", "head", F.explode("head").alias("v")), parts=parts)
    lists = shared.groupBy("v").agg(F.count("*").alias("len"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2")
    return shared, settle(lists.select("v", "len"), parts=parts)


def list_pairs(shared: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Second round: pairs across components from lists of at most LIST members, so that a row meets fewer than LIST others.

    A pair is taken in the first list that both are in. The union of the two sketches estimates the
    similarity: a pair goes on if the estimate is within reach of the threshold.
    """
    rows = shared.join(lists.where(F.col("len") <= LIST).select("v"), "v")
    left, right = (rows.select("v", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n", "sketch", "head")]) for x in "ab")
    near = (F.col("component_a") != F.col("component_b")) & (F.col("node_a") < F.col("node_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    first = F.element_at(F.array_intersect("head_a", "head_b"), 1) == F.col("v")
    return left.join(right, "v").where(near & first & estimate(percent)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def prefix_rows(texts: DataFrame, percent: int) -> DataFrame:
    """(s, node, n, pos, SIGNATURE): of each document's full set, the rarest shingles that a similar one must share one of, with their places.

    Shingles are ordered by how often all these documents have them, the rare ones first: any order serves, this one keeps
    what many share out of the prefixes. The frequencies are those of COUNTERS counters that shingles are hashed to:
    every task sends one table of them, and they are summed by stretches. A shingle that no other can have, as its counter
    says, makes no row. The signature has a bit for each of as many parts of the set: whether that part's size is odd. Where the bits of
    two sets differ, so do the sets.
    """

    def count(batches):
        import pyarrow as pa

        table = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            column = batch.column(1)
            for lo, hi in pieces(column):
                for own in sets_of(column.slice(lo, hi - lo).cast(pa.large_binary()).to_pylist()):
                    np.add.at(table, counter(own), 1)
        for k in range(0, COUNTERS, 4096):
            if table[k : k + 4096].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([table[k : k + 4096].astype(np.int32).tobytes()], pa.binary())], names=["k", "part"])

    def add(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(part.as_buffer(), np.int32).astype(np.int64)
        parts = [np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array(parts, pa.binary())], names=["k", "part"])

    parts = T.StructType([T.StructField("k", T.LongType()), T.StructField("part", T.BinaryType())])
    often = np.zeros(COUNTERS, np.int32)
    for r in texts.select("node", "text").mapInArrow(count, parts).repartition("k").mapInArrow(add, parts).collect():
        often[r["k"] : r["k"] + 4096] = np.frombuffer(r["part"], np.int32)
    box = texts.sparkSession.sparkContext.broadcast(often)

    def make(batch_texts: list) -> list:
        out: list[list] = [[], [], [], []]
        for own in sets_of(batch_texts):
            n = len(own)
            most = n - -(-percent * n // 100) + 1  # of a partner that is smaller by as much as may be
            times = box.value[counter(own)]
            if most < n:
                some = np.argpartition(times, most)
                some = np.flatnonzero(times <= times[some[:most]].max())
            else:
                some = np.arange(n)
            # by frequency, then by hash: the same order for all documents
            some = some[np.lexsort((own[some], times[some]))][:most]
            at = np.flatnonzero(times[some] > 1)
            odd = np.bincount((own >> np.uint64(7)).astype(np.int64) & (64 * len(SIGNATURE) - 1), minlength=64 * len(SIGNATURE)) & 1
            for column, x in zip(out, (n, own[some[at]].view(np.int64), at.astype(np.int32), np.packbits(odd.astype(np.uint8)).view(np.int64)), strict=True):
                column.append(x)
        return out

    long = T.ArrayType(T.LongType())
    rows = map_texts(texts, ["node"], "text", [T.StructField("n", T.LongType()), T.StructField("prefix", long), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("signature", long)], make)
    one = F.explode(F.arrays_zip(F.col("prefix").alias("s"), F.col("places").alias("pos"))).alias("p")
    return rows.select("node", "n", one, *[F.col("signature")[i].alias(g) for i, g in enumerate(SIGNATURE)]).select("p.s", "node", "n", "p.pos", *SIGNATURE)


def counter(own: np.ndarray) -> np.ndarray:
    return (mix(own ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def alike(x: str, y: str, percent: int):
    """Whether two sets of sizes n can be similar enough by their lengths and signatures: at most (100 - percent) / (100 + percent) of both may differ."""
    n_x, n_y = F.col(f"{x}n"), F.col(f"{y}n")
    differ = sum((F.bit_count(F.col(f"{x}{g}").bitwiseXOR(F.col(f"{y}{g}"))) for g in SIGNATURE), F.lit(0))
    return (100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y)) & (differ * (100 + percent) <= (100 - percent) * (n_x + n_y))


def star_pairs(rows: DataFrame, known: DataFrame, percent: int, pick) -> DataFrame:
    """Pairs of each prefix shingle's first document (as `pick` says) with the others of other components: no more than rows."""
    named = rows.join(known, "node")
    center = F.struct("node", "component", "n", *SIGNATURE)
    first = named.groupBy("s").agg(pick(center).alias("f"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("s", "f")
    near = named.join(first, "s").where((F.col("component") != F.col("f.component")) & alike("", "f.", percent))
    return near.select(F.least("f.node", "node").alias("a"), F.greatest("f.node", "node").alias("b"))


def prefix_pairs(rows: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """All pairs across components that can still be similar: prefix, length, positional and signature filters of an exact set-similarity join.

    The smaller of two similar sets x and y has a common shingle among the first |x| - need + 1 of its order, where
    need = percent / (100 + percent) * (|x| + |y|) is the least intersection, and after that shingle as many must follow in both.
    Documents whose common part is frequent have it behind their own shingles, beyond the prefix, and meet nobody; of those that
    meet, the signatures leave few but similar ones.
    """
    named = rows.join(known, "node")
    mixed = named.groupBy("s").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("s")
    named = named.join(mixed, "s")
    x, y = (named.select("s", F.struct("node", "component", "n", "pos", *SIGNATURE).alias(k)) for k in "xy")
    x = x.where((100 + percent) * (F.col("x.n") - F.col("x.pos")) >= 2 * percent * F.col("x.n"))
    need = percent * (F.col("x.n") + F.col("y.n"))
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    reach = ((100 + percent) * (F.col("x.n") - F.col("x.pos")) >= need) & ((100 + percent) * (F.col("y.n") - F.col("y.pos")) >= need)
    near = x.join(y, "s").where((F.col("x.component") != F.col("y.component")) & order & reach & alike("x.", "y.", percent))
    return near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def named_nodes(nodes: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """(node, component) of all nodes, settled."""
    known = components(links, "a", "b", parts).withColumnRenamed("node", "_node")
    return settle(nodes.join(known, nodes["node"] == known["_node"], "left").select("node", F.coalesce("component", "node").alias("component")), parts=parts)


def sets_of(texts: list) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    w = Words(texts, LOWER)
    h = w.hashes()
    every = windows(h, SHINGLE)
    return [shingles(h, every, w.bounds[i], w.bounds[i + 1]) for i in range(len(texts))]


def shingles(h: np.ndarray, every: np.ndarray, a: int, b: int) -> np.ndarray:
    """Distinct shingle hashes, ascending, of the words a to b."""
    if a == b:
        return np.zeros(0, np.uint64)
    if b - a < SHINGLE:
        return mix(np.array([np.bitwise_xor.reduce(mix(h[a:b] + np.arange(b - a, dtype=np.uint64)))]))
    return np.unique(every[a : b - SHINGLE + 1])


def estimate(percent: int):
    """Whether the union sketch leaves the similarity within reach: the common part of the smallest values of both."""
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, KEEP)
    common = F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union)
    least = F.when((F.col("n_a") <= KEEP) & (F.col("n_b") <= KEEP), percent / 100 - 1e-9).otherwise(F.lit(LEAST_SHARED))
    return F.size(common) >= least * F.size(union)


def group(docs: DataFrame, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a similarity of `percent` or more.

    Words: A-Z lower-cased, split at ASCII white space. A document with fewer than five words
    has its whole sequence as its one shingle; one without words, or with a null text, has an empty set
    and is linked with nothing. Documents of one word sequence are one class and one node of the search, whatever their
    ids; links are sought between classes and confirmed on the full sets.

    Returns one row per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id
    reachable), kept (doc_id = component_id). Rows that repeat a doc_id with different texts are linked each by its own
    text; a null doc_id is never the smallest, and its row's component_id is null and kept is true if it reaches no other id.
    Very long texts are one set each. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("look", F.xxhash64("doc_id", "text"))
    sk = settle(sketches(d, ["doc_id", "look"]), compact=True)
    parts = -(-sk.count() // PART) or 1
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "look")
    nodes = sk.where("n_shingles > 0").groupBy("key").agg(F.min(own).alias("o"), F.min_by("sketch", own).alias("sketch"), F.min("n_shingles").alias("n"))
    nodes = settle(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "o.doc_id", "o.look", "sketch", "n"), parts=parts)
    texts = d.where("text is not null")
    found = confirm(band_pairs(nodes), nodes, texts, percent, parts)
    known = named_nodes(nodes.select("node"), found, parts)
    release(spark)
    shared, lists = inverted_lists(nodes.select("node", "sketch", "n").join(known, "node"), parts)
    found = found.union(confirm(list_pairs(shared, lists, percent), nodes, texts, percent, parts))
    long = shared.join(lists.where(F.col("len") > LIST).select("v"), "v", "left_semi").select("node").distinct()
    long = settle(nodes.select("node", "doc_id", "look").join(long, "node", "left_semi"), parts=parts)
    release(spark)
    if not long.isEmpty():
        members = fetch(texts, long)
        rows = settle(prefix_rows(members, percent))
        for pairs in (lambda k: star_pairs(rows, k, percent, F.min), lambda k: star_pairs(rows, k, percent, F.max), lambda k: prefix_pairs(rows, k, percent)):
            known = named_nodes(nodes.select("node"), found, parts)
            found = found.union(confirm(pairs(known), nodes, texts, percent, parts, members))
            release(spark)
    known = named_nodes(nodes.select("node"), found, parts)
    named = nodes.select("node", "key", "doc_id").join(known, "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = settle(named.join(least, "component").select("key", "component_id"), parts=parts)
    out = sk.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, grouped: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`docs` without the rows that are not kept; rows that repeat a kept doc_id stay together."""
    gone = settle(grouped.where("not kept").select(F.col("doc_id").alias("id")).distinct(), narrow=True)
    names = docs.columns
    d = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    return without_ids(d, f"_c{names.index(doc_id)}", gone, "id").toDF(*names)
