"""Quality classifier: naive Bayes scaled n-gram indicators and a linear hinge-loss model by dual coordinate descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlog.llm.common import least_of_each, map_texts
from weftlog.llm.vector_text import Words, windows

#: Buckets of hashed byte n-grams, their lengths, and the buckets after these that tell how much a text repeats itself.
BUCKETS, ORDERS, REPEATS = 1 << 15, (1, 2, 3, 4), 20
WIDTH = BUCKETS + REPEATS
#: Labelled documents of each class that training uses at most: those of the smallest hashes of doc_id.
MOST_EACH = 3000
ALPHA, COST, EPOCHS = 1.0, 1.0, 25
PREDICT = 0.7


def gram_hashes(buf: np.ndarray) -> list[np.ndarray]:
    """For each length, the bucket of the byte n-gram that starts at each place."""
    out, code = [], np.zeros(len(buf), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = (code[: len(buf) - n + 1] << np.uint64(8)) | buf[n - 1 :].astype(np.uint64) if len(buf) >= n else code[:0]
        if n in ORDERS:
            h = (code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return out


def indicators(texts: list):
    """For each text a boolean array of WIDTH: which buckets its n-grams fall in. The array is reused.

    Besides byte n-grams, the part of its five-word runs that a text has said before sets buckets of its own: k of them for k of REPEATS parts.
    """
    w = Words(texts)
    hashes = gram_hashes(w.buf)
    runs = windows(w.hashes(), 5)
    flags = np.zeros(WIDTH, bool)
    for i, t in enumerate(texts):
        flags[:] = False
        a, b = w.first[i], w.first[i + 1] - 1
        for n, h in zip(ORDERS, hashes, strict=True):
            if b - a >= n:
                flags[h[a : b - n + 1]] = True
        x, y = w.bounds[i], w.bounds[i + 1] - 4
        if y > x:
            part = int(REPEATS * (1 - len(np.unique(runs[x:y])) / (y - x)))
            flags[BUCKETS : BUCKETS + part] = True
        yield flags


@dataclass
class Model:
    weights: np.ndarray  # float32, WIDTH
    bias: float
    slope: float  # of the margin in the score
    shift: float

    def scores(self, texts: list) -> list[float]:
        out = []
        for flags in indicators(texts):
            x = self.weights[flags]
            margin = float(x.sum()) / max(1.0, np.sqrt(np.count_nonzero(flags))) + self.bias
            out.append(float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))))
        return out


def fit(rows: list[np.ndarray], y: np.ndarray, prior: float) -> Model:
    """`rows`: the buckets of each example; `y`: 1 or 0; `prior`: part of label 1 among all labelled rows."""
    if not len(y) or y.min() == y.max():
        p = np.clip(prior, 1e-3, 1 - 1e-3)
        return Model(np.zeros(WIDTH, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    one, zero = (ALPHA + sum((np.bincount(r, minlength=WIDTH) for r, k in zip(rows, y, strict=True) if k == label), np.zeros(WIDTH)) for label in (1, 0))
    ratio = np.log(one / one.sum()) - np.log(zero / zero.sum())
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, COST * len(y) / (2 * (y == 1).sum()), COST * len(y) / (2 * (y == 0).sum()))
    scale = [1 / max(1.0, np.sqrt(len(r))) for r in rows]
    square = np.array([(ratio[r] ** 2).sum() * s * s + 1 for r, s in zip(rows, scale, strict=True)])
    w, bias, a = np.zeros(WIDTH), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):  # dual coordinate descent on the hinge loss
        for i in rng.permutation(len(y)):
            r = rows[i]
            xi = ratio[r] * scale[i]
            g = sign[i] * (w[r] @ xi + bias) - 1
            new = min(max(a[i] - g / square[i], 0.0), cost[i])
            if new != a[i]:
                d = (new - a[i]) * sign[i]
                w[r] += d * xi
                bias += d
                a[i] = new
    margin = np.array([(w[r] * ratio[r]).sum() * s for r, s in zip(rows, scale, strict=True)]) + bias
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    slope, shift = 1.0, 0.0
    goal = np.where(y == 1, 0.98, 0.02)
    for _ in range(400):  # the score's slope and shift, by gradient steps on the weighted log loss
        e = (1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30))) - goal) * weight
        slope, shift = slope - 2 * (e * margin).sum(), shift - 2 * e.sum()
    return Model((w * ratio).astype(np.float32), float(bias), float(max(slope, 0.05)), float(shift))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", most: int = MOST_EACH) -> Model:
    """Learns from at most `most` labelled documents of each class that are not held out.

    Which ones is settled on the ids, so that only their texts are read out; each comes to the driver as the numbers of its buckets.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = least_of_each(known, "y", totals, F.xxhash64("doc_id", F.lit(41)), most).select(F.col("doc_id").alias("_id"), "y")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = map_texts(d.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")), ["doc_id", "y"], "text", [T.StructField("x", T.BinaryType())], pack)
    # rows that repeat a doc_id give one example, however many they are
    got = rows.groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    got.sort(key=lambda r: (r["doc_id"]))
    x = [np.frombuffer(bytes(r["x"]), np.uint16) for r in got]
    return fit(x, np.array([r["y"] for r in got], int), totals.get(1, 0) / max(1, sum(totals.values())) if totals else 0.5)


def pack(texts: list) -> list:
    return [[np.flatnonzero(f).astype(np.uint16).tobytes() for f in indicators(texts)]]


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= PREDICT) of every whole text.

    Held out: crc32 of doc_id as text, mod 4, is 2; those labels are never learned from. Null and empty texts are scored
    as texts without n-grams. Labels other than 0 and 1, and contradicting ones of a doc_id, are not used; without
    labels of both classes every score is the share of label 1 (0.5 without any). Very long texts are scored whole, by which n-grams they
    have. Repeated rows are scored each; an empty table gives no rows; no other column is read.
    """
    box = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, text, doc_id))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = map_texts(d, ["doc_id"], "text", [T.StructField("score", T.DoubleType())], lambda texts: [box.value.scores(texts)])
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
