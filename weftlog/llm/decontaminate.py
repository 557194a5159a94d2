"""Benchmark decontamination: CGK embeddings of windows, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlog.llm.common import map_texts
from weftlog.llm.vector_text import PLAIN, Words, windows

TABLE = bytes(PLAIN)
#: Edits that a passage may be away from an item, as a part of the item's bytes.
EDITS = 0.1
#: Shorter items (bytes, after normalising) are sought verbatim, as whole words: edited ones are everyday phrases.
SHORT = 32
#: Random walks; steps are made LEAP at once. A walk takes as many steps as the item's length allows: (least bytes, steps), so that
#: windows of long items are told apart well and edits leave enough windows of short ones. After FIRST steps most windows are known to be in no bucket.
WALKS, LEAP, FIRST = 8, 3, 15
CLASSES = ((SHORT, 21), (64, 27), (96, 33), (192, 45))
STEPS = CLASSES[-1][1]
#: The part of a walk's places that its sample has.
SAMPLED = 0.75
#: One position in so many, besides the beginnings of words, begins a window: told by two bytes, so edits elsewhere do not move it.
SPACING = 4
SEED = 20_11
#: Bytes of q-grams in the exact filter before the edit distance.
GRAM = 4
#: Items that one pass over the documents takes, in bytes; more make more passes.
PASS_BYTES = 16 << 20
#: Candidates that are looked at together.
STEP = 1 << 16

#: Symbols of the walks: letters, the space and what is left, digits by fours, other bytes by eights.
SYMBOL = np.zeros(256, np.uint16)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[48:58] = 27 + np.arange(10) // 4
SYMBOL[128:] = 30 + np.arange(128) // 8 % 2


def normal(text: bytes | None) -> bytes:
    """A-Z lower-cased; each run of other ASCII than letters and digits is one space."""
    return b" ".join((text or b"").translate(TABLE).split())


def begins(data: np.ndarray) -> np.ndarray:
    """Where windows begin: at each word, and at one position in SPACING after bytes that say so."""
    gap = (data == 32) | (data == 10)
    at = np.ones(len(data), bool)
    at[1:] = gap[:-1]
    pair = data[:-1].astype(np.uint32) * 31 + data[1:].astype(np.uint32) * 7
    at[2:] |= ((pair * np.uint32(2654435761) >> np.uint32(13)) % SPACING == 0)[:-1]
    return np.flatnonzero(at & ~gap)


class Walks:
    """CGK embeddings of the bytes from a place on, and bit samples of them as bucket numbers.

    A walk puts out the symbol under its pointer at each step, and a random bit of the step and the symbol says whether the
    pointer moves on. So an edit changes the output where it is, after which the walks of both texts tend to meet again. LEAP
    steps depend on LEAP symbols at most and are read from a table.
    """

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.leaps = []
        code = np.arange(1 << 5 * LEAP)
        for _ in range(WALKS):
            moves = rng.integers(0, 2, (STEPS, 32))
            sampled = rng.random(STEPS) < SAMPLED
            salt = rng.integers(0, 1 << 63, (STEPS, 32), dtype=np.int64).astype(np.uint64)
            own = []
            for first in range(0, STEPS, LEAP):
                at, out = np.zeros(len(code), np.int64), np.zeros(len(code), np.uint64)
                for step in range(first, first + LEAP):
                    symbol = code >> 5 * at & 31
                    if sampled[step]:
                        out += salt[step][symbol]
                    at += moves[step][symbol]
                own.append(out << np.uint64(2) | at.astype(np.uint64))
            self.leaps.append(own)

    @staticmethod
    def codes(data: np.ndarray) -> np.ndarray:
        """The LEAP symbols from each place on as one number; after the end come zeros."""
        s = np.concatenate((SYMBOL[data], np.zeros(STEPS + LEAP, np.uint16)))
        n = len(s) - LEAP + 1
        return (s[:n] | s[1 : n + 1] << 5 | s[2 : n + 2] << 10).astype(np.int64)

    def buckets(self, codes: np.ndarray, at: np.ndarray, walk: int, steps: int, since: int = 0, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each window after `steps` steps, and where the walk is then; it goes on from `since` steps and their outcome."""
        out = np.zeros(len(at), np.uint64) if out is None else out
        for leap in self.leaps[walk][since // LEAP : steps // LEAP]:
            made = leap.take(codes.take(at, mode="clip"), mode="clip")  # no place is beyond the end: this is the faster way
            at = at + (made & np.uint64(3)).view(np.int64)
            made >>= np.uint64(2)
            out = out + made
        return out, at


@dataclass
class Items:
    """Benchmark items with what finding them needs; fixed once made and sent to all executors."""

    ids: list
    texts: list[bytes]
    lengths: np.ndarray = field(init=False)
    edits: np.ndarray = field(init=False)

    def __post_init__(self):
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.where(self.lengths < SHORT, 0, (self.lengths * EDITS).astype(np.int64))
        #: short items by their number of words: hashes, and the items of each text
        self.of: dict[bytes, list[int]] = {}
        for i in np.flatnonzero((self.lengths < SHORT) & (self.lengths > 0)):
            self.of.setdefault(self.texts[i], []).append(int(i))
        self.by_words: dict[int, np.ndarray] = {}
        for n in {t.count(b" ") + 1 for t in self.of}:
            own = Words([t for t in self.of if t.count(b" ") + 1 == n])
            self.by_words[n] = np.unique(windows(own.hashes(), n)[::n])
        self.walks = Walks()
        #: distinct q-grams, made when an item is first a candidate
        self.grams: dict[int, frozenset] = {}
        raw = b"\n".join(self.texts) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        first = np.concatenate(([0], np.cumsum(self.lengths + 1)))[: len(self.texts)]
        at = begins(data)
        item = np.searchsorted(first, at, "right") - 1
        at, item = at[self.lengths[item] >= SHORT], item[self.lengths[item] >= SHORT]
        codes = self.walks.codes(data)
        kind = np.searchsorted([least for least, _ in CLASSES], self.lengths[item], "right") - 1
        #: of each walk: known beginnings, and for each class the buckets in order with item and place, and the windows of longer classes after as many steps
        self.known, self.tables = [], []
        for k in range(WALKS):
            self.known.append(self.marked(self.walks.buckets(codes, at, k, FIRST)[0]))
            own = []
            for c, (_, steps) in enumerate(CLASSES):
                onward = self.marked(self.walks.buckets(codes, at[kind > c], k, steps)[0])
                some = np.flatnonzero(kind == c)
                bucket, end = self.walks.buckets(codes, at[some], k, steps)
                inside = end <= first[item[some]] + self.lengths[item[some]]
                order = np.argsort(bucket[inside], kind="stable")
                some, bucket = some[inside][order], bucket[inside][order]
                own.append((bucket, self.marked(bucket), item[some].astype(np.int32), (at - first[item])[some].astype(np.int32), onward))
            self.tables.append(own)

    def __getstate__(self) -> tuple:
        return self.ids, self.texts

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)  # what can be made from the texts is not sent

    @staticmethod
    def slot(code: np.ndarray, size: int) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).view(np.int64)

    def marked(self, bucket: np.ndarray) -> np.ndarray:
        """One flag a slot that buckets are hashed to, of which few are set."""
        known = np.zeros(1 << min(22, max(12, (32 * len(bucket)).bit_length())), bool)
        known[self.slot(bucket, len(known))] = True
        return known

    def held(self, known: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return np.flatnonzero(known.take(self.slot(bucket, len(known)), mode="clip"))

    def gram_set(self, i: int) -> frozenset:
        if i not in self.grams:
            t = self.texts[i]
            self.grams[i] = frozenset(t[j : j + GRAM] for j in range(len(t) - GRAM + 1))
        return self.grams[i]

    def candidates(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, place where the item would begin), in this order, of all windows that share a bucket with a window of an item."""
        at, codes = begins(data), self.walks.codes(data)
        places, items, offs = ([np.zeros(0, np.int64)] for _ in range(3))
        for k, tables in enumerate(self.tables):
            for lo in range(0, len(at), STEP):
                begin = at[lo : lo + STEP]
                got, here = self.walks.buckets(codes, begin, k, FIRST)
                go, done = self.held(self.known[k], got), FIRST
                for (bucket, known, item, off, onward), (_, steps) in zip(tables, CLASSES, strict=True):
                    begin = begin[go]
                    got, here = self.walks.buckets(codes, here[go], k, steps, done, got[go])
                    go, done = self.held(onward, got), steps
                    own = self.held(known, got)
                    if not len(own):
                        continue
                    a, b = np.searchsorted(bucket, got[own], "left"), np.searchsorted(bucket, got[own], "right")
                    count = b - a
                    which = np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())
                    places.append(np.repeat(begin[own], count))
                    items.append(item[which].astype(np.int64))
                    offs.append(off[which].astype(np.int64))
        place, item = np.concatenate(places), np.concatenate(items)
        doc = np.searchsorted(first, place, "right") - 1
        start = place - np.concatenate(offs)
        key = np.unique((doc * len(self.ids) + item) << 36 | start + PASS_BYTES)
        both, start = key >> 36, (key & (1 << 36) - 1) - PASS_BYTES
        return both // max(1, len(self.ids)), both % max(1, len(self.ids)), start

    def verbatim(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(document, item) of the short items that normalised texts hold as whole words."""
        if not self.of:
            return []
        w, out = Words(texts), []
        h = w.hashes()
        for n, known in self.by_words.items():
            at = np.flatnonzero(np.isin(windows(h, n), known))
            doc = np.searchsorted(w.bounds, at, "right") - 1
            for k, d in zip(at[at + n <= w.bounds[doc + 1]], doc[at + n <= w.bounds[doc + 1]], strict=True):
                out += [(int(d), i) for i in self.of.get(w.buf[w.starts[k] : w.ends[k + n - 1]].tobytes(), ())]
        return out


def distance(item: bytes, text: bytes, most: int) -> int:
    """Smallest edit distance of `item` to any part of `text`, or most + 1 if it is larger. Bit-parallel over the item."""
    n = len(item)
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    for c in text:
        eq = where.get(c, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (~(d | up) & full), up & d
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = right << 1 & full
        left = left << 1 & full
        up, down = left | (~(d | right) & full), right & d
        best = min(best, score)
    return min(best, most + 1)


def near(items: Items, i: int, text: bytes) -> int:
    """Edit distance of item i to the nearest part of `text`, or more than its edits. The q-grams that an edit can destroy are few, so most texts need no distance."""
    t, most = items.texts[i], int(items.edits[i])
    if t in text:
        return 0
    grams = items.gram_set(i)
    if len(grams) - GRAM * most > len(grams.intersection(text[j : j + GRAM] for j in range(len(text) - GRAM + 1))):
        return most + 1
    return distance(t, text, most)


def find(items: Items, texts: list) -> list[dict[int, int]]:
    """For each text: item number to edit distance, of items within their edits."""
    data = [normal(t) for t in texts]
    raw = b"\n".join(data) + b"\n"
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in data])))
    found: list[dict[int, int]] = [{} for _ in texts]
    for d, i in items.verbatim(data):
        found[d][i] = 0
    seen, end = (-1, -1), 0
    for d, i, start in zip(*(x.tolist() for x in items.candidates(np.frombuffer(raw, np.uint8), first[:-1])), strict=True):
        n, most = int(items.lengths[i]), int(items.edits[i])
        # what is looked at holds every passage that begins up to `most` after this place: those need no look of their own
        if found[d].get(i) == 0 or seen == (d, i) and start <= end:
            continue
        seen, end = (d, i), start + most
        e = near(items, i, raw[max(first[d], start - most) : max(0, min(start + n + 2 * most, first[d + 1] - 1))])
        if e <= most:
            found[d][i] = min(e, found[d].get(i, e))
    return found


def load_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", part: int = 0, parts: int = 1) -> Items:
    """The items of one part of a benchmark table; those without id or text, or without a letter or digit, are left out."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null and i is not null")
    rows = rows.where(F.pmod(F.xxhash64("i", F.lit(47)), F.lit(parts)) == part).collect()
    texts = sorted((r["i"], normal(bytes(r["t"]))) for r in rows)
    return Items([i for i, t in texts if t], [t for _, t in texts if t])


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns, then leaks: array<struct<item_id, edits>>, the items that the whole text holds.

    An item is held if some part of the text is within EDITS of its bytes, both lower-cased and with each run
    of white space or punctuation as one space. Windows begin at each word of texts and items, and at further places that
    their bytes tell. WALKS CGK embeddings of a window's bytes, each sampled at some of its places, put it into buckets;
    windows of a text and an item that share one make a candidate, where an exact q-gram count and an exact edit
    distance decide. An item of n bytes has about n / 3 windows, of which one has to share one bucket: passages at the limit
    with random edits were found with a chance of over 0.99 at every length (README). Items of less than SHORT bytes are sought
    verbatim, as whole words. The items go to the executors PASS_BYTES at a time: larger benchmarks make further passes.

    A null or empty text holds none; items with a null text or id, or without letters and digits, are not sought; an empty
    benchmark leaves all documents clean. Repeated rows are marked each, and repeated items each by their id.
    """
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.LongType())]))
    total = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts, names = max(1, -(-total // PASS_BYTES)), []
    for part in range(parts):
        box = docs.sparkSession.sparkContext.broadcast(load_items(benchmark, part=part, parts=parts))

        def make(texts: list, box=box) -> list:
            items = box.value
            return [[[{"item_id": items.ids[i], "edits": e} for i, e in sorted(f.items())] for f in find(items, texts)]]

        own = [*keep, *([text] if text not in keep else [])] if parts > 1 else keep
        docs = map_texts(docs, [*own, *names], text, [T.StructField(f"_leaks{part}", kind)], make)
        names.append(f"_leaks{part}")
    return docs.select(*keep, F.array_sort(F.concat(*names)).alias("leaks"))


def report(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, n_items, item_ids (ascending), edits (of each), kept (none found)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    m = mark(d, benchmark, ["doc_id"])
    return m.select("doc_id", F.size("leaks").cast("long").alias("n_items"), F.col("leaks.item_id").alias("item_ids"), F.col("leaks.edits").alias("edits"), (F.size("leaks") == 0).alias("kept"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item, in one pass without a shuffle."""
    names = docs.columns
    cols = [f"_c{i}" for i in range(len(names))]
    return mark(docs.toDF(*cols), benchmark, cols, cols[names.index(text)]).where("size(leaks) = 0").select(*cols).toDF(*names)
