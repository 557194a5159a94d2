"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlog.llm.common import least_of_each, map_texts
from weftlog.llm.vector_text import LOWER, M, Words, mix

#: Buckets of hashed features.
WIDTH = 1 << 15
#: Words that one step of the vectorised recursions takes of a text; texts of any length are one chain.
STRETCH = 64
#: Training takes so many documents of a language at most (those of the smallest hashes of doc_id), whole, and draws so many
#: stretches of them; of a language's words so many make its lexicon, those that stand in LEAST or more of its stretches and rarely in others'.
MOST_DOCS, MOST_STRETCHES, MOST_LEXICON, LEAST = 100, 700, 2000, 3
EPOCHS, RATE, DECAY = 8, 0.1, 1e-6
UNKNOWN = "und"


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray, lexicon: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word) of all features of the words: prefixes and suffixes of 1 to 3 bytes, 2- and 3-grams, the word itself, and the language whose lexicon has it."""
    n = ends - starts
    word = np.arange(len(starts))
    own, of = [whole >> M(64 - 15)], [word]
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == whole)
        own.append(M(WIDTH) + entry[at[known]].astype(np.uint64))
        of.append(known)

    def code(at: np.ndarray, size: int, mark: int) -> np.ndarray:
        c = np.full(len(at), mark, np.uint64)
        for j in range(size):
            c = (c << M(8)) | buf[at + j].astype(np.uint64)
        return mix(c * M(0x9E3779B97F4A7C15)) >> M(64 - 15)

    for size in (1, 2, 3):
        some = np.flatnonzero(n >= size)
        own += [code(starts[some], size, 1), code(ends[some] - size, size, 2)]
        of += [some, some]
    for size in (2, 3):
        count = np.maximum(0, n - size + 1)
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(count)[:-1])) if len(n) else starts, count) + np.arange(count.sum())
        own.append(code(at, size, 3))
        of.append(np.repeat(word, count))
    return np.concatenate(own).astype(np.int64), np.concatenate(of)


def forward_backward(emit: np.ndarray, trans: np.ndarray, first: np.ndarray, mask: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (T, n, L), scaled messages forward and backward; `emit` holds log scores, `mask` (T, n) whether there is a word.

    `start` (n, L) is the message that comes to the first word, `end` that from behind the last one; without, a chain begins and ends
    here. Each step is scaled to sum 1, so that long chains do not underflow.
    """
    steps, n, labels = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    e[~mask] = 1.0
    move, unit = np.exp(trans - trans.max()), np.eye(labels)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = e[0] * (np.exp(first - first.max()) if start is None else start)
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = np.where(mask[t][:, None], (alpha[t - 1] @ move) * e[t], alpha[t - 1] @ unit)
        alpha[t] = a / a.sum(axis=1, keepdims=True)
    beta[-1] = 1.0 / labels if end is None else end
    for t in range(steps - 2, -1, -1):
        b = np.where(mask[t + 1][:, None], (beta[t + 1] * e[t + 1]) @ move.T, beta[t + 1])
        beta[t] = b / b.sum(axis=1, keepdims=True)
    m = alpha * beta
    return m / m.sum(axis=2, keepdims=True), alpha, beta * e


def whole_chains(emit: np.ndarray, trans: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marginals (words, L) of texts of `sizes` words, one chain each, exactly.

    Stretches of all texts advance side by side: first each stretch's product of transfer matrices, then the messages
    that go in and out of the stretches of a text, then forward-backward within all stretches with these messages.
    """
    labels = len(first)
    chain, step = stretches(sizes)
    n = int(chain[-1]) + 1
    grid, mask = np.zeros((STRETCH, n, labels)), np.zeros((STRETCH, n), bool)
    grid[step, chain], mask[step, chain] = emit, True
    per_text = -(-sizes // STRETCH)
    begin = np.concatenate(([0], np.cumsum(per_text)))[:-1]
    opens = np.zeros(n, bool)
    opens[begin[per_text > 0]] = True
    move, init = np.exp(trans - trans.max()), np.exp(first - first.max())
    start, end = np.tile(init, (n, 1)), np.full((n, labels), 1.0 / labels)
    if per_text.max(initial=0) > 1:
        e = np.exp(grid - grid.max(axis=2, keepdims=True))
        product = np.tile(np.eye(labels), (n, 1, 1))
        for t in range(STRETCH):
            new = (product.reshape(-1, labels) @ move).reshape(n, labels, labels)
            if t == 0:  # a text's first word has no word before
                new[opens] = np.diag(init)
            new *= e[t][:, None, :]
            product = np.where(mask[t][:, None, None], new, product)
            if t % 8 == 7:
                product /= product.sum(axis=(1, 2), keepdims=True)
        message = np.ones((len(sizes), labels))
        for k in range(int(per_text.max()) - 1):
            texts = np.flatnonzero(per_text > k + 1)
            at = begin[texts] + k
            m = np.einsum("nl,nlm->nm", message[texts], product[at])
            message[texts] = m / m.sum(axis=1, keepdims=True)
            start[at + 1] = message[texts] @ move
        message = np.full((len(sizes), labels), 1.0 / labels)
        for k in range(int(per_text.max()) - 1):  # from the last stretch on
            texts = np.flatnonzero(per_text > k + 1)
            at = begin[texts] + per_text[texts] - 1 - k
            m = np.einsum("nlm,nm->nl", product[at], message[texts])
            message[texts] = m / m.sum(axis=1, keepdims=True)
            end[at - 1] = message[texts]
    out = np.empty((len(emit), labels))
    for lo in range(0, n, 4096):
        a, b = np.searchsorted(chain, [lo, lo + 4096])
        part = forward_backward(grid[:, lo : lo + 4096], trans, first, mask[:, lo : lo + 4096], start[lo : lo + 4096], end[lo : lo + 4096])[0]
        out[a:b] = part[step[a:b], chain[a:b] - lo]
    return out


@dataclass
class Tagger:
    labels: list[str]
    weights: np.ndarray  # WIDTH + L, L
    trans: np.ndarray  # L, L
    first: np.ndarray  # L
    lexicon: np.ndarray  # hashes of words, ascending
    entry: np.ndarray  # the language of each, as a number

    def documents(self, texts: list) -> tuple[list, list, list, list]:
        """Language and score of each text (the mean of its words' marginals, largest label), changes of language from word to word, words of each language."""
        w = Words(texts, LOWER)
        size = len(self.labels)
        if not len(w.starts) or not size:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts), [[]] * len(texts)
        letters = word_letters(w)
        marginals = self.words(w)
        label = marginals.argmax(axis=1)
        marginals[~letters] = 0
        sums = ranges(marginals, w.bounds)
        count = ranges(letters.astype(np.int64), w.bounds)
        best = sums.argmax(axis=1)
        score = np.clip(sums[np.arange(len(best)), best] / np.maximum(count, 1), 0, 1)
        by = ranges(np.eye(size, dtype=np.int64)[label] * letters[:, None], w.bounds)
        at = np.flatnonzero(letters)
        text = np.searchsorted(w.bounds, at, "right") - 1
        change = (label[at[1:]] != label[at[:-1]]) & (text[1:] == text[:-1])
        changes = np.bincount(text[1:][change], minlength=len(texts))
        return (
            [self.labels[b] if c else UNKNOWN for b, c in zip(best, count, strict=True)],
            [float(s) if c else 0.0 for s, c in zip(score, count, strict=True)],
            changes.tolist(),
            [[(x, int(k)) for x, k in zip(self.labels, row, strict=True) if k] for row in by],
        )

    def words(self, w: Words) -> np.ndarray:
        """Marginals of each word (words, L), each text one chain."""
        h = w.hashes()
        _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        own, of = features(w.buf, w.starts[at], w.ends[at], h[at], self.lexicon, self.entry)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(at)))
        emit = np.add.reduceat(self.weights[own[order]], cuts, axis=0)[inverse]
        return whole_chains(emit, self.trans, self.first, w.n)


def ranges(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows from each bound to the next."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def word_letters(w: Words) -> np.ndarray:
    """Which words have a letter: a-z, or another character that is one."""
    plain = np.concatenate(([0], np.cumsum((w.buf >= 97) & (w.buf <= 122))))
    has = plain[w.ends] > plain[w.starts]
    wide = np.concatenate(([0], np.cumsum(w.buf >= 128)))
    for i in np.flatnonzero(~has & (wide[w.ends] > wide[w.starts])):
        has[i] = any(c.isalpha() for c in w.buf[w.starts[i] : w.ends[i]].tobytes().decode("utf-8", "ignore"))
    return has


def stretches(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, step) of each word: texts of `sizes` words, in stretches of STRETCH."""
    first = np.concatenate(([0], np.cumsum(sizes)))
    inside = np.arange(first[-1]) - np.repeat(first[:-1], sizes)
    before = np.concatenate(([0], np.cumsum(-(-sizes // STRETCH))))
    return np.repeat(before[:-1], sizes) + inside // STRETCH, inside % STRETCH


def learn_lexicon(h: np.ndarray, label: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and languages of words that stand in one language at least LEAST times, and nine times in ten."""
    kinds, inverse = np.unique(h, return_inverse=True)
    times = np.bincount(inverse * size + label, minlength=len(kinds) * size).reshape(-1, size)
    best, total = times.argmax(axis=1), times.sum(axis=1)
    most = times.max(axis=1)
    found = []
    for c in range(size):
        own = np.flatnonzero((best == c) & (most >= LEAST) & (10 * most >= 9 * total))
        found.append(own[np.argsort(-most[own], kind="stable")][:MOST_LEXICON])
    own = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return kinds[own], best[own]


def fit(texts: list[bytes], langs: list[str]) -> Tagger:
    """Maximum likelihood by forward-backward and adaptive gradient steps, over stretches drawn from all of the texts.

    Half of the stretches hold words of one text, half switch between texts of several languages, so that
    the transitions learn both how long a language lasts and that it may change.
    """
    labels = sorted(set(langs))
    size = len(labels)
    if size < 2:
        return Tagger(labels, np.zeros((WIDTH + 1, max(1, size))), np.zeros((max(1, size),) * 2), np.zeros(max(1, size)), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    w = Words(texts, LOWER)
    h = w.hashes()
    words = [np.concatenate([np.zeros(0, np.int64), *(np.arange(w.bounds[i], w.bounds[i + 1]) for i, x in enumerate(langs) if x == lang)]) for lang in labels]
    of_lang = np.repeat([labels.index(x) for x in langs], w.n)
    lexicon, entry = learn_lexicon(h, of_lang, size)
    rng = np.random.default_rng(7)
    rows, goal = [], []
    for i, own in enumerate(words):
        every = np.arange(0, len(own), STRETCH // 2)
        drawn = np.sort(rng.choice(every, MOST_STRETCHES, replace=False)) if len(every) > MOST_STRETCHES else every
        for turn, lo in enumerate(drawn):
            if turn % 2 == 0:
                part = own[lo : lo + STRETCH]
                rows.append(part), goal.append(np.full(len(part), i))
                continue
            part, lab = [own[lo : lo + int(rng.integers(8, 33))]], [i]
            while sum(map(len, part)) < STRETCH:
                k = int(rng.integers(size))
                if not len(words[k]):
                    continue
                s = int(rng.integers(len(words[k])))
                part.append(words[k][s : s + int(rng.integers(8, 33))])
                lab.append(k)
            lab = np.repeat(lab, [len(p) for p in part])[:STRETCH]
            rows.append(np.concatenate(part)[:STRETCH]), goal.append(lab)
    # only the words drawn are looked at from here on
    used = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
    rows = [np.searchsorted(used, r) for r in rows]
    h, starts, ends = h[used], w.starts[used], w.ends[used]
    n = len(rows)
    grid, mask, truth = np.zeros((STRETCH, n), np.int64), np.zeros((STRETCH, n), bool), np.zeros((STRETCH, n), np.int64)
    for j, (r, g) in enumerate(zip(rows, goal, strict=True)):
        grid[: len(r), j], mask[: len(r), j], truth[: len(r), j] = r, True, g
    _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    own, of = features(w.buf, starts[at], ends[at], h[at], lexicon, entry)
    order = np.argsort(of, kind="stable")
    own, of = own[order], of[order]
    cuts = np.searchsorted(of, np.arange(len(at)))
    kind = inverse[grid]
    weights, trans, first = np.zeros((WIDTH + size, size)), np.zeros((size, size)), np.zeros(size)
    memory = [np.full_like(x, 1e-8) for x in (weights, trans, first)]
    onehot = np.eye(size)
    parts = np.array_split(rng.permutation(n), max(1, n // 256))
    for _ in range(EPOCHS):
        for part in parts:
            k, m, y = kind[:, part], mask[:, part], truth[:, part]
            table = np.add.reduceat(weights[own], cuts, axis=0)
            emit = table[k]
            p, alpha, back = forward_backward(emit, trans, first, m)
            d = (p - onehot[y]) * m[:, :, None]
            flat = np.stack([np.bincount(k.ravel(), d[:, :, c].ravel(), len(at)) for c in range(size)], axis=1)
            g_w = np.stack([np.bincount(own, flat[of, c], WIDTH + size) for c in range(size)], axis=1) / m.sum() + DECAY * weights
            both = alpha[:-1, :, :, None] * np.exp(trans - trans.max()) * back[1:, :, None, :]
            both /= both.sum(axis=(2, 3), keepdims=True)
            link = m[1:] & m[:-1]
            g_t = both[link].sum(axis=0) - np.bincount((y[:-1] * size + y[1:])[link], minlength=size * size).reshape(size, size)
            g_f = d[0].sum(axis=0)
            for x, g, v in zip((weights, trans, first), (g_w, g_t / max(1, link.sum()), g_f / m.shape[1]), memory, strict=True):
                v += g * g
                x -= RATE * g / np.sqrt(v)
    return Tagger(labels, weights.astype(np.float32), trans, first, lexicon, entry)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Tagger:
    """Learns from at most MOST_DOCS whole documents of each language that are not held out.

    Which ones is settled on ids and languages; of the texts only those come to the driver.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    ids = d.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "lang")
    sizes = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chosen = least_of_each(ids, "lang", sizes, F.xxhash64("doc_id", F.lit(43)), MOST_DOCS).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    got = d.where("text is not null").join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    got = got.groupBy("doc_id", "lang").agg(F.min("text").alias("t")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"]))
    return fit([r["t"].encode() for r in got], [r["lang"] for r in got])


def predict(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), n_switches, lang_words of every whole text.

    Held out: crc32 of doc_id as text, mod 3, is 1; only other documents are learned from. Every word gets marginals over
    the learned languages, the whole text being one chain; a text's prediction is the language with the largest mean over words with a letter
    (the first in order on a tie), its score that mean. n_switches: how often the language changes from one such word to the
    next; lang_words: how many of them each language has. Null texts, and texts without a letter, are
    `und` with score 0; so is everything if nothing was learned. Very long texts are labelled to the end. Repeated rows are
    predicted each; an empty table gives no rows; no other column is read.
    """
    box = docs.sparkSession.sparkContext.broadcast(train(docs, text, lang, doc_id))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_switches", T.LongType()), T.StructField("lang_words", T.MapType(T.StringType(), T.LongType()))]
    out = map_texts(d, ["doc_id"], "text", fields, lambda texts: list(box.value.documents(texts)))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_switches", "lang_words")
