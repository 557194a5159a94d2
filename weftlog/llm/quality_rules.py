"""Quality rules as a bitmask ledger: measure once, then apply and compare policies by bit operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlog.llm.common import map_texts
from weftlog.llm.vector_text import WHITE, Words, windows

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"

#: Rule name, and the condition under which a document fails it. The order gives the bits and is never changed.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "n_dup_lines > 20 and 4 * n_dup_lines > n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: A policy is the mask of the rules that reject; a version is never changed once in use.
POLICIES = {"base": BASE, "v1": BASE | BIT["many_symbols"] | BIT["short_words"] | BIT["long_words"], "v2": (1 << len(RULES)) - 1}
CURRENT = "v2"


def measure(texts: list) -> list:
    """The five measurements of each text, over all of it."""
    w = Words(texts)
    h = w.hashes()
    # code points: bytes that do not continue a character
    lead = (w.buf & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(lead & ~WHITE[w.buf])))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate(([0], np.cumsum(symbol[w.buf])))
    first, last = w.first[:-1], w.first[1:]
    repeats = np.zeros(len(texts), np.int64)
    every = windows(h, 3)
    for i in np.flatnonzero(w.n >= 3):
        a, b = w.bounds[i], w.bounds[i + 1]
        own = every[a : b - 2]
        _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        if twice.any():
            covered = np.zeros(b - a + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + 3, -1)
            repeats[i] = np.count_nonzero(np.cumsum(covered)[: b - a] > 0)
    dup = []
    for t in texts:
        lines = [x for x in (t or b"").split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        dup.append(len(lines) - len(set(lines)))
    return [w.n, points[last] - points[first], symbols[last] - symbols[first], dup, repeats]


def ledger(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """`keep` columns, the five measurements, and failed: bit i is set where rule i fails.

    Words: runs of anything but ASCII white space. word_chars: code points in words. n_symbols: characters
    of #*$%&|<>. n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words within
    a 3-word window that the text holds twice or more. A null or empty text measures 0. Very long texts are measured whole, repeated
    rows each; an empty table gives no rows. Columns of `docs` that are named like a measurement are not read unless they are kept, which
    `select_good` does under other names.
    """
    keep = ["doc_id"] if keep is None else keep
    fields = [T.StructField(m, T.LongType()) for m in MEASURES]
    out = map_texts(docs, keep, text, fields, measure)
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES), F.lit(0))
    return out.withColumn("failed", bits.cast("int"))


def passes(policy: str = CURRENT, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """rule, n_failed, n_only (rejected by it alone), n_kept_without: from counts of bit patterns.

    The patterns are summed first: at most 2 ** number of rules rows go on.
    """
    mask = POLICIES[policy]
    counts = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("p")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit")) for name, _ in RULES if BIT[name] & mask])).alias("r")
    x = counts.select("p", "n", rules).select("p", "n", "r.rule", "r.bit")
    hit, others = F.col("p").bitwiseAND(F.col("bit")) != 0, F.col("p").bitwiseAND(F.bitwise_not(F.col("bit")))
    return x.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (others == 0), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(others == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def select_good(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of `docs` that the policy keeps, in one pass without a shuffle."""
    names = docs.columns
    cols = [f"_c{i}" for i in range(len(names))]
    book = ledger(docs.toDF(*cols), cols, cols[names.index(text)])
    return book.where(passes(policy)).select(*cols).toDF(*names)
