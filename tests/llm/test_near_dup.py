"""Near-duplicate groups against all pairs, with dense groups, shared passages, copies and short texts; the pipeline."""

import random

import pytest

from weftlog.llm import near_dup, quality_rules


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, texts = [rng.choice(vocabulary) for _ in range(150)], []
    for _ in range(160):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 7])):
            t[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(t))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([20, 80, 200]))) + " " + passage for _ in range(60)]
    texts += [texts[3]] * 30 + ["a b", "a b", "A b", "a B c", "", None, "  \n", texts[3].upper()]
    return texts


def groups(texts, percent):
    sets = [near_dup.shingle_set("".join(c.lower() if c.isascii() else c for c in t or "").split()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (find(i), len(s)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("longest", "stretch"), [(64, 256), (6, 5)])
def test_groups(spark, monkeypatch, longest, stretch):
    monkeypatch.setattr(near_dup, "LIST", longest)
    monkeypatch.setattr(near_dup, "STRETCH", stretch)
    texts = corpus()
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string, component long")
    out = near_dup.group(df)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in out.collect()}
    want = groups(texts, 85)
    assert got == want
    if longest == 64:
        kept = near_dup.keep_one(df, out)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i][0] == i)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.group(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, near_dup.group(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def test_repeated_ids(spark):
    """Rows of one id with different texts, rows that repeat id and text, and rows without an id."""
    rng = random.Random(3)
    a, b, c = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(80)) for x in "abc")
    near = [t + " tail" for t in (a, b, c)]
    rows = [(5, a), (5, b), (5, b), (7, near[0]), (8, near[1]), (8, near[1]), (None, c), (None, near[2]), (None, a), (9, "x y"), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.group(df).collect() if r.doc_id is not None)
    assert got == [(False, 5, 76, 5, True)] * 3 + [(False, 7, 77, 5, False)] + [(False, 8, 77, 5, False)] * 2 + [(False, 9, 0, 9, True), (False, 9, 1, 9, True)]
    none = sorted((r.component_id is None, r.component_id, r.kept) for r in near_dup.group(df).collect() if r.doc_id is None)
    assert none == [(False, 5, False), (True, None, True), (True, None, True)]


def test_long_texts(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    other = list(words)
    for _ in range(2000):
        other[rng.randrange(len(other))] = "x"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[::-1])), (4, " ".join(words[:100_000]))]
    got = {r.doc_id: r.component_id for r in near_dup.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_prefixes_leave_shared_passages_out(spark):
    """Documents that share most of their words, but not enough, make rows by their number, and no pairs."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [passage + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(30)) for _ in range(400)]
    made = []
    for n in (100, 400):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:n])], "node long, text string")
        rows = near_dup.prefix_rows(df, 85).cache()
        known = df.select("node", df["node"].alias("component"))
        assert near_dup.prefix_pairs(rows, known, 85).count() == 0
        made.append(rows.count())
    assert made[1] == 4 * made[0] and made[0] <= 16 * 100
    # and similar ones are all met, whatever the order of the shingles
    base = [f"b{i}" for i in range(120)]
    variants = []
    for _ in range(40):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        variants.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(variants + texts[:40])), "node long, text string")
    known = df.select("node", df["node"].alias("component"))
    pairs = {(r.a, r.b) for r in near_dup.prefix_pairs(near_dup.prefix_rows(df, 85), known, 85).collect()}
    sets = [near_dup.shingle_set(t.split()) for t in variants]
    for i in range(40):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] != sets[j] and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                assert (j, i) in pairs
    assert all(b < 40 for _, b in pairs)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = corpus()
    rng = random.Random(2)
    item = " ".join(f"q{rng.randrange(900)}" for _ in range(40))
    texts += [" ".join(f"v{rng.randrange(5000)}" for _ in range(90)) + " " + item.upper() for _ in range(3)] + ["too short"]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the plain way: good ones, the smallest of each group among them, without the benchmark's
    measured = list(zip(*quality_rules.measure([None if t is None else t.encode() for t in texts]), strict=True))
    good = [i for i, m in enumerate(measured) if m[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    comp = groups([texts[i] for i in good], 85)
    left = {good[i] for i, (c, _) in comp.items() if c == i and item.upper() not in texts[good[i]]}
    ids = {r.doc_id for r in out}
    assert ids <= left and len(ids) > len(left) / 2
    sizes = {i: len(texts[i].split()) for i in left}
    assert abs(sum(sizes[r.doc_id] for r in out) - sum(sizes.values())) < 0.1 * sum(sizes.values())
    shards = {}
    for r in out:
        assert shards.setdefault(r.doc_id, r.shard) == r.shard


def test_stages_take_rows_as_they_come(spark, tmp_path):
    """Every stage on nulls in any column, repeated and long rows, further columns with clashing names, and on nothing."""
    import corpus_pipeline

    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    text = " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))
    texts = [None, "", "  ", "one", text, text, text.upper(), long, "é ü 中 " * 30]
    rows = [(None if i == 4 else i % 7, t, None if i % 2 else "en", None if i % 3 else "s", None, i, "k", -1, "z", 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, key string, shard int, failed string, component_id double")
    spark.createDataFrame([(1, " ".join(text.split()[:30])), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = stage(spark, docs, str(tmp_path))
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and none.columns == kept[name].columns
        if name != "sharding":
            assert kept[name].columns == docs.columns and kept[name].schema["text"] == docs.schema["text"]
    assert {r.text for r in kept["quality_rules"].select("text").collect()} == {text, text.upper(), long}
    assert {r.text for r in kept["near_dup"].select("text").collect()} >= {None, "", "  ", "one", long}
    assert {r.text for r in kept["decontaminate"].select("text").collect()} == {None, "", "  ", "one", long, "é ü 中 " * 30}
    assert {r.text for r in kept["mixing"].select("text").collect()} <= {t for t in texts if t and t.split()}
    assert kept["sharding"].count() == len(texts)
