import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from talus.llm import near_dedup as N
from talus.llm.components import components

SCHEMA = "doc_id long, text string, n int, digest string, kept boolean, key string"


def plain_set(text, width):
    words = ("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def plain(docs, width, percent):
    """Components over all pairs. docs: (doc_id, text)."""
    sets = [(d, plain_set(t, width)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, p) in enumerate(sets):
        for b, q in sets[:i]:
            if p and q and 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) and 100 * len(p & q) >= percent * len(p | q):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return Counter((d, len(s), find(d)) for d, s in sets)


def check(rows, docs, width, percent):
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == plain(docs, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    check(N.near_duplicates(df, 3, 85).collect(), docs, 3, 85)


def test_dense_groups_chains_and_edges(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(120)]
    docs = []
    for _ in range(150):  # many near copies of one text, at all distances around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        docs.append(" ".join(w))
    w = list(base)
    for _ in range(30):  # a chain whose ends are far apart
        w[rng.randrange(len(w))] = word()
        docs.append(" ".join(w))
    passage = " ".join(word() for _ in range(30))
    docs += [f"{passage} " + " ".join(word() for _ in range(rng.randint(3, 40))) for _ in range(120)]  # a shared passage
    docs += ["", None, " \t\n", "one", "ONE", "one two", "One  Two", "é É", "two one", "a b c"] * 2 + ["w " * 20_000]
    rows = list(enumerate(docs))
    df = spark.createDataFrame([(i, t, 0, "", True, "") for i, t in rows], SCHEMA).repartition(3)
    check(N.near_duplicates(df, 3, 85).collect(), rows, 3, 85)
    check(N.near_duplicates(df).collect(), rows, 5, 80)


def test_rows_without_or_with_the_same_id_and_empty_table(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (4, "x y z"), (2, "x y z"), (None, "x y z"), (None, None), (9, "A B C D E F")]
    got = N.near_duplicates(spark.createDataFrame([(d, t, 0, "", True, "") for d, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == sorted(
        [(4, 2, 4, True), (4, 2, 4, True), (4, 1, 2, False), (2, 1, 2, True), (0, 1, 0, True), (0, 0, 0, True), (9, 2, 4, False)])
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
    b = np.concatenate([a[:3600], rng.integers(0, 2**64, 400, dtype=np.uint64)])
    same = np.mean(N.signature(a) == N.signature(b))
    assert abs(same - 3600 / 4400) < 0.12
    assert 0 < N.least_matches(80) < N.least_matches(85) < N.TREES * N.DEPTH


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5000 + i) for i in range(1, 300)]
    root = defaultdict(lambda: None)

    def find(x):
        while root[x] not in (None, x):
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        if x != y:
            root[y] = x
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {(x, find(x)) for x in nodes} and len(got) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_partition_borders_lose_nothing(spark):
    """More partitions than a region has rows."""
    docs = [(i, "shared words of one text " * 3 + f"{'a b c d e f g h i j k l ' * 2}{i % 7}") for i in range(300)]
    df = spark.createDataFrame([(d, t, 0, "", True, "") for d, t in docs], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check(N.near_duplicates(df, 3, 85).collect(), docs, 3, 85)
        assert df.select(F.col("doc_id")).count() == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hub_of_many_copies_that_are_only_similar_to_it(spark):
    """Links of one text to 2,000 copies, no two of which are linked, against brute force."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(402)]
    docs = [(0, " ".join(base))]
    for i in range(1, 2001):
        w = list(base)
        for at in rng.sample(range(len(w)), 10):
            w[at] = word()
        docs.append((i, " ".join(w)))
    rows = N.near_duplicates(spark.createDataFrame([(d, t, 0, "", True, "") for d, t in docs], SCHEMA).repartition(4), 3, 85).collect()
    sets = [plain_set(t, 3) for _, t in docs]
    linked = {d for (d, _), s in zip(docs, sets) if 100 * len(s & sets[0]) >= 85 * len(s | sets[0])}
    assert len(linked) > 1500 and linked <= {r.doc_id for r in rows if r.component_id == 0}
    assert sum(r.kept for r in rows) <= 2001 - len(linked) + 1


def test_similar_sets_share_a_part():
    rng = np.random.default_rng(5)
    for percent in (50, 80, 85, 95):
        for n in [*range(1, 60), 400, 2000]:
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            for cut in range(0, n * (100 - percent) // 100 + 1, max(1, n // 40)):
                new = rng.integers(0, 2**64, rng.integers(0, cut + 1), dtype=np.uint64)
                b = np.unique(np.r_[rng.permutation(a)[cut:], new])
                common = len(np.intersect1d(a, b))
                if 100 * common >= percent * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                    assert len(np.intersect1d(N.part_keys(a, percent), N.part_keys(b, percent)))


def test_trees_fit_the_percentage(spark):
    for percent in (40, 60, 75, 80, 85, 95):
        trees, depth = N.forest(percent)
        assert (1 - (percent / 100) ** depth) ** trees <= 1e-6 and trees >= N.TREES
    assert N.forest(85) == (16, 3) and N.forest(80) == (20, 3)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    docs = []
    for _ in range(10):
        base = [word() for _ in range(60)]
        for _ in range(10):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame([(d, t, 0, "", True, "") for d, t in docs], SCHEMA)
    check(N.near_duplicates(df, 3, 60).collect(), docs, 3, 60)


def test_only_texts_that_are_asked_for_are_exchanged(spark):
    from talus.llm.common import maybe_named

    docs = spark.range(-20_000, 20_000).selectExpr("id AS doc_id", "concat('a b c ', id) AS text").unionByName(spark.sql("SELECT CAST(NULL AS long) AS doc_id, '' AS text"))
    names = docs.filter("doc_id % 50 = 7").select("doc_id")
    passed = maybe_named(docs, names, "doc_id")
    assert passed.columns == docs.columns and passed.join(names, "doc_id", "left_semi").count() == names.count() <= passed.count() < 2 * names.count()
    assert maybe_named(docs, names.limit(0), "doc_id").isEmpty()
    sigs = docs.selectExpr("doc_id", "cast(text AS binary) AS digest")
    plan = N.full_sets(docs, sigs, sigs.filter("doc_id = 7").select("digest"), 3)._jdf.queryExecution().toString()
    assert "bitmap_construct_agg" in plan


def test_sets_are_told_apart_before_they_are_exchanged(spark):
    rows = lambda where: spark.range(100).filter(where).selectExpr("cast(concat('n', id) AS binary) AS digest", "unhex('0000000000000001') AS members")
    pairs = rows("id < 4").selectExpr("digest AS a", "digest AS b")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = N.confirm(pairs, rows("id >= 0"), 80)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == 4 and "LeftSemi" not in plan and "bitmap_construct_agg" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
