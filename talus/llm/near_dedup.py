"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on whole shingle sets.

Every distinct shingle set has ``DEPTH`` MinHash values a tree. Each tree orders all sets by its own
``DEPTH`` values, then by a sketch of the signature. Sets that share at least ``MIN_DEPTH`` (fewer for
low percentages) leading values of a tree form a region; a region of more than ``LEAF`` sets is entered deeper, value by
value, until its parts (leaves) are small, so the depth follows the density. In such a region each set
is also compared with its neighbours in the order, which share the longest prefixes with it.

1. In each leaf, pairs that pass the size bound and the sketch estimate (six standard deviations below
   the similarity asked for) form clusters; a spanning tree of each cluster is its candidate list.
2. One candidate of every set is confirmed on the full sets, and components are formed from the
   links; then the other candidates whose ends are still apart. The work on a group of many copies
   thus grows with its size.
3. Where a candidate failed, its clusters are taken up again: all pairs of members that are not in one
   component yet are confirmed too. So no pair that shares a leaf is skipped unless both ends are
   linked already.
4. Sets of regions over ``LEAF`` are crowded: leaves and windows show them only some of their
   neighbours. All pairs of them in different components are therefore decided exactly. Two sets that
   are similar enough differ in at most D shingles, so of the D + 1 parts into which hash ranges cut
   them one is equal; sets that share such a part are a neighbourhood, and a neighbourhood is compared
   as a whole, in blocks of bounded size by set size, by counting the shingles of all pairs at once.

Sets that are equal are one node, however many documents hold them. The order is made by a range
partitioning whose last keys are sketch and digest, so that a dense region spreads over tasks; leaves
that a partition border cuts are completed from the rows on both sides of it.

Chance of missing a link: a pair of similarity s shares a region of depth d in a tree with chance s^d,
and in a region it is compared or both are crowded. The number of trees is such that all miss with a
chance of ``MISS`` at most: 16 trees of depth 3 at 0.85 (2e-7), 20 at 0.80 (6e-7).

Documents without words have an empty set and are linked with nothing. Null text counts as empty. Rows
without an id are alone and kept. Rows that share an id are linked by their texts, one result row each.
An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import functools
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from talus.llm.common import maybe_named, python_ready, take_over, texts_of
from talus.llm.components import components
from talus.sources.gold import materialize

SHINGLE, PERCENT = 5, 80
#: Trees at least, and usual depth of a region at least; see ``forest``.
TREES, DEPTH, MIN_DEPTH, LEAF = 16, 8, 3, 32
MISS, MOST_TREES = 1e-6, 32
#: Bytes: of a tree's values, of the sketch (two bits of every value of TREES trees), of a sort key.
VALUES, SKETCH = 4 * DEPTH, TREES * DEPTH // 4
KEY = 1 + VALUES + SKETCH
#: Of a block of crowded sets: shingles, at most one set more; what a set counts at least.
BLOCK, LEAST_COUNT = 262_144, 128
#: Shingles counted at once.
COLUMNS = 4096


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; A-Z in lower case, words end at ASCII white
    space. Fewer words than ``width`` make one shingle of all words."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w) for w in text.encode("utf-8", "surrogatepass").lower().split()], dtype=np.uint64)
    if not len(words):
        return words
    width = min(width, len(words))
    h = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h = mix(h ^ words[i : len(words) - width + 1 + i])
    return np.unique(h)


@functools.cache
def forest(percent: int) -> tuple[int, int]:
    """Number of trees, and values that the sets of a region share: as many as MOST_TREES allow."""
    for depth in range(MIN_DEPTH, 0, -1):
        trees = max(TREES, math.ceil(math.log(MISS) / math.log1p(-min(percent / 100, 0.999) ** depth)))
        if trees <= MOST_TREES or depth == 1:
            return min(trees, 255), depth


@functools.cache
def permutations(trees: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    draw = rng.integers(0, 2**64, (2, trees * DEPTH), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def signature(shingles: np.ndarray, trees: int = TREES) -> np.ndarray:
    a, b = permutations(trees)
    out = np.full(len(a), 2**32 - 1, dtype=np.uint32)
    for lo in range(0, len(shingles), 2048):
        h = shingles[lo : lo + 2048, None] * a + b
        out = np.minimum(out, (h.min(axis=0) >> np.uint64(32)).astype(np.uint32))
    return out


def sketch(sig: np.ndarray) -> bytes:
    """The two lowest bits of every value of the first trees, four values to a byte."""
    two = (sig[: TREES * DEPTH] & 3).astype(np.uint8).reshape(-1, 4)
    return (two << np.array([6, 4, 2, 0], dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def signatures(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """Id, hash of the text, set size, digest of the set, MinHash values and sketch of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_over("near-dedup")
        for b in batches:
            n, digest, values = [], [], []
            for t in texts_of(b["text"]):
                s = shingle_set(t, width)
                sig = signature(s, trees) if len(s) else None
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                values.append(sig.astype(">u4").tobytes() + sketch(sig) if len(s) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "mark": b["mark"], "n": n, "digest": digest, "sig": values})

    return docs.mapInPandas(run, "doc_id long, mark long, n long, digest binary, sig binary")


def least_matches(percent: int) -> int:
    """Equal two-bit fields that a pair of the similarity asked for has, six deviations below the mean."""
    n, p = TREES * DEPTH, percent / 100 + (1 - percent / 100) / 4
    return max(0, int(n * p - 6 * (n * p * (1 - p)) ** 0.5))


@functools.cache
def equal_fields() -> np.ndarray:
    """Of a byte that is the exclusive or of two sketch bytes: its zero two-bit fields."""
    x = np.arange(256)
    return sum((x >> s & 3) == 0 for s in (0, 2, 4, 6)).astype(np.uint8)


class Region:
    """Rows of one tree in order, cut into leaves and clusters."""

    def __init__(self, percent: int):
        self.percent, self.least, self.depth = percent, least_matches(percent), forest(percent)[1]

    def clusters(self, keys: np.ndarray, n: np.ndarray, nodes: list[bytes], crowd: int = LEAF) -> Iterator[tuple[int | None, bytes, bytes | None]]:
        """(cluster, member, parent) of every cluster; without a cluster, the sets of regions of more
        than ``crowd`` rows. keys: sorted rows of KEY bytes."""
        if len(keys) < 2:
            return
        same = (keys[1:, : 1 + VALUES] == keys[:-1, : 1 + VALUES])
        words = same[:, 1:].reshape(len(same), DEPTH, 4).all(axis=2) & same[:, :1]
        common = np.cumprod(words, axis=1).sum(axis=1)
        for lo, hi in self.runs(common, 0, len(keys), self.depth):
            if hi - lo > crowd:
                yield from ((None, x, None) for x in nodes[lo:hi])
            for a, b in self.leaves(common, lo, hi):
                yield from self.leaf(keys[a:b], n[a:b], nodes[a:b])

    @staticmethod
    def runs(common: np.ndarray, lo: int, hi: int, depth: int) -> Iterator[tuple[int, int]]:
        """Ranges of two rows or more that share ``depth`` values."""
        cut = np.flatnonzero(common[lo : hi - 1] < depth) + lo + 1
        edges = np.r_[lo, cut, hi]
        for i in np.flatnonzero(np.diff(edges) > 1):
            yield int(edges[i]), int(edges[i + 1])

    def leaves(self, common: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """Parts of a region to compare pair by pair. A region that is too large is entered deeper;
        besides, its rows are compared with their neighbours in the order, whatever depth they share."""
        if hi - lo > LEAF:
            yield from ((a, min(a + LEAF, hi)) for a in range(lo, hi - LEAF // 2, LEAF // 2))
        open_ = [(lo, hi, self.depth)]
        while open_:
            lo, hi, depth = open_.pop()
            if hi - lo <= LEAF:
                yield lo, hi
            elif depth < DEPTH:
                open_ += [(a, b, depth + 1) for a, b in self.runs(common, lo, hi, depth + 1)]

    def leaf(self, keys: np.ndarray, n: np.ndarray, nodes: list[bytes]) -> Iterator[tuple[int, bytes, bytes | None]]:
        sk = keys[:, 1 + VALUES :]
        near = equal_fields()[sk[:, None, :] ^ sk[None, :, :]].sum(axis=2) >= self.least
        near &= 100 * np.minimum(n[:, None], n[None, :]) >= self.percent * np.maximum(n[:, None], n[None, :])
        order = sorted(range(len(nodes)), key=nodes.__getitem__)
        parent: dict[int, int | None] = {}
        for root in order:
            if root in parent:
                continue
            parent[root] = None
            found, at = [root], 0
            while at < len(found):
                for i in order:
                    if i not in parent and near[found[at], i]:
                        parent[i] = found[at]
                        found.append(i)
                at += 1
            if len(found) > 1:
                # Named by its members, so that a cluster that several trees find is one cluster.
                name = xxhash.xxh64_intdigest(b"".join(sorted(nodes[i] for i in found))) - 2**63
                for i in found:
                    p = parent[i]
                    yield name, nodes[i], None if p is None else nodes[p]


FOUND = "cluster long, node binary, parent binary, worker int, head boolean, key binary, n long"


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Cluster members, crowded sets, and the rows at partition borders. ``rows``: key, digest, n."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        region, worker = Region(percent), TaskContext.get().partitionId()
        held: list[pd.DataFrame] = []  # rows of the region that may go on in the next batch
        for i, b in enumerate(batches):
            if not i:
                yield border(b.head(LEAF), worker, True)
            end = b if len(b) >= LEAF or not i else pd.concat([end, b]).tail(LEAF)
            prefix = [k[: 1 + 4 * region.depth] for k in b["key"]]
            start = bisect_left(prefix, prefix[-1])
            if start or not held or held[0]["key"].iloc[0][: 1 + 4 * region.depth] != prefix[-1]:
                yield members(region, pd.concat([*held, b.iloc[:start]], ignore_index=True))
                held = []
            held.append(b.iloc[start:])
        if held:
            yield members(region, pd.concat(held, ignore_index=True))
            yield border(end.tail(LEAF), worker, False)

    ordered = rows.repartitionByRange(parts, "key", "digest").sortWithinPartitions("key", "digest")
    return ordered.select("key", "digest", "n").mapInPandas(run, FOUND)


def border(b: pd.DataFrame, worker: int, head: bool) -> pd.DataFrame:
    return pd.DataFrame({"cluster": None, "node": b["digest"], "parent": None, "worker": worker, "head": head, "key": b["key"], "n": b["n"]}).astype({"cluster": "Int64"})


def members(region: Region, b: pd.DataFrame, crowd: int = LEAF) -> pd.DataFrame:
    keys = np.frombuffer(b"".join(b["key"]), dtype=np.uint8).reshape(len(b), KEY)
    found = list(region.clusters(keys, b["n"].to_numpy(), list(b["digest"]), crowd))
    out = pd.DataFrame(found, columns=["cluster", "node", "parent"]).astype({"cluster": "Int64"})
    return out.assign(worker=None, head=None, key=None, n=None).astype({"worker": "Int32", "n": "Int64", "head": "boolean"})


def seams(found: DataFrame, percent: int) -> DataFrame:
    """Clusters and crowded sets across partition borders: the last rows before a border with the first
    ones after it. A region that fills one side of them may reach further, so its sets are crowded."""
    at = found.filter("head IS NOT NULL").select("worker", "head", "key", F.col("node").alias("digest"), "n")
    # One row per partition.
    follows = at.select("worker").distinct().withColumn("before", F.lag("worker").over(W.Window.orderBy("worker")))
    heads = at.filter("head").join(follows.filter("before IS NOT NULL"), "worker").select(F.col("before").alias("seam"), "head", "key", "digest", "n")
    both = heads.unionByName(at.filter("NOT head").select(F.col("worker").alias("seam"), "head", "key", "digest", "n"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        prefix = b["key"].map(lambda k: k[: 1 + 4 * forest(percent)[1]])
        full = [len(set(prefix[b["head"] == side])) == 1 for side in (False, True)]
        b = b.sort_values(["key", "digest"]).drop_duplicates(["key", "digest"])
        return members(Region(percent), b, 1 if any(full) else LEAF)[["cluster", "node", "parent"]]

    return both.groupBy("seam").applyInPandas(run, "cluster long, node binary, parent binary").filter("node IS NOT NULL")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with whether their full sets are similar enough."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            common = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * common >= percent * (len(p) + len(q) - common))
        return pd.Series(out, dtype=bool)

    # Written, so that their size is known: only sets that a pair names are exchanged.
    pairs = materialize(pairs, "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    # An inner join: a semi join would be moved before the bitmaps.
    asked = maybe_named(sets, named, "digest").join(named, "digest")
    of = lambda side: asked.select(F.col("digest").alias(side), F.col("members").alias(f"set_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", similar("set_a", "set_b").alias("linked"))


def full_sets(docs: DataFrame, sigs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Shingle sets of the given digests, each from one document that has it."""
    ids = materialize(sigs.join(nodes, "digest").groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "named")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, width).tobytes() for t in texts_of(b["text"])]
            yield pd.DataFrame({"digest": b["digest"], "own": [xxhash.xxh3_128_digest(s) for s in sets], "members": sets})

    # Only texts that are asked for are exchanged, which are few of all.
    made = maybe_named(docs, ids, "doc_id").join(ids, "doc_id").select("digest", "text").mapInPandas(run, "digest binary, own binary, members binary")
    # An id may come with several texts; the digest tells which one is meant.
    return made.filter("digest = own").groupBy("digest").agg(F.min("members").alias("members"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not in one component yet, with the components."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter("root_a <> root_b")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: only the components they join are worked on."""
    tops = components(apart(links, roots).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    out = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return materialize(out.select("node", F.coalesce("top", "root").alias("root")), "roots")


def reopened(members_: DataFrame, failed: DataFrame, roots: DataFrame, crowded: DataFrame) -> DataFrame:
    """Pairs of cluster members in different components, of the clusters in which a candidate failed;
    pairs of crowded sets are left to ``completed``."""
    parent_first = members_.filter("parent IS NOT NULL").select("cluster", F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    clusters = parent_first.join(failed, ["a", "b"]).select("cluster").distinct()
    inside = members_.join(clusters, "cluster").select("cluster", "node").join(roots, "node")
    inside = inside.join(crowded.withColumn("crowded", F.lit(True)), "node", "left").select("cluster", "node", "root", F.col("crowded").isNotNull().alias("crowded"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(b["node"], b["root"], b["crowded"]))
        out = [(min(x, y), max(x, y)) for i, (x, p, c) in enumerate(rows) for y, q, d in rows[:i] if p != q and not (c and d)]
        return pd.DataFrame(out, columns=["a", "b"])

    # A cluster lies in one leaf, so it has at most LEAF members.
    return inside.groupBy("cluster").applyInPandas(run, "a binary, b binary").distinct().join(failed, ["a", "b"], "left_anti")


@functools.cache
def size_classes(percent: int) -> list[int]:
    """Largest size of every class. Sizes that a pair may have lie in one class or in neighbouring ones."""
    out = [100 // percent]
    while out[-1] < 2**40:
        out.append((out[-1] + 1) * 100 // percent)
    return out


def part_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """A hash of every part of a set, for its size class and the next one. Two sets that are similar
    enough, of a class and at most the next one, differ in at most ``most`` shingles, so that one part
    of most + 1 is equal. Parts that are empty in both sets can be the only equal ones if neither has
    more than ``most`` others; only such sets give them."""
    classes, out = size_classes(percent), []
    own = bisect_left(classes, len(s))
    for i in (own, own + 1):
        most = 2 * classes[i] * (100 - percent) // (100 + percent)
        if most:  # else only equal sets
            part = ((s >> np.uint64(32)) * np.uint64(most + 1)) >> np.uint64(32)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sums, at = np.add.reduceat(s, starts), part[starts]
            if len(at) <= most:
                empty = np.setdiff1d(np.arange(most + 1, dtype=np.uint64), at)
                sums, at = np.r_[sums, np.zeros(len(empty), dtype=np.uint64)], np.r_[at, empty]
            out.append(mix(sums ^ mix(at + np.uint64((i + 1) << 44))))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Common elements of every pair of sets."""
    a, b = np.concatenate(x), np.concatenate(y)
    of_a, of_b = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    shared = np.intersect1d(a, b)
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    for lo in range(0, len(shared), COLUMNS):
        columns = shared[lo : lo + COLUMNS]
        sides = []
        for n, values, owner in ((len(x), a, of_a), (len(y), b, of_b)):
            at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
            hit = columns[at] == values
            side = np.zeros((n, len(columns)), dtype=np.float32)
            side[owner[hit], at[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def completed(crowded: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, of all pairs of crowded sets that are similar enough."""
    crowded = crowded.withColumnRenamed("node", "digest")
    placed = maybe_named(sets, crowded, "digest").join(crowded, "digest").join(roots.withColumnRenamed("node", "digest"), "digest")
    # Short names: sets that share one by chance are only compared in vain.
    placed = placed.select(F.xxhash64("digest").alias("node"), F.xxhash64("root").alias("top"), "digest", "root", "members")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for node, top, m in zip(b["node"], b["top"], b["members"]):
                yield pd.DataFrame({"key": part_keys(np.frombuffer(m, dtype=np.uint64), percent)}).assign(node=node, top=top)

    parts = materialize(placed.select("node", "top", "members").mapInPandas(keys, "key long, node long, top long"), "parts")
    of_several = parts.groupBy("key").agg(F.min("top").alias("least"), F.max("top").alias("most"), F.min("node").alias("first")).filter("least < most")
    meet = parts.join(of_several.select("key", "first"), "key").select("node", "first").distinct()
    hoods = components(meet, "node", "first").withColumnRenamed("root", "hood")
    found = placed.join(hoods, "node").withColumn("n", F.expr("length(members) div 8"))
    by_size = W.Window.partitionBy("hood").orderBy("n", "digest").rowsBetween(W.Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.greatest("n", F.lit(LEAST_COUNT))).over(by_size), F.lit(0))
    blocks = found.select("hood", "digest", "n", F.floor(before / BLOCK).alias("block"))
    blocks = materialize(blocks, "blocks")
    sizes = blocks.groupBy("hood", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    later = sizes.select("hood", F.col("block").alias("y"), F.col("least").alias("least_y"))
    grid = sizes.withColumnRenamed("block", "x").join(later, "hood").filter(f"x <= y AND 100 * most >= {percent} * least_y").select("hood", "x", "y")
    # A set is sent once for every block that its own one meets.
    of = blocks.join(found.select("digest", "root", "members"), "digest")
    left = of.join(grid.withColumn("block", F.col("x")), ["hood", "block"])
    right = of.join(grid.filter("x < y").withColumn("block", F.col("y")), ["hood", "block"])
    both = left.unionByName(right).select("hood", "x", "y", "block", "digest", "root", "members")

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        tops = {r: i for i, r in enumerate(sorted(set(b["root"])))}
        sides = []
        for block in (b["x"].iloc[0], b["y"].iloc[0]):
            rows = b[b["block"] == block]
            sides.append(([np.frombuffer(m, dtype=np.uint64) for m in rows["members"]], np.array([tops[r] for r in rows["root"]], dtype=np.int64)))
        (x, top_x), (y, top_y) = sides
        common = common_counts(x, y).astype(np.int64)
        n, m = np.array([len(s) for s in x])[:, None], np.array([len(s) for s in y])[None, :]
        i, j = np.nonzero((100 * common >= percent * (n + m - common)) & (top_x[:, None] != top_y[None, :]))
        pairs = np.unique(np.sort(np.stack([top_x[i], top_y[j]], axis=1), axis=1), axis=0)
        names = list(tops)
        return pd.DataFrame([(names[p], names[q]) for p, q in pairs.tolist()], columns=["a", "b"])

    return both.groupBy("hood", "x", "y").applyInPandas(compare, "a binary, b binary").distinct()


def near_duplicates(df: DataFrame, width: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept, for every row."""
    return grouped(df, width, percent, id_col, text_col).drop("mark", "root")


def grouped(df: DataFrame, width: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with mark, the xxhash64 of the row's text, and root, which names the texts that are
    linked (components of one id may be several); null for texts without words."""
    python_ready(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    trees = forest(percent)[0]
    sigs = materialize(signatures(docs, width, trees), "signatures")
    named = sigs.filter("doc_id IS NOT NULL AND n > 0")
    distinct = named.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "sig")).alias("one"))
    keys = F.explode(F.array(*[
        F.concat(F.unhex(F.lit(f"{t:02x}")), F.substring("one.sig", t * VALUES + 1, VALUES), F.substring("one.sig", trees * VALUES + 1, SKETCH)) for t in range(trees)
    ]))
    found = materialize(candidates(distinct.select("digest", F.col("one.n").alias("n"), keys.alias("key")), percent), "candidates")
    inner = found.filter("head IS NULL AND node IS NOT NULL").select("cluster", "node", "parent")
    every = materialize(inner.unionByName(seams(found, percent)).distinct(), "clusters")
    clusters, crowded = every.filter("cluster IS NOT NULL"), every.filter("cluster IS NULL").select("node")
    tree_links = clusters.filter("parent IS NOT NULL")
    nodes = every.select("node").distinct()
    sets = materialize(full_sets(docs, named.select("digest", "doc_id"), nodes.withColumnRenamed("node", "digest"), width), "sets")
    roots = nodes.select("node", F.col("node").alias("root"))
    checked = None
    # One candidate of every set first; others only where it didn't join their ends.
    ordered = lambda df: df.select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b")).distinct()
    first = ordered(tree_links.groupBy("node").agg(F.min("parent").alias("parent")))
    rounds = [
        lambda: first,
        lambda: apart(ordered(tree_links), roots).select("a", "b").join(checked.select("a", "b"), ["a", "b"], "left_anti"),
        lambda: reopened(clusters, checked.filter("NOT linked").select("a", "b"), roots, crowded),
    ]
    for pairs in rounds:
        now = materialize(confirm(pairs(), sets, percent), "checked")
        roots = joined(roots, now.filter("linked").select("a", "b"))
        checked = now if checked is None else checked.unionByName(now)
    if not crowded.isEmpty():
        roots = joined(roots, materialize(completed(crowded, sets, roots, percent), "completed"))
    # Components as the smallest document id of all sets in them; written, so that the last join can split a hot set.
    of_set = named.groupBy("digest").agg(F.min("doc_id").alias("least"))
    placed = of_set.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "least", F.coalesce("root", "digest").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = materialize(placed.join(ids, "root").select("digest", "component_id", "root"), "component-ids")
    out = sigs.select("doc_id", "mark", F.col("n").alias("n_shingles"), "digest").join(of_set, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "mark", "root")
