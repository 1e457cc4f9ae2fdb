"""Approximate nearest neighbours over balanced posting lists.

Centroids come from halving a bounded sample again and again, each half of equal size, so lists are
balanced; they are many and their lists short. A vector is put into the lists of its nearest centroid and
of all others almost as near (within ``CLOSURE``, ``REPLICAS`` at most), so one at a border is found from
several sides. Centroids are few enough for every task's memory and are searched by best-first steps over
a graph of their neighbours, for the vectors as for the queries.

A query reads its nearest list and those whose distance is at most a ratio of that of its ``YARDSTICK``-th nearest one. The
ratio is measured: for ``TRIALS`` vectors, half of them held back from the fit, the exact neighbours among
all rows are found, and the ratio is the least that reaches lists with ``RECALL`` of them, for the fitted
and for the held-back ones. Neighbouring lists lie together in a group, which a task holds as a whole, and
a query gets k rows of a group, not of a list. Each query first reads the lists of the group it lies in;
in the others it reads with the k-th distance found there as a bound: lists that lie wholly beyond it are
skipped, and only rows within it are returned. A query that finds fewer than k rows reads all lists.

Every row is indexed. Equal vectors are one entry with its smallest ids: more than k + 1 of them can't
be among k neighbours, since ties go to smaller ids. Vectors and queries of a group are cut into blocks of
bounded size that meet in a cogroup; distances are computed there in double precision on the original
vectors.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, as rows without an id. An id with several vectors counts by its nearest one; equal rows count
once. With k candidates or fewer all are returned. An empty table gives an empty result; other columns
are ignored."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from talus.llm.common import python_ready
from talus.sources.gold import materialize

#: Vectors the centroids are fitted on, and the number of centroids, at most. Vectors per list aimed at.
SAMPLE, MOST_LISTS, PER_LIST = 16_384, 4096, 5
#: Lists a vector is put into at most, and how much farther than the nearest they may be.
REPLICAS, CLOSURE = 8, 1.3
#: The list whose distance a query's ratio refers to: that of the nearest ones says too much about the sample.
YARDSTICK = 64
#: Vectors that the ratio is measured with, and the share of their neighbours it must reach: above the 0.9
#: asked for by more than the error of the measurement.
TRIALS, RECALL = 512, 0.95
#: Neighbours per centroid in the graph; entry points of a search.
DEGREE, ENTRIES = 24, 64
#: Groups of lists at least, and the vectors of a group aimed at where there are more.
GROUPS, PER_GROUP = 16, 32_768
#: A row's lists in one group, and their distances.
GROUPED = "group int, lists array<int>, far array<double>"
#: Vectors of a group, and queries, that meet in one task.
BLOCK, QUERY_BLOCK = 65_536, 1024


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, for choosing lists; results use exact differences."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def halves(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Row numbers of ``parts`` parts of equal size, each halved along the line between two centres."""
    rng = np.random.default_rng(0)
    # Largest first; the number breaks ties.
    heap, n = [(-len(x), 0, np.arange(len(x)))], 0
    while len(heap) < parts and -heap[0][0] >= 2:
        own = heapq.heappop(heap)[2]
        two = x[own[rng.choice(len(own), 2, replace=False)]]
        for _ in range(6):
            lead = ((x[own] - two[0]) ** 2).sum(1) - ((x[own] - two[1]) ** 2).sum(1)
            order = np.argsort(lead, kind="stable")
            near, far = own[order[: len(own) // 2]], own[order[len(own) // 2 :]]
            two = np.array([x[near].mean(0), x[far].mean(0)])
        for half in (near, far):
            n += 1
            heapq.heappush(heap, (-len(half), n, half))
    return [p for _, _, p in sorted(heap, key=lambda h: h[1])]


@dataclass
class Centroids:
    points: np.ndarray
    neighbours: np.ndarray = field(repr=False)
    entries: np.ndarray
    #: Group of every list.
    group: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, groups: int = GROUPS) -> Centroids:
        points = np.array([x[p].mean(0) for p in halves(x, lists)])
        group = np.zeros(len(points), dtype=np.int64)
        for g, own in enumerate(halves(points, groups)):
            group[own] = g
        degree = min(DEGREE, len(points) - 1)
        near = np.zeros((len(points), degree), dtype=np.int64)
        for lo in range(0, len(points), 512):
            d = distances(points[lo : lo + 512], points)
            d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
            near[lo : lo + 512] = np.argsort(d, axis=1, kind="stable")[:, :degree]
        # Entry points far from each other, so that every region is reached.
        entries, far = [0], distances(points, points[:1])[:, 0]
        while len(entries) < min(ENTRIES, len(points)):
            entries.append(int(far.argmax()))
            far = np.minimum(far, distances(points, points[entries[-1:]])[:, 0])
        return cls(points, near, np.array(entries), group)

    def nearest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``n`` nearest centroids found for each row, nearest first."""
        n = min(n, len(self.points))
        ids, dist = np.zeros((len(x), n), dtype=np.int64), np.zeros((len(x), n))
        for lo in range(0, len(x), 256):
            ids[lo : lo + 256], dist[lo : lo + 256] = self._nearest(x[lo : lo + 256], n)
        return ids, dist

    def _nearest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(x))[:, None]
        width = max(n, len(self.entries))
        beam = np.full((len(x), width), -1)
        dist = np.full((len(x), width), np.inf)
        beam[:, : len(self.entries)] = self.entries
        dist[:, : len(self.entries)] = distances(x, self.points[self.entries])
        seen = np.zeros((len(x), len(self.points)), dtype=bool)
        seen[:, self.entries] = True
        opened = np.zeros(beam.shape, dtype=bool)
        order = np.argsort(dist, axis=1, kind="stable")
        beam, dist, opened = beam[rows, order], dist[rows, order], opened[rows, order]
        while True:
            # Open the nearest unopened centroids among the best n of every row, more at once in wide searches.
            waiting = ~opened[:, :n] & (beam[:, :n] >= 0)
            active = np.flatnonzero(waiting.any(axis=1))
            if not len(active):
                return beam[:, :n], dist[:, :n]
            pick = np.argsort(~waiting[active], axis=1, kind="stable")[:, : max(4, n // 16)]
            real = waiting[active[:, None], pick]
            opened[active[:, None], pick] |= real
            found = self.neighbours[np.where(real, beam[active[:, None], pick], 0)].reshape(len(active), -1)
            new = ~seen[active[:, None], found] & np.repeat(real, self.neighbours.shape[1], axis=1)
            seen[active[:, None], np.where(new, found, self.entries[0])] = True
            # A centroid met twice in this step counts once.
            first = np.sort(np.where(new, found, -1), axis=1)
            first[:, 1:][first[:, 1:] == first[:, :-1]] = -1
            gap = self.points[np.maximum(first, 0)] - x[active][:, None, :]
            d = np.where(first >= 0, np.sqrt((gap * gap).sum(2)), np.inf)
            all_ids = np.concatenate([beam[active], first], axis=1)
            all_d = np.concatenate([dist[active], d], axis=1)
            all_open = np.concatenate([opened[active], np.zeros(first.shape, dtype=bool)], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            at = np.arange(len(active))[:, None]
            beam[active], dist[active], opened[active] = all_ids[at, order], all_d[at, order], all_open[at, order]

    def grouped(self, lists: list[np.ndarray], far: list[np.ndarray]) -> tuple[np.ndarray, dict[str, object]]:
        """Per row and group: the row's number, and the columns of ``GROUPED``."""
        row = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
        own, dist = np.concatenate(lists), np.concatenate(far)
        order = np.lexsort((self.group[own], row))
        row, own, dist = row[order], own[order], dist[order]
        group = self.group[own]
        start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])])
        return row[start], {"group": group[start], "lists": np.split(own, start[1:]), "far": np.split(dist, start[1:])}

    def closure(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The lists of every vector and their distances: the nearest one and others almost as near."""
        ids, dist = self.nearest(x, 2 * REPLICAS)
        near = dist[:, :REPLICAS] <= CLOSURE * dist[:, :1]
        return [i[:REPLICAS][n] for i, n in zip(ids, near)], [d[:REPLICAS][n] for d, n in zip(dist, near)]

    def probes(self, x: np.ndarray, ratio: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The lists of every query within ``ratio`` and their distances, nearest first."""
        lists, far = [None] * len(x), [None] * len(x)
        todo, n = np.arange(len(x)), min(2 * YARDSTICK, len(self.points))
        while len(todo):
            ids, dist = self.nearest(x[todo], n)
            limit = np.maximum(ratio * dist[:, min(YARDSTICK, n) - 1], dist[:, 0])
            # Where all that were found lie within the ratio, there may be more.
            open_ = (dist[:, -1] <= limit) & (n < len(self.points))
            for i, own, d, most in zip(todo[~open_], ids[~open_], dist[~open_], limit[~open_]):
                within = d <= most
                lists[i], far[i] = own[within], d[within]
            todo, n = todo[open_], min(2 * n, len(self.points))
        return lists, far


def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    centroids: Broadcast
    #: group, v, ids, lists: a vector with its lists of one group
    postings: DataFrame
    #: Distance of each list's centre to its farthest vector.
    radius: np.ndarray
    #: Queries' vectors must have this many components.
    length: int
    k: int
    #: How far the lists that a query reads may lie.
    ratio: float


def entries(df: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[DataFrame, int]:
    """Distinct vectors with their k + 1 smallest ids, and the vectors' length."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & valid(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if sizes is None:
        return rows.select("v", F.array("id").alias("ids")).limit(0), 0
    lowest = W.Window.partitionBy("v").orderBy("id")
    few = rows.filter(F.size("v") == sizes["n"]).withColumn("at", F.dense_rank().over(lowest)).filter(F.col("at") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")), sizes["n"]


def neighbours(distinct: DataFrame, x: np.ndarray, k: int) -> DataFrame:
    """trial, v, d: the k nearest of all vectors for every row of ``x``, equal vectors left out."""
    shared = distinct.sparkSession.sparkContext.broadcast(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for b in batches:
            v = np.stack(b["v"])
            d = distances(shared.value, v)
            i, j = np.nonzero(shared.value[:, :1] == v[None, :, 0])
            same = (shared.value[i] == v[j]).all(axis=1)
            d[i[same], j[same]] = np.inf
            both = (d, np.broadcast_to(np.arange(len(v)), d.shape), v)
            if best is not None:
                both = (np.hstack([best[0], d]), np.hstack([best[1], both[1] + len(best[2])]), np.vstack([best[2], v]))
            order = np.argsort(both[0], axis=1, kind="stable")[:, :k]
            at = np.take_along_axis(both[1], order, axis=1)
            used, place = np.unique(at, return_inverse=True)
            best = (np.take_along_axis(both[0], order, axis=1), place.reshape(at.shape), both[2][used])
        if best is not None:
            trial, rank = np.nonzero(np.isfinite(best[0]))
            yield pd.DataFrame({"trial": trial, "v": list(best[2][best[1][trial, rank]]), "d": best[0][trial, rank]})

    found = distinct.select("v").mapInPandas(run, "trial int, v array<double>, d double")
    order = W.Window.partitionBy("trial").orderBy("d", "v")
    return found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).select("trial", "v")


def ratio_needed(model: Centroids, postings: DataFrame, distinct: DataFrame, x: np.ndarray, k: int) -> float:
    """The least ratio that reaches a list with ``RECALL`` of the exact neighbours, for each half of ``x``."""
    # At most TRIALS * k neighbours with REPLICAS lists each.
    rows = neighbours(distinct, x, k).join(postings.select("v", F.explode("lists").alias("list")), "v")
    held = rows.groupBy("trial", "v").agg(F.collect_list("list").alias("lists")).select("trial", "lists").collect()
    d = distances(x, model.points)
    base = np.sort(d, axis=1)[:, min(YARDSTICK, len(model.points)) - 1]
    need = []
    for half in (0, 1):
        found = np.sort([d[r.trial, r.lists].min() / max(base[r.trial], 1e-300) for r in held if r.trial % 2 == half])
        need.append(found[int(np.ceil(RECALL * len(found))) - 1] if len(found) else 1.0)
    return float(max(need)) * (1 + 1e-9)


def build(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10) -> Index:
    spark = df.sparkSession
    python_ready(spark)
    distinct, length = entries(df, id_col, vec_col, k)
    distinct = materialize(distinct, "vectors")
    total = distinct.count()
    sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow().column("v").to_pylist()
    x = np.array(sample, dtype=np.float64).reshape(len(sample), length)
    # Half of the trials are not fitted on, save in tables of a few rows.
    back = min(TRIALS // 2, len(x) // 5)
    fitted = x[: len(x) - back]
    lists = int(min(MOST_LISTS, max(1, total // PER_LIST), max(1, len(fitted) // 4)))
    model = Centroids.fit(fitted, lists, max(GROUPS, -(-total // PER_GROUP))) if len(x) else None
    if model is None:
        postings = distinct.withColumns({"group": F.lit(0), "lists": F.array(F.lit(0)), "far": F.array(F.lit(0.0))})
        return Index(spark.sparkContext.broadcast(None), postings, np.zeros(1), length, k, 0.0)
    lists = len(model.points)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, parts = shared.value.grouped(*shared.value.closure(np.stack(b["v"])))
            yield pd.DataFrame({"v": list(b["v"].to_numpy()[row]), "ids": list(b["ids"].to_numpy()[row]), **parts})

    postings = materialize(distinct.mapInPandas(run, f"v array<double>, ids array<long>, {GROUPED}"), "postings")
    radius = np.zeros(lists)
    # A row per list.
    for r in postings.select(F.explode(F.arrays_zip("lists", "far")).alias("p")).groupBy("p.lists").agg(F.max("p.far").alias("far")).collect():
        radius[r.lists] = r.far
    # Fitted and held-back vectors in turn.
    trials = np.stack([x[:back], x[len(x) - back :]], axis=1).reshape(2 * back, length)
    ratio = ratio_needed(model, postings, distinct, trials if back else x, k)
    return Index(shared, postings, radius, length, k, ratio)


def search(index: Index, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for every query but itself."""
    k = index.k
    rows = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("q"))
    rows = rows.filter(F.col("query_id").isNotNull() & valid(F.col("q")) & (F.size("q") == index.length)).distinct()
    found = materialize(read(index, rows, index.ratio), "found")
    # Where k rows were not found though lists are left, all are read.
    short = rows.join(found.groupBy("query_id").count().filter(F.col("count") >= k), "query_id", "left_anti")
    if index.ratio and not short.isEmpty():
        found = found.join(short, "query_id", "left_anti").unionByName(read(index, short, float("inf")))
    order = W.Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")


def read(index: Index, rows: DataFrame, ratio: float) -> DataFrame:
    """query_id, vec_id, score: the k nearest rows in the lists within ``ratio`` of every query."""
    shared, radius, k = index.centroids, index.radius, index.k

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists, far = shared.value.probes(np.stack(b["q"]), ratio)
            row, parts = shared.value.grouped(lists, far)
            home = shared.value.group[[own[0] for own in lists]]
            yield pd.DataFrame({"query_id": b["query_id"].to_numpy()[row], "q": list(b["q"].to_numpy()[row]), **parts, "home": parts["group"] == home[row]})

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # A little more than the bound, as centre distances are rounded.
            within = [np.asarray(f) - radius[np.asarray(own)] <= most * (1 + 1e-6) + 1e-9 for own, f, most in zip(b["lists"], b["far"], b["bound"])]
            b["lists"] = [np.asarray(own)[w] for own, w in zip(b["lists"], within)]
            yield b[[w.any() for w in within]]

    asked = materialize(rows.mapInPandas(probe, f"query_id long, q array<double>, {GROUPED}, home boolean"), "probes")
    near = materialize(best(meeting(index, asked.filter("home").withColumn("bound", F.lit(float("inf")))), k), "near")
    bound = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("bound"))
    rest = asked.filter("NOT home").join(bound, "query_id", "left").fillna(float("inf"), ["bound"])
    columns = f"query_id long, q array<double>, {GROUPED}, bound double"
    rest = materialize(rest.select("query_id", "q", "group", "lists", "far", "bound").mapInPandas(narrow, columns), "probes")
    return best(near.unionByName(meeting(index, rest)), k)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of every query, each once."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "vec_id", "score")


def meeting(index: Index, asked: DataFrame) -> DataFrame:
    """query_id, vec_id, score: at most k rows per query and block of a group, none beyond the query's bound."""
    k = index.k
    # A row per group: how many blocks its vectors and its queries make.
    per_group = index.postings.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    queries = asked.groupBy("group").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    grid = F.broadcast(per_group.join(queries, "group"))
    part = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.postings.join(grid, "group").select("group", part("v", "blocks").alias("a"), "query_blocks", "v", "ids", "lists")
    left = left.select("group", "a", each("query_blocks").alias("b"), "v", "ids", "lists")
    right = asked.join(grid, "group").select("group", part("query_id", "query_blocks").alias("b"), "blocks", "query_id", "q", "lists", "bound")
    right = right.select("group", each("blocks").alias("a"), "b", "query_id", "q", F.col("lists").alias("wanted"), "bound")

    def meet(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(queries):
            x, ids = np.stack(block["v"]), list(block["ids"])
            rows = np.repeat(np.arange(len(x)), [len(own) for own in block["lists"]])
            lists = np.concatenate(list(block["lists"]))
            order = np.argsort(lists, kind="stable")
            rows, lists = rows[order], lists[order]
            for query, q, wanted, most in zip(queries["query_id"], queries["q"], queries["wanted"], queries["bound"]):
                lo, hi = np.searchsorted(lists, wanted, "left"), np.searchsorted(lists, wanted, "right")
                own = np.unique(np.concatenate([rows[i:j] for i, j in zip(lo, hi)]))
                d = np.sqrt(((x[own] - q) ** 2).sum(axis=1))
                if len(d) > k:
                    most = min(most, np.partition(d, k)[k])
                near = [(d[i], v) for i in np.flatnonzero(d <= most) for v in ids[own[i]] if v != query]
                out += [(query, v, s) for s, v in sorted(near)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return left.groupBy("group", "a", "b").cogroup(right.groupBy("group", "a", "b")).applyInPandas(meet, "query_id long, vec_id long, score double")
