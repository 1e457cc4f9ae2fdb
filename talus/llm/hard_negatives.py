"""Hard negatives: rows of another label that score almost as high as a positive.

An anchor's positives are its best-scoring rows of the same label. For each of them the negatives wanted
are the best ones whose score lies in a window below the positive's own, ``low`` to ``high`` hundredths
of it. The windows of one anchor overlap, so they are not searched one by one: the positives' upper
limits, in descending order, cut the scores into disjoint slots, from just below one limit up to the next
one. A score falls into one slot, where only the best few can ever be asked for, whatever the window;
so blocks of rows and the combiners after them keep the best of each slot and drop the rest. Merging the
slots from the lowest limit upwards gives for each limit the best rows below it, and with the window's
lower limit cut off that is the answer.

All anchors meet all rows, in a grid of blocks: a group holds one block of rows and one block of anchors,
both of bounded size, whatever labels or equal vectors are frequent, and sends a bounded number of rows
per anchor and slot to the combiners. Nothing but counts reaches the driver.

Rows with a null label or id, and vectors that are null, empty, of another length than most, or hold null
or non-finite components take no part. Equal rows count once; an id with different rows counts by its
smallest one (label, then vector). Ties in a score go to the smaller id. An anchor without a positive, a
positive with a negative score (its window is empty), and a window without a row give no row. An empty
table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from talus.llm.vectors import inner, integer_vectors
from talus.sources.gold import materialize

#: Rows and anchors that meet in one task group, and scores held at once there.
ROW_BLOCK, ANCHOR_BLOCK, SCORES = 16_384, 4096, 4_000_000

FOUND = "anchor_id long, slot int, id long, score long"


def best(scores: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best wanted scores of each row; the first column wins a tie."""
    n = scores.shape[1]
    floor = np.iinfo(np.int64).min
    held = np.where(wanted, scores, floor)
    if n > k:
        least = np.partition(held, n - k, axis=1)[:, n - k]
        wanted = wanted & (held >= least[:, None])
    row, col = np.nonzero(wanted)
    order = np.lexsort((col, -held[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep]


def grid(anchors: DataFrame, rows: DataFrame, meet, more: str = "") -> DataFrame:
    """``meet(anchors, rows)`` for every pair of blocks. Rows come in the order of their ids."""
    # Two counts decide the number of blocks.
    n_rows, n_anchors = rows.count(), anchors.count()
    a_blocks, r_blocks = max(1, -(-n_anchors // ANCHOR_BLOCK)), max(1, -(-n_rows // ROW_BLOCK))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("a", part(a_blocks)).withColumn("r", every(r_blocks))
    right = rows.withColumn("r", part(r_blocks)).withColumn("a", every(a_blocks))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 4), dtype=np.int64)]
        if len(x) and len(y):
            y = y.sort_values("id", kind="stable")
            ids, labels, v = y["id"].to_numpy(), y["label"].to_numpy(), np.stack(y["v"].to_numpy())
            step = max(1, SCORES // len(y))
            for at in range(0, len(x), step):
                part = x.iloc[at : at + step]
                scores = inner(np.stack(part["v"].to_numpy()), v)
                for row, slot, col in meet(part, scores, labels, ids):
                    found.append(np.column_stack([part["id"].to_numpy()[row], np.full(len(row), slot), ids[col], scores[row, col]]))
        return pd.DataFrame(np.concatenate(found), columns=["anchor_id", "slot", "id", "score"])

    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInPandas(run, FOUND)


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor and slot; tasks keep k of each before they send them on."""
    order = W.Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)


def positives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """anchor_id, at, id, score: the k best other rows of the anchor's label."""

    def meet(part: pd.DataFrame, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        same = (part["label"].to_numpy()[:, None] == labels[None, :]) & (part["id"].to_numpy()[:, None] != ids[None, :])
        row, col = best(scores, same, k)
        yield row, 0, col

    return top(grid(anchors, rows, meet), k).select("anchor_id", "at", "id", "score")


def in_slots(anchors: DataFrame, rows: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """anchor_id, slot, id, score: the k best rows of other labels in each slot. ``anchors`` has the
    column ``scores``, its positives' distinct scores, none negative, in descending order."""

    def meet(part: pd.DataFrame, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        other = part["label"].to_numpy()[:, None] != labels[None, :]
        limits = part["scores"].tolist()
        least = np.array([low * x[-1] for x in limits])
        other &= 100 * scores >= least[:, None]
        for slot in range(max(map(len, limits))):
            # A slot an anchor lacks is empty: its upper limit lies below its lower one.
            upper = np.array([high * x[slot] if slot < len(x) else -1 for x in limits])
            under = np.array([high * x[slot + 1] if slot + 1 < len(x) else -1 for x in limits])
            row, col = best(scores, other & (100 * scores <= upper[:, None]) & (100 * scores > under[:, None]), k)
            yield row, slot, col

    return top(grid(anchors, rows, meet), k).select("anchor_id", "slot", "id", "score")


def merged(held: DataFrame, k: int, low: int) -> DataFrame:
    """Windows answered from the slots. ``held`` has one row per anchor: its positives (at, id, score)
    and the slots' rows (slot, id, score), at most k per slot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for anchor, own, kept in zip(b["anchor_id"], b["positives"], b["kept"]):
                own = sorted((p["at"], p["id"], p["score"]) for p in own)
                limits = sorted({s for _, _, s in own if s >= 0}, reverse=True)
                slots: list[list[tuple[int, int]]] = [[] for _ in limits]
                for x in kept if kept is not None else ():
                    slots[x["slot"]].append((-x["score"], x["id"]))
                below, running = {}, []
                for slot in range(len(limits) - 1, -1, -1):
                    running = (sorted(slots[slot]) + running)[:k]
                    below[limits[slot]] = running
                for _, positive, score in own:
                    inside = [(i, -s) for s, i in below.get(score, []) if -100 * s >= low * score]
                    out += [(anchor, positive, rank, i, score, s) for rank, (i, s) in enumerate(inside, 1)]
            yield pd.DataFrame(out, columns=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return held.mapInPandas(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def mine(
    df: DataFrame, is_anchor: Column, relabel: Column | None = None, scale: int = 256, n_positives: int = 5, k: int = 5, low: int = 80, high: int = 100,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """The first ``k`` hard negatives of every anchor and positive: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    A negative's score lies between ``low`` and ``high`` hundredths of the positive's. ``is_anchor`` and
    ``relabel`` are expressions over the columns id and label."""
    whole, _ = integer_vectors(df, scale, id_col, vec_col, label_col)
    rows = whole.filter("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")
    if relabel is not None:
        rows = rows.withColumn("label", relabel)
    rows = materialize(rows, "mining-rows")
    anchors = rows.filter(is_anchor)
    pairs = materialize(positives(anchors, rows, n_positives), "positives")
    # At most n_positives rows per anchor.
    own = pairs.groupBy("anchor_id").agg(F.collect_list(F.struct("at", "id", "score")).alias("positives"))
    limits = F.sort_array(F.array_distinct(F.filter(F.transform("positives", lambda p: p["score"]), lambda s: s >= 0)), asc=False)
    asked = anchors.join(own.select(F.col("anchor_id").alias("id"), limits.alias("scores")), "id").filter(F.size("scores") > 0)
    slots = in_slots(materialize(asked, "asked"), rows, k, low, high)
    # At most n_positives * k rows per anchor.
    kept = slots.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "id", "score")).alias("kept"))
    return merged(own.join(kept, "anchor_id"), k, low)
