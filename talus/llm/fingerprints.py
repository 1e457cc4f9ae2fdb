"""Document fingerprints by content-defined chunking.

A gear hash over the bytes of a text marks places that depend on the last 32 bytes alone, so an edit
moves only the boundaries near it. Chunks end at marked places with normalised lengths: none ends before
``LEAST`` bytes, a strict mask holds up to ``NORMAL`` bytes, a loose one after it, and ``MOST`` ends a
chunk in any case. A fingerprint is the set of chunk digests, each with its length; likeness is
containment, the share of a text's bytes (chunk by chunk) whose digests the other fingerprint holds.

Null text counts as empty; the fingerprint of the empty text is the empty string, which is contained in
the empty one only. Rows are followed by the next one in descending order of (doc_id, text), rows
without an id last; after the last row comes the first. Repeated rows follow each other. A single row
is its own successor. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from talus.llm.common import python_ready, slices

LEAST, NORMAL, MOST = 24, 64, 256
#: Marked bits: one place in 128 up to NORMAL bytes, one in 32 after it.
STRICT, LOOSE = np.uint32(0b1111111 << 25), np.uint32(0b11111 << 25)
WINDOW = 32
#: Bytes of a digest and of a length in a fingerprint.
DIGEST, LENGTH = 6, 2
#: Id ranges per shuffle partition; their heads are all that is gathered.
RANGES = 4


@functools.cache
def gear() -> np.ndarray:
    """A random number per byte value; 0 for the padding between texts."""
    draw = [xxhash.xxh64_intdigest(bytes([b]), seed=11) & 0xFFFFFFFF for b in range(256)]
    return np.array([*draw, 0], dtype=np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each place the sum of gear values of the last 32 bytes, each shifted by its distance."""
    h, reach = gear()[data], 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def boundaries(texts: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of every text."""
    pad = np.full(WINDOW, 256, dtype=np.uint16)
    parts = [x for t in texts for x in (np.frombuffer(t, dtype=np.uint8).astype(np.uint16), pad)]
    h = gear_hash(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = (h[loose] & STRICT) == 0
    out, begin = [], 0
    for t in texts:
        lo, hi = np.searchsorted(loose, [begin, begin + len(t)])
        marks, hard = (loose[lo:hi] - begin + 1).tolist(), strict[lo:hi].tolist()
        ends, start, i = [], 0, 0
        while len(t) - start > LEAST:
            while i < len(marks) and (marks[i] - start < LEAST or (marks[i] - start < NORMAL and not hard[i])):
                i += 1
            end = min(marks[i] if i < len(marks) else len(t), start + MOST, len(t))
            ends.append(end)
            start = end
        if start < len(t):
            ends.append(len(t))
        out.append(ends)
        begin += len(t) + WINDOW
    return out


def fingerprints(texts: list[bytes]) -> list[dict[bytes, int]]:
    """Digest and bytes of every distinct chunk."""
    out = []
    for t, ends in zip(texts, boundaries(texts)):
        start, chunks = 0, {}
        for end in ends:
            chunk = t[start:end]
            chunks[xxhash.xxh3_128_digest(chunk)[:DIGEST]] = len(chunk)
            start = end
        out.append(chunks)
    return out


def written(chunks: dict[bytes, int]) -> str:
    """A fingerprint as text: digests in order, each with its length."""
    return base64.b64encode(b"".join(d + n.to_bytes(LENGTH, "big") for d, n in sorted(chunks.items()))).decode()


def read(fingerprint: str) -> dict[bytes, int]:
    raw, step = base64.b64decode(fingerprint), DIGEST + LENGTH
    return {raw[i : i + DIGEST]: int.from_bytes(raw[i + DIGEST : i + step], "big") for i in range(0, len(raw), step)}


def containment(of: dict[bytes, int], within: dict[bytes, int]) -> float:
    """The share of the first fingerprint's bytes whose chunks the second one has."""
    total = sum(of.values())
    return sum(n for d, n in of.items() if d in within) / total if total else float(not within)


def edit(text: str, following: str) -> str:
    """The last half replaced by the beginning of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def successors(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in ranges of descending ids, each range closed by a copy of the first row of the next one.

    Ranges are cut at quantiles of the ids, and only their largest ids are gathered: RANGES rows per
    shuffle partition. Texts cross the network once, and no range needs another one."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = RANGES * parts
    cuts = np.array(sorted({int(x) for x in docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}), dtype=np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        below = len(cuts) - np.searchsorted(cuts, ids.fillna(0).to_numpy(dtype=np.int64), side="left")
        return pd.Series(np.where(ids.isna(), len(cuts), below), dtype="int32")

    docs = docs.withColumn("part", part("doc_id"))
    order = W.Window.orderBy("part")
    tops = docs.select("part", "doc_id").groupBy("part").agg(F.max("doc_id").alias("top"))
    tops = tops.select("part", "top", F.coalesce(F.lag("part").over(order), F.max("part").over(W.Window.partitionBy())).alias("before"))
    # At most n + 1 rows.
    docs = docs.join(F.broadcast(tops), "part")
    own = F.struct("part", F.lit(False).alias("lent"))
    lent = F.struct(F.col("before").alias("part"), F.lit(True).alias("lent"))
    places = F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(own, lent)).otherwise(F.array(own))).alias("p")
    return (
        docs.select("doc_id", "text", places).select("doc_id", "text", "p.*").repartition(parts, "part")
        .sortWithinPartitions("part", "lent", F.col("doc_id").desc_nulls_last(), "text")
    )


def compare(rows: list[tuple], nexts: list[tuple]) -> pd.DataFrame:
    """Result rows; a row and its successor are (doc_id, text, chunks)."""
    edited = [edit(r[1], x[1]).encode("utf-8", "replace") for r, x in zip(rows, nexts)]
    prints = fingerprints(edited)
    return pd.DataFrame({
        "doc_id": pd.Series([r[0] for r in rows], dtype="Int64"),
        "n_chars": [len(r[1]) for r in rows],
        "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
        "fingerprint": [written(r[2]) for r in rows],
        "edited_fingerprint": [written(p) for p in prints],
        "near_edited": [containment(r[2], p) for r, p in zip(rows, prints)],
        "near_next": [containment(r[2], x[2]) for r, x in zip(rows, nexts)],
    })


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to it."""
    python_ready(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # (part, lent, (doc_id, text, chunks)) of the row before
        for b in batches:
            ids = [None if pd.isna(x) else int(x) for x in b["doc_id"]]
            for lo, hi in slices(list(b["text"])):
                texts = list(b["text"])[lo:hi]
                prints = fingerprints([t.encode("utf-8", "replace") for t in texts])
                rows = list(zip(b["part"][lo:hi], b["lent"][lo:hi], zip(ids[lo:hi], texts, prints)))
                rows = ([last] if last else []) + rows
                pairs = [(x[2], y[2]) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and not x[1]]
                if pairs:
                    yield compare([x for x, _ in pairs], [y for _, y in pairs])
                last = rows[-1]

    return successors(df, id_col, text_col).mapInPandas(run, RESULT)
