"""Removal of every byte that lies in a string which also starts earlier, by longest previous factors.

A string of ``length`` bytes at some start is a copy if the same bytes start earlier in the corpus: in a
document of smaller id, or further ahead in the same one. All bytes of all copies go; what is judged is
the input, and matches never cross documents.

The longest previous factor of a start is the longest string that begins there and also begins earlier.
In suffix order the earlier start that shares most is the nearest one before or behind whose place in the
corpus is smaller, so two arrays of nearest smaller places give all factors (``previous_factors``), and a
start is a copy where its factor reaches ``length``.

Suffixes that can share ``length`` bytes are brought together first, without a row per byte. Each string
is named by the least hash among its short grams; neighbouring strings with the same least gram at the same
place (the first of equal ones) form a block, about one per 36 bytes at length 100 and of at most 168 bytes,
and equal strings always lie in blocks of the same gram, equally far from it. Then

- a block that equals an earlier one as a whole consists of copies; equal blocks are found by 128 bits of
  digest (gram and block), inside each task's chunk before anything is sent,
- blocks of a gram that only one block holds hold no copy,
- what is left, blocks that share a gram and differ, is sorted: whole grams go to one task, where the
  suffixes of many grams are put in order at once and their previous factors taken.

A gram that very many different blocks share (the border of a passage that many documents hold) is not
sorted in one task: its blocks are cut by how far strings begin before the gram, each piece is named by the
bytes that all strings of that range share, and what is equal or alone drops out; ranges are halved until
every name has at most ``MOST`` blocks, and a range of one distance ends it. The result is the same for
any ``MOST``.

Null and empty texts have no bytes. Rows that share an id count as one document; different texts under one
id are told apart by 31 bits of hash. Rows without an id count as one document behind all others. Texts of
any length are cut into slices that overlap. Repeated rows get the same result. An empty table gives an
empty result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import python_ready, take_over
from talus.sources.gold import materialize

#: Bytes hashed at once, bytes whose blocks are compared inside a task before they are sent, bytes sorted at once.
SLICE, CHUNK, SORTED = 1_000_000, 32_000_000, 2_000_000
#: Different blocks of a name that are sorted together.
MOST = 256

#: Multipliers of the hash: odd numbers with well mixed bits.
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

BLOCKS = "doc long, tag int, at int, n int, m int, h long, s long"
MARKS = "doc long, tag int, start int, end int"


def power_below(n: int) -> int:
    return 1 << (int(n).bit_length() - 1)


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = (x * _B + y) * _A
    z ^= z >> np.uint64(31)
    z *= _C
    z ^= z >> np.uint64(29)
    return z


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), first[1], ..."""
    return np.arange(count.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)


def blocks_of(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Blocks of the strings of several texts that lie one behind the other in ``buf``: the text
    (``part``), where the block begins in it (``at``), how many strings it has (``n``), how far behind
    its begin the gram stands (``m``), the hash of the gram and the block's digest (``h``, ``s``)."""
    gram, wide = power_below(length // 2), power_below(length)
    strings = length - gram + 1
    count = np.maximum(size - length + 1, 0)
    if not count.sum():
        return {c: np.zeros(0, np.int64) for c in ("part", "at", "n", "m", "h", "s")}
    long = np.concatenate([buf, np.zeros(3 * length, np.uint8)]).astype(np.uint64)
    cur, step, grams = mixed(long, long + np.uint64(7)), 1, None
    while step < wide:
        cur = mixed(cur[:-step], cur[step:])
        step *= 2
        if step == gram:
            grams = cur
    least, step = grams, 1
    while step * 2 <= strings:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < strings:
        least = np.minimum(least[: len(least) - (strings - step)], least[strings - step :])
    at, part = expand(begin, count), np.repeat(np.arange(len(size)), count)
    least, passed = least[at], grams[at] == least[at]
    # The gram of a string that begins with it is behind the next string.
    lead = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | passed[:-1] | (part[1:] != part[:-1])]))
    n = np.diff(np.append(lead, len(at)))
    lo, h = at[lead], least[lead]
    # Windows of ``wide`` bytes that cover the block, digested together with its size.
    windows = -(-(length + strings - 1 - wide) // wide) + 1
    s, spare = mixed(h, n.astype(np.uint64)), n - 1 + length - wide
    for w in range(windows):
        s = mixed(s, cur[lo + spare * w // max(1, windows - 1)])
    m = np.zeros(len(lo), np.int64)
    for a in range(0, len(lo), 8192):
        z = slice(a, a + 8192)
        m[z] = n[z] - 1 + (grams[(lo[z] + n[z] - 1)[:, None] + np.arange(strings)] == h[z, None]).argmax(1)
    return {"part": part[lead], "at": lo - begin[part[lead]], "n": n, "m": m, "h": h.view(np.int64), "s": s.view(np.int64)}


def merge(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Overlapping and touching spans of each text as one."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return pd.DataFrame({"doc": doc, "tag": tag, "start": start, "end": end})
    text = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]))
    # Texts are shifted apart, so that the running maximum of ends never reaches into the next one.
    apart = text * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + apart)
    new = np.flatnonzero(np.concatenate([[True], (start + apart)[1:] > reach[:-1]]))
    last = np.append(new[1:], len(doc)) - 1
    return pd.DataFrame({"doc": doc[new], "tag": tag[new], "start": start[new], "end": (reach - apart)[last]})


def named_blocks(length: int):
    """A function for mapInPandas over (doc, tag, text): the blocks of each chunk, each once, and as
    rows with negative n the spans whose blocks occur earlier in the chunk."""

    def chunk(rows: list[tuple[int, int, bytes]]) -> Iterator[pd.DataFrame]:
        docs, tags = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32)
        found, held, size, shift = [], [], 0, []

        def flush() -> None:
            nonlocal held, size, shift
            if held:
                sizes = np.array([len(b) for _, b in held])
                x = blocks_of(np.frombuffer(b"".join(b for _, b in held), np.uint8), np.cumsum(sizes) - sizes, sizes, length)
                row = np.array([i for i, _ in held])[x["part"]]
                found.append({"doc": docs[row], "tag": tags[row], "at": x["at"] + np.array(shift, np.int64)[x["part"]], **{c: x[c] for c in ("n", "m", "h", "s")}})
            held, size, shift = [], 0, []

        for i, (_, _, data) in enumerate(rows):
            for a in range(0, max(1, len(data) - length + 1), SLICE):
                piece = data[a : a + SLICE + length - 1]
                held.append((i, piece))
                shift.append(a)
                size += len(piece)
                if size >= SLICE:
                    flush()
        flush()
        if not found:
            return
        b = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
        key = mixed(b["h"].view(np.uint64), b["s"].view(np.uint64))
        order = np.lexsort((b["at"], b["doc"], key))
        b, key = {c: v[order] for c, v in b.items()}, key[order]
        group = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (b["h"][1:] != b["h"][:-1]) | (b["s"][1:] != b["s"][:-1])])) if len(key) else np.zeros(0, np.int64)
        lead = np.repeat(group, np.diff(np.append(group, len(key))))
        first = (b["doc"] == b["doc"][lead]) & (b["at"] == b["at"][lead])
        later = {c: v[~first] for c, v in b.items()}
        spans = merge(later["doc"], later["tag"], later["at"], later["at"] + later["n"] - 1 + length)
        kept = pd.DataFrame({c: v[first] for c, v in b.items()}).drop_duplicates(["doc", "tag", "at"]).sort_values(["doc", "at"])
        yield kept
        yield pd.DataFrame({"doc": spans["doc"], "tag": spans["tag"], "at": spans["start"], "n": spans["start"] - spans["end"], "m": 0, "h": 0, "s": 0})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_over("copies")
        held, size = [], 0
        for b in batches:
            for doc, tag, text in zip(b["doc"], b["tag"], b["text"]):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) >= length:
                    held.append((doc, tag, data))
                    size += len(data)
                    if size >= CHUNK:
                        yield from chunk(held)
                        held, size = [], 0
        yield from chunk(held)

    return run


def ranks(buf: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """For powers of two from 8 up to ``depth``: the rank of the string of that size at every place.
    Longer ranks come from pairs of shorter ones."""
    long = np.concatenate([buf, np.zeros(depth + 8, np.uint8)])
    word = np.zeros(len(buf) + depth, np.uint64)
    for j in range(8):
        word |= long[j : j + len(word)].astype(np.uint64) << np.uint64(8 * (7 - j))
    out, size, cur = {}, 8, np.unique(word, return_inverse=True)[1].astype(np.int32)
    out[8] = cur
    while size * 2 <= depth:
        pair = cur[:-size].astype(np.int64) * (len(cur) + 1) + cur[size:]
        cur = np.concatenate([np.unique(pair, return_inverse=True)[1].astype(np.int32), np.zeros(size, np.int32)])
        size *= 2
        out[size] = cur
    return out


def nearest_smaller(a: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a strictly smaller value, or -1. Between a place
    and its candidate all values are at least its own, so candidates can jump to their candidates'."""
    found, open_ = np.arange(len(a)) - 1, np.arange(len(a))
    while len(open_):
        at = found[open_]
        open_ = open_[(at >= 0) & (a[at] >= a[open_])]
        found[open_] = found[found[open_]]
    return found


def previous_factors(buf: np.ndarray, starts: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """For each start the length of the longest string that begins there and at a start of smaller
    ``place``, up to ``depth``. Every start has ``depth`` bytes before its text ends."""
    level = ranks(buf, depth)
    top = max(level)
    suffix = np.lexsort((place, level[top][starts + depth - top], level[top][starts]))
    here, order = starts[suffix], place[suffix]
    before = nearest_smaller(order)
    behind = len(order) - 1 - nearest_smaller(order[::-1])[::-1]
    long, best = np.concatenate([buf, np.zeros(depth, np.uint8)]), np.zeros(len(order), np.int64)
    for other in (before, behind):
        has = (other >= 0) & (other < len(order))
        a, b, off = here[has], here[other[has]], np.zeros(has.sum(), np.int64)
        for size in sorted(level, reverse=True):
            off += size * ((off + size <= depth) & (level[size][a + np.minimum(off, depth)] == level[size][b + np.minimum(off, depth)]))
        for _ in range(7):
            more = (off < depth) & (long[a + np.minimum(off, depth)] == long[b + np.minimum(off, depth)])
            off += more
        best[has] = np.maximum(best[has], off)
    out = np.zeros(len(order), np.int64)
    out[suffix] = best
    return out


def sorted_copies(length: int):
    """A function for mapInPandas over (h, doc, tag, at, block), rows of an h together: the spans whose
    previous factor reaches ``length``."""

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["block"].map(len).to_numpy(np.int64)
        buf = np.frombuffer(b"".join(rows["block"]), np.uint8)
        n, begin = size - length + 1, np.cumsum(size) - size
        starts, row = expand(begin, n), np.repeat(np.arange(len(rows)), n)
        doc, at = rows["doc"].to_numpy(np.int64)[row], rows["at"].to_numpy(np.int64)[row] + starts - begin[row]
        order = np.lexsort((at, doc))
        new = np.concatenate([[False], (np.diff(doc[order]) != 0) | (np.diff(at[order]) != 0)])
        place = np.zeros(len(order), np.int64)
        place[order] = np.cumsum(new)
        copy = previous_factors(buf, starts, place, length) >= length
        tag = rows["tag"].to_numpy(np.int32)[row]
        return merge(doc[copy], tag[copy], at[copy], at[copy] + length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            while len(b):
                if size >= SORTED:
                    # The name that the last rows have may go on.
                    go_on = (b["h"] == held[-1]["h"].iloc[-1]).to_numpy()
                    stop = len(b) if go_on.all() else int(np.argmin(go_on))
                    if stop:
                        held.append(b.iloc[:stop])
                        b = b.iloc[stop:]
                    if not len(b):
                        break
                    yield some(pd.concat(held, ignore_index=True))
                    held, size = [], 0
                held.append(b)
                size += int(b["block"].map(len).sum())
                b = b.iloc[:0]
        if held:
            yield some(pd.concat(held, ignore_index=True))

    return run


def place(doc: str = "doc", at: str = "at"):
    return F.struct(F.col(doc).alias("doc"), F.col(at).alias("at"))


def equal_blocks(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of blocks that are equal (by ``keys``, the first of them their name): the later ones, and the
    first ones that share their name with another block."""
    first = materialize(rows.groupBy(*keys).agg(F.min(place()).alias("first")), "first-blocks")
    together = materialize(first.groupBy(keys[0]).agg(F.count("*").alias("blocks")).filter("blocks > 1").select(keys[0]), "shared-names")
    met = rows.join(first, keys)
    return met.filter(place() > F.col("first")), met.filter(place() == F.col("first")).join(together, keys[0]).drop("first")


def cut(rows: DataFrame, length: int, size: int) -> DataFrame:
    """Blocks cut where the distance from a string's begin to the gram passes a multiple of ``size``; a
    piece is named by its old name, its range of distances and the bytes that all strings there share."""
    pieces = rows.withColumn("least", F.col("m") - F.length("block") + length).withColumn("i", F.explode(F.expr(f"sequence(cast(floor(least / {size}) as int), cast(floor(m / {size}) as int))")))
    pieces = pieces.withColumn("far", F.least(F.col("m"), (F.col("i") + 1) * size - 1)).withColumn("near", F.greatest("least", F.col("i") * size))
    shared = F.substring("block", F.col("m") - F.col("i") * size + 1, F.lit(length - size + 1))
    piece = F.substring("block", F.col("m") - F.col("far") + 1, F.col("far") - F.col("near") + length)
    return pieces.select(F.xxhash64("h", "i", shared).alias("h"), "doc", "tag", (F.col("at") + F.col("m") - F.col("far")).alias("at"), F.col("far").alias("m"), piece.alias("block"))


def whole_span(at: str, strings, length: int) -> list:
    return ["doc", "tag", F.col(at).alias("start"), (F.col(at) + strings + length - 1).cast("int").alias("end")]


def copies(docs: DataFrame, length: int) -> DataFrame:
    """(doc, tag, start, end): spans of copies; they may overlap. ``docs`` has doc, tag, text."""
    blocks = materialize(docs.filter("text IS NOT NULL").mapInPandas(named_blocks(length), BLOCKS), "blocks")
    marks = [blocks.filter("n < 0").select("doc", "tag", F.col("at").alias("start"), (F.col("at") - F.col("n")).alias("end"))]
    there = blocks.filter("n > 0")
    names = materialize(there.groupBy("h").count().filter("count > 1").select("h"), "names")
    shared = materialize(there.join(names, "h"), "named-blocks")
    later, left = equal_blocks(shared, ["h", "s"])
    marks.append(later.select(*whole_span("at", F.col("n"), length)))
    asked = left.groupBy("doc", "tag").agg(F.collect_list(F.struct("h", "at", "n", "m")).alias("asked"))

    @F.pandas_udf("array<struct<h:long,at:int,m:int,block:binary>>")
    def read(z: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for data, wanted in zip(z, asked):
            data = zstandard.ZstdDecompressor().decompress(data)
            out.append([{"h": x["h"], "at": x["at"], "m": x["m"], "block": data[x["at"] : x["at"] + x["n"] - 1 + length]} for x in wanted])
        return pd.Series(out)

    rows = packed(docs).select("doc", "tag", "z").join(asked, ["doc", "tag"]).select("doc", "tag", F.explode(read("z", "asked")).alias("x")).select("doc", "tag", "x.*")
    rows = materialize(rows.select("h", "doc", "tag", "at", "m", "block"), "blocks-to-sort")
    to_sort, size = [], power_below(length - power_below(length // 2)) // 2
    while True:
        crowded = materialize(rows.groupBy("h").count().filter(F.col("count") > MOST).select("h"), "crowded")
        if crowded.isEmpty():
            to_sort.append(rows)
            break
        to_sort.append(rows.join(crowded, "h", "left_anti"))
        pieces = materialize(cut(rows.join(crowded, "h"), length, size), "pieces")
        later, left = equal_blocks(pieces, ["h", "block"])
        marks.append(later.select(*whole_span("at", F.length("block") - length + 1, length)))
        size = max(1, size // 2)
        rows = materialize(left.select("h", "doc", "tag", "at", "m", "block"), "blocks-to-sort")
    together = to_sort[0]
    for x in to_sort[1:]:
        together = together.unionByName(x)
    found = together.select("h", "doc", "tag", "at", "block").repartition("h").sortWithinPartitions("h").mapInPandas(sorted_copies(length), MARKS)
    for x in marks:
        found = found.unionByName(x)
    return found


def packed(docs: DataFrame) -> DataFrame:
    """The texts' bytes compressed, as they are sent to other tasks; null counts as empty."""

    @F.pandas_udf("binary")
    def z(texts: pd.Series) -> pd.Series:
        c = zstandard.ZstdCompressor(level=3)
        return pd.Series([c.compress(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"") for t in texts])

    return docs.withColumn("z", z("text")).drop("text")


def remove_copies(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the bytes it had (n_bytes), the removed spans (byte offsets, maximal, in order) and
    the bytes that are left (kept)."""
    if length < 16:
        raise ValueError("strings of 16 bytes or more")
    python_ready(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("doc", F.coalesce("id", F.lit(2**63 - 1))).withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit(2**31 - 1)).cast("int"))
    spans = copies(docs.select("doc", "tag", "text"), length)
    # At most the spans of one document each.
    per_doc = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    @F.pandas_udf("n_bytes long, flat array<int>, kept binary")
    def rest(z: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for data, own in zip(z, spans):
            data = zstandard.ZstdDecompressor().decompress(data)
            flat, kept, at = [], [], 0
            if own is not None and len(own):
                for start, end in sorted((x["start"], x["end"]) for x in own):
                    if flat and start <= flat[-1]:
                        flat[-1] = max(flat[-1], end)
                    else:
                        flat += [start, end]
                for start, end in zip(flat[::2], flat[1::2]):
                    kept.append(data[at:start])
                    at = end
            out.append((len(data), flat, b"".join([*kept, data[at:]])))
        return pd.DataFrame(out, columns=["n_bytes", "flat", "kept"])

    pairs = F.expr("CASE WHEN size(x.flat) > 0 THEN transform(sequence(0, size(x.flat) - 1, 2), i -> struct(x.flat[i] AS start, x.flat[i + 1] AS end)) ELSE array() END")
    joined = packed(docs).join(per_doc, ["doc", "tag"], "left").select(F.col("id").alias(id_col), rest("z", "spans").alias("x"))
    return joined.select(id_col, F.col("x.n_bytes").alias("n_bytes"), pairs.alias("removed"), F.col("x.kept").alias("kept"))


def digests(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: bytes, removed bytes, removed spans and the SHA-256 of what is left."""
    found = remove_copies(df, length, id_col, text_col)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(F.col(id_col), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
