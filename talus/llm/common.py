"""What the operators share: batches of bounded size, a bounded memo for text chunks, chunk splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator
from typing import ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from talus.session import ship

#: Rows a Python worker gets at once. Texts differ in length by a factor of thousands, so this stays small.
ROWS_PER_BATCH = 256
#: Characters that are split into chunks at once inside a task.
CHARS_PER_SLICE = 1_000_000
#: Entries a memo holds before it starts again; about 200 bytes each.
MEMO_ENTRIES = 300_000


def python_ready(spark: SparkSession) -> None:
    """Workers can import this package, and Arrow batches stay small whatever the length of the texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column) -> list[str]:
    """A pandas column as strings; null and NaN count as empty."""
    return [x if isinstance(x, str) else "" for x in column]


def slices(texts: list[str], limit: int = CHARS_PER_SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with at most ``limit`` characters, or one long text alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


#: Bits of one bitmap, as Spark's bitmap functions have them, and of all that ``maybe_named`` sends out (4 MB).
BITMAP, NAMED_BITS = 32_768, 2**25


def maybe_named(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` stands in ``names``, and few others, before they are exchanged for an exact join.

    The names are marked by their hash in bitmaps that every task gets; their size is fixed, so for very
    many names more of the other rows pass."""
    at = F.pmod(F.xxhash64(key), F.lit(NAMED_BITS))
    bits = names.select(at.alias("at")).groupBy(F.floor(F.col("at") / BITMAP).alias("map")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bits"))
    met = rows.withColumns({"at": at % BITMAP, "map": F.floor(at / BITMAP)}).join(F.broadcast(bits), "map")
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("at") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return met.filter(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.col("at") % 8).cast("int") + 1)) != 0).select(*rows.columns)


#: What a worker's memory holds for one operator, as functions that let it go.
_HELD: dict[str, list[Callable[[], None]]] = {}
_OWNER: list[str] = [""]


def held_by(owner: str, let_go: Callable[[], None]) -> None:
    """``let_go`` is called when another operator begins in the worker."""
    _HELD.setdefault(owner, []).append(let_go)


def take_over(owner: str) -> None:
    """Workers outlive stages. When another operator than before begins in one, the models, tokenizers
    and memos of all others are dropped, and the memory they leave goes back to the system."""
    if _OWNER[0] == owner:
        return
    before, _OWNER[0] = _OWNER[0], owner
    for name, functions in _HELD.items():
        if name != owner:
            for f in functions:
                f()
    for m in [m for m in Memo.all if m.owner != owner]:
        m.forget()
    if before:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


class Memo:
    """Results per distinct chunk, computed in batches and kept for the next batches of the worker.

    It has two generations of ``entries / 2``: when the young one is full it becomes the old one, and
    what is asked for again is taken over from there. Common chunks thus stay, rare ones go, and a
    worker's memory is bounded however many chunks there are; a long chunk counts as several. Workers
    outlive stages: ``take_over`` empties the memos of the operators before."""

    all: ClassVar[list[Memo]] = []

    def __init__(self, owner: str, compute: Callable[[list[str]], list], entries: int = MEMO_ENTRIES):
        self.owner, self.compute, self.entries = owner, compute, entries
        self.known, self.old, self.held = {}, {}, 0
        Memo.all.append(self)

    def ready(self, chunk_lists: list[list[str]]) -> Callable:
        """A lookup that knows every chunk of the lists."""
        take_over(self.owner)
        wanted: set[str] = set()
        for chunks in chunk_lists:
            wanted.update(chunks)
        missing = [c for c in wanted if c not in self.known]
        if missing:
            self.know(missing, wanted)
        return self.known.__getitem__

    def know(self, missing: list[str], wanted: Iterable[str]) -> None:
        """Learn what is missing; where that begins a generation, it takes over all that is wanted."""
        weigh = lambda chunks: len(chunks) + sum(map(len, chunks)) // 64
        if self.held + weigh(missing) > self.entries // 2:
            self.turn()
            missing = list(wanted)
        self.held += weigh(missing)
        old = self.old
        self.take_over([c for c in missing if c in old])
        new = [c for c in missing if c not in old]
        if new:
            self.learn(new)

    def turn(self) -> None:
        self.known, self.old, self.held = {}, self.known, 0

    def take_over(self, chunks: list[str]) -> None:
        self.known.update(zip(chunks, map(self.old.__getitem__, chunks)))

    def learn(self, new: list[str]) -> None:
        self.known.update(zip(new, self.compute(new)))

    def clear(self) -> None:
        self.known, self.old, self.held = {}, {}, 0

    def forget(self) -> None:
        """For good, when its model is replaced."""
        self.clear()
        if self in Memo.all:
            Memo.all.remove(self)


class VectorMemo(Memo):
    """A memo of one vector per chunk; the lookup gives its row in ``rows``."""

    def __init__(self, owner: str, compute: Callable[[list[str]], np.ndarray], width: int, entries: int = MEMO_ENTRIES):
        super().__init__(owner, compute, entries)
        self.width = width
        self.clear()

    def add(self, chunks: list[str], vectors: np.ndarray) -> None:
        end = self.used + len(chunks)
        if end > len(self.rows):
            grown = np.zeros((max(end, len(self.rows) * 3 // 2), self.width), dtype=np.float32)
            grown[: self.used] = self.rows[: self.used]
            self.rows = grown
        self.rows[self.used : end] = vectors
        self.known.update(zip(chunks, range(self.used, end)))
        self.used = end

    def learn(self, new: list[str]) -> None:
        self.add(new, self.compute(new))

    def take_over(self, chunks: list[str]) -> None:
        if chunks:
            self.add(chunks, self.old_rows[[self.old[c] for c in chunks]])

    def turn(self) -> None:
        super().turn()
        self.old_rows, self.rows, self.used = self.rows, np.zeros((1024, self.width), dtype=np.float32), 0

    def clear(self) -> None:
        super().clear()
        self.rows, self.old_rows, self.used = np.zeros((1024, self.width), dtype=np.float32), np.zeros((0, self.width), dtype=np.float32), 0

    def places(self, chunk_lists: list[list[str]]) -> list[np.ndarray]:
        """The rows of every chunk, list by list."""
        at = self.ready(chunk_lists)
        return [np.fromiter(map(at, c), dtype=np.int64, count=len(c)) for c in chunk_lists]


def runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` with these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class RunMemo(Memo):
    """A memo of some numbers per chunk: ``compute`` gives chunks, the numbers of all of them and how
    many are of each, in groups. Those of a chunk start at ``starts`` of its place in ``numbers``."""

    def __init__(self, owner: str, compute: Callable[[list[str]], Iterator[tuple[list[str], np.ndarray, np.ndarray]]], entries: int = MEMO_ENTRIES):
        super().__init__(owner, compute, entries)
        self.clear()

    def add(self, chunks: list[str], numbers: np.ndarray, sizes: np.ndarray) -> None:
        places, end = self.used + len(chunks), self.end + len(numbers)
        self.starts, self.sizes = (self.room(a, places, self.used) for a in (self.starts, self.sizes))
        self.numbers = self.room(self.numbers, end, self.end)
        self.sizes[self.used : places] = sizes
        self.starts[self.used : places] = self.end + np.cumsum(sizes) - sizes
        self.numbers[self.end : end] = numbers
        self.known.update(zip(chunks, range(self.used, places)))
        self.used, self.end = places, end

    @staticmethod
    def room(a: np.ndarray, size: int, used: int) -> np.ndarray:
        if size <= len(a):
            return a
        grown = np.zeros(max(size, len(a) * 3 // 2), dtype=a.dtype)
        grown[:used] = a[:used]
        return grown

    def learn(self, new: list[str]) -> None:
        for group in self.compute(new):
            self.add(*group)

    def take_over(self, chunks: list[str]) -> None:
        if chunks:
            numbers, starts, sizes = self.old_runs
            at = [self.old[c] for c in chunks]
            self.add(chunks, runs(numbers, starts[at], sizes[at]), sizes[at])

    def turn(self) -> None:
        super().turn()
        self.old_runs = self.numbers, self.starts, self.sizes
        self.empty()

    def clear(self) -> None:
        super().clear()
        self.empty()
        self.old_runs = self.numbers, self.starts, self.sizes

    def empty(self) -> None:
        self.numbers, self.starts, self.sizes = np.zeros(1024, dtype="<u4"), np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.used = self.end = 0

    def places(self, chunks: list[str]) -> np.ndarray:
        """The places of chunks, all different."""
        take_over(self.owner)
        at = list(map(self.known.get, chunks))
        if missing := [c for c, p in zip(chunks, at) if p is None]:
            self.know(missing, chunks)
            at = list(map(self.known.__getitem__, chunks))
        return np.array(at, dtype=np.int64)


_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def single_spaced(text: str) -> bool:
    """Every space stands between two non-space characters."""
    plain = "  " not in text and " \n" not in text and "\n " not in text and text[:1] != " " and text[-1:] != " "
    return plain and not _RARE_SPACE.search(text)


def words_with_space(text: str) -> list[str]:
    """Split at every single space that stands between two non-space characters. Joined with a space
    the parts give the text back; runs of white space stay inside a part."""
    return text.split(" ") if single_spaced(text) else _INNER_SPACE.split(text)


def fold(id_col: str, parts: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def bounded_sample(docs: DataFrame, labelled: DataFrame, per_label: int) -> DataFrame:
    """Texts of at most ``per_label`` ids of each label, the lowest by hash: columns id, label, text.

    ``labelled`` has the columns id and label, ``docs`` id and text. Ids are chosen from the narrow
    columns alone, each once; what is sent to every worker has per_label rows for each label. An id with several texts gives
    the smallest one."""
    lowest = W.Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = (
        labelled.filter("id IS NOT NULL AND label IS NOT NULL").distinct()
        .withColumn("place", F.row_number().over(lowest)).filter(F.col("place") <= per_label).drop("place")
    )
    return docs.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).filter("text IS NOT NULL")
