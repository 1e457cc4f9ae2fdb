"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network with
temperature-calibrated probabilities.

Every word has a sparse index vector of +1 and -1 drawn from its hash. A word's context vector is the
sum of the index vectors of its neighbours over the training sample; its word vector is the index
vector plus the scaled context vector. Signs, letter case and digits of a token are words of their own.
A document is the mean of its tokens' vectors, plus the index vectors of two document-level words
weighted by how often a token repeats the one before it and how often it repeats any before it.

Words are hashed to ``BUCKETS`` rows, so the vectors have a fixed size. Word vectors, network and
temperature are fitted on at most ``PER_LABEL`` whole documents of each label, the lowest by hash of
their id; a fifth of these is kept from the network to choose the temperature. Scoring reads texts only.

Null and empty texts are scored as a document without words. If the sample holds one label or none, the
score is that label's smoothed share. An id with several labels counts as the larger one. Rows without
an id are never learned from and count as held out. Repeated rows get equal results, an empty table an
empty one; other columns are ignored."""

from __future__ import annotations

import functools
import itertools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import VectorMemo, bounded_sample, held_by, python_ready, slices, take_over, texts_of
from talus.sources.gold import materialize

DIMENSIONS = 64
BUCKETS = 4096
NONZERO = 4
REACH = 2
HIDDEN = 32
PER_LABEL = 5000

_EDGE = re.compile(r"^\W+|\W+$")
_SIGNS = re.compile(r"[^\w\s]+")


def features(token: str) -> list[str]:
    """The words a token stands for; the first is the token itself without case and signs."""
    core = _EDGE.sub("", token)
    out = ["w" + core.lower()]
    out += ["s" + s[:4] for s in _SIGNS.findall(token)]
    if len(core) > 1:
        out.append("c" + ("upper" if core.isupper() else "title" if core[0].isupper() else "lower"))
    if any(map(str.isdigit, core)):
        out.append("d")
    return out


def bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(word) % BUCKETS


CASES = {c: bucket("c" + c) for c in ("upper", "title", "lower")}


def feature_rows(token: str) -> list[int]:
    """Buckets of a token's features; letters alone need no search for signs and digits."""
    if not token.isalpha():
        return [bucket(f) for f in features(token)]
    word = bucket("w" + token.lower())
    return [word, CASES["upper" if token.isupper() else "title" if token[0].isupper() else "lower"]] if len(token) > 1 else [word]


@functools.cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every row, drawn from the row's hash."""
    draw = [[xxhash.xxh64_intdigest(f"{row}:{i}") for i in range(NONZERO)] for row in range(BUCKETS)]
    place = np.array([[d % DIMENSIONS for d in row] for row in draw])
    sign = np.array([[1 - 2 * (d >> 40 & 1) for d in row] for row in draw])
    return place, sign


def index_matrix() -> np.ndarray:
    place, sign = index_vectors()
    out = np.zeros((BUCKETS, DIMENSIONS))
    np.add.at(out, (np.repeat(np.arange(BUCKETS), NONZERO), place.ravel()), sign.ravel())
    return out


def context_sums(texts: list[str]) -> np.ndarray:
    """Sums of the index vectors of each row's neighbours, whole numbers."""
    place, sign = index_vectors()
    row_of = functools.lru_cache(200_000)(lambda t: bucket(features(t)[0]))
    gap = [-1] * REACH
    rows = np.array([r for t in texts for r in (*gap, *map(row_of, t.split()))], dtype=np.int64)
    total = np.zeros(BUCKETS * DIMENSIONS)
    for step in range(1, REACH + 1):
        both = (rows[:-step] >= 0) & (rows[step:] >= 0)
        left, right = rows[:-step][both], rows[step:][both]
        for a, b in ((left, right), (right, left)):
            total += np.bincount((a[:, None] * DIMENSIONS + place[b]).ravel(), weights=sign[b].ravel(), minlength=len(total))
    return total.reshape(BUCKETS, DIMENSIONS)


def word_vectors(context: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return index_matrix() + np.sqrt(NONZERO) * context / np.maximum(norm, 1e-9)


@dataclass
class Network:
    """Two layers, and the temperature that its logits are divided by."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))

    @classmethod
    def constant(cls, share: float) -> Network:
        n = DIMENSIONS
        return cls(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4) -> Network:
        """Adam on the log loss, in small batches drawn with a fixed seed."""
        rng = np.random.default_rng(0)
        net = cls(x.mean(0), x.std(0) + 1e-6, rng.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), 0.0)
        z = (x - net.mean) / net.scale
        p = [net.w1, net.b1, net.w2, np.array([net.b2])]
        first, second, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for lo in range(0, len(z), 256):
                xb, yb = z[order[lo : lo + 256]], y[order[lo : lo + 256]]
                h = np.tanh(xb @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - yb) / len(yb)
                back = g[:, None] * p[2] * (1 - h * h)
                grads = [xb.T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]
                t += 1
                for i, d in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * d
                    second[i] = 0.999 * second[i] + 0.001 * d * d
                    p[i] -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
        return net

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss on documents the network hasn't seen."""
        if not len(x):
            return
        logit = self.logits(x)
        loss = lambda t: float(np.mean(np.logaddexp(0, logit / t) - y * logit / t))
        self.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)


@dataclass
class Model:
    vectors: np.ndarray = field(repr=False)
    network: Network
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def token_vectors(self, tokens: list[str]) -> np.ndarray:
        """The sum of the vectors of each token's features, of many tokens at once."""
        out = np.zeros((len(tokens), DIMENSIONS), dtype=np.float32)
        for lo in range(0, len(tokens), 20_000):
            rows = list(map(feature_rows, tokens[lo : lo + 20_000]))
            sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            flat = np.fromiter(itertools.chain.from_iterable(rows), dtype=np.int64, count=int(sizes.sum()))
            first, sums = np.cumsum(sizes) - sizes, self.vectors[flat[np.cumsum(sizes) - sizes]]
            for place in range(1, int(sizes.max())):
                more = np.flatnonzero(sizes > place)
                sums[more] += self.vectors[flat[first[more] + place]]
            out[lo : lo + len(rows)] = sums
        return out


_READY: dict[str, VectorMemo] = {}
held_by("quality", _READY.clear)


def pooled(texts: list[str], model: Model) -> np.ndarray:
    """One vector per text."""
    if model.key not in _READY:
        for old in _READY.values():
            old.forget()
        _READY.clear()
        _READY[model.key] = VectorMemo("quality", model.token_vectors, DIMENSIONS, entries=160_000)
    memo = _READY[model.key]
    twice, again = (model.vectors[bucket(w)] for w in ("<same as before>", "<seen before>"))
    out = np.zeros((len(texts), DIMENSIONS))
    done = 0
    for lo, hi in slices(texts):
        for at in memo.places([t.split() for t in texts[lo:hi]]):
            if len(at):
                out[done] = memo.rows[at].mean(axis=0, dtype=np.float64)
                out[done] += 4 * np.mean(np.r_[False, at[1:] == at[:-1]]) * twice + 4 * (1 - len(np.unique(at)) / len(at)) * again
            done += 1
    return out


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Model:
    """A model from the labelled rows for which ``train`` (a condition on the id) holds."""
    spark = docs.sparkSession
    python_ready(spark)
    labelled = labels.filter(train).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    # Bounded by per_label; written once as two passes read it.
    sample = materialize(bounded_sample(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), labelled, per_label), "quality-sample")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_over("quality")
        total = np.zeros((BUCKETS, DIMENSIONS))
        for b in batches:
            texts = texts_of(b["text"])
            for lo, hi in slices(texts):
                total += context_sums(texts[lo:hi])
        rows = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"row": rows, "sums": pd.Series(list(total[rows]), dtype=object)})

    add = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIMENSIONS)]
    sums = sample.select("text").mapInPandas(contexts, "row int, sums array<double>").groupBy("row").agg(*add).toArrow().to_pandas()
    context = np.zeros((BUCKETS, DIMENSIONS))
    context[sums["row"].to_numpy(dtype=np.int64)] = sums.drop(columns="row").to_numpy(dtype=np.float64)
    model = Model(word_vectors(context), Network.constant(0.5))
    shared = spark.sparkContext.broadcast(model)

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "x": list(pooled(texts_of(b["text"]), shared.value))})

    rows = sample.select("id", F.col("label").cast("int").alias("label"), "text").mapInPandas(pool, "id long, label int, x array<double>").toArrow().to_pylist()
    rows.sort(key=lambda r: r["id"])
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    if len(set(y)) < 2:
        return Model(model.vectors, Network.constant((y.sum() + 1) / (len(y) + 2)))
    x = np.array([r["x"] for r in rows])
    kept = np.array([xxhash.xxh64_intdigest(str(r["id"])) % 5 == 0 for r in rows])
    network = Network.train(x[~kept], y[~kept]) if len(set(y[~kept])) == 2 else Network.train(x, y)
    network.calibrate(x[kept], y[kept])
    return Model(model.vectors, network)


def scores(spark: SparkSession, model: Model):
    """A column function from text to the probability of label 1."""
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(shared.value.network.probability(pooled(texts_of(b), shared.value)))

    return score


def classify(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, fold, score and decision of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), scores(docs.sparkSession, model)(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
