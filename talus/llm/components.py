"""Connected components by alternating stars.

Each round links every node's larger neighbours to its smallest one, then every node and its smaller
neighbours to the smallest of them. The links of a component end up as a star around its smallest node
after few rounds, about the logarithm of its diameter. A round is two combinable aggregates and two
joins; its result is written, so lineage stays short and a lost executor costs one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.sources.gold import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node that it reaches."""
    e = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e = materialize(e, "links")
    state = _state(e)
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = materialize(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        before, state = state, _state(e)
        if state == before:
            break
    roots = e.select(F.col("lo").alias("node")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _state(e: DataFrame) -> tuple:
    """Number of links and an order-free checksum: equal when a round changes nothing."""
    h = F.xxhash64("hi", "lo")
    r = e.agg(F.count("*").alias("n"), F.sum((h % 1_000_000_007)).alias("s"), F.bit_xor(h).alias("x")).first()
    return r["n"], r["s"], r["x"]
