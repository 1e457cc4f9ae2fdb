"""Vectors as whole numbers, so that scores and distances are exact and ties are real ties."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import python_ready
from talus.sources.gold import materialize


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0), F.lit(False))


def integer_vectors(df: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(id, label, v) of the rows that take part, written to the shared folder, and the vectors' length.

    A component x becomes floor(scale * x). Left out are vectors that are null, empty, hold null or
    non-finite components, or have another length than most (the shorter one in a tie). What would
    make sums of squares leave the range of a long is brought to the edge of that range."""
    python_ready(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v")).filter(finite(F.col("v")))
    # One row per length of vector.
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if sizes is None:
        return rows.select("id", "label", F.col("v").cast("array<long>").alias("v")).limit(0), 0
    edge = float(math.isqrt(2**60 // sizes["n"]) // 2)
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), x * scale))).cast("long"))
    return materialize(rows.filter(F.size("v") == sizes["n"]).select("id", "label", whole.alias("v")), "integer-vectors"), sizes["n"]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact; in floating point where every partial sum is a whole number below 2**53."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
