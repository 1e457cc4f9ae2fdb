"""Numeric helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(x: Column | str, dp: int = 0) -> Column:
    """Round half toward +infinity, which SQL ``round`` does not (-2.5 gives -2)."""
    scale = float(10**dp)
    return F.floor(col(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den of doubles as IEEE 754 has it: over zero infinity, or NaN when num is zero too. Neither an
    error nor a null, so a price that was once zero can't end a whole run."""
    a, b = col(num).cast("double"), col(den).cast("double")
    over_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def pct_change(frm: Column | str, to: Column | str) -> Column:
    """(to - from) / |from| in percent at 1 dp; null when from is 0 or either is null."""
    f, t = col(frm), col(to)
    return js_round(F.try_divide(t - f, F.abs(f)) * 100, 1)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def exact_avg(x: Column, scale: int = 6) -> Column:
    """Mean through a decimal sum: the result does not depend on partitioning or task order."""
    total = F.sum(x.cast(f"decimal(28,{scale})")).cast("double")
    return F.try_divide(total, F.count(x))


def hits(pairs: list[tuple[Column, str]]) -> Column:
    """Names of the conditions that hold, in the given order; null counts as not held."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))
