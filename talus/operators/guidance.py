"""What management changed in its guidance, from consecutive extractions, and whether the quotes are real.

extractions: entity_id, filing_no (in time), accession, metric, period, low, high, quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _plain(x: Column) -> Column:
    """Lower case, letters and digits only, single spaces around every word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def quote_check(extractions: DataFrame, texts: DataFrame, gram: int = 5, least_share: float = 0.6) -> DataFrame:
    """Adds ``quoted``: verbatim if the quote's words stand in the filing in this order, loose if at least
    ``least_share`` of its runs of ``gram`` words do, else invented; missing without a quote. Case, signs
    and white space don't count. texts: accession, text."""
    rows = extractions.join(texts.select("accession", _plain(F.coalesce("text", F.lit(""))).alias("_text")), "accession", "left")
    q = rows.withColumn("_quote", _plain(F.coalesce("quote", F.lit(""))))
    words = F.split(F.trim("_quote"), " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - gram + 1, F.lit(1))), lambda i: F.concat(F.lit(" "), F.array_join(F.slice(words, i, gram), " "), F.lit(" ")))
    found = F.size(F.filter(runs, lambda g: F.contains(F.col("_text"), g))) / F.size(runs)
    quoted = (F.when(F.trim("_quote") == "", "missing").when(F.contains(F.col("_text"), F.col("_quote")), "verbatim")
              .when(found >= least_share, "loose").otherwise("invented"))
    return q.select(*extractions.columns, quoted.alias("quoted"))


def compared(old_low: Column, old_high: Column, low: Column, high: Column) -> Column:
    """One range against the one before; a point is a range of one value."""
    a, b = F.coalesce(old_low, old_high), F.coalesce(old_high, old_low)
    c, d = F.coalesce(low, high), F.coalesce(high, low)
    return (F.when(a.isNull() | c.isNull() | (a > b) | (c > d), "unclear").when((a == c) & (b == d), "unchanged").when((c >= a) & (d >= b), "raised")
            .when((c <= a) & (d <= b), "cut").when((c >= a) & (d <= b), "narrowed").otherwise("widened"))


def guidance_diff(extractions: DataFrame) -> DataFrame:
    """Per entity, filing, metric and period: status against the entity's filing with guidance before
    (new, raised, cut, narrowed, widened, unchanged, unclear; withdrawn if it is not given any more), both
    ranges, and the change of the middle in percent. Of several extractions of one metric and period in a
    filing the first by accession and quote counts. An entity's first filing gives no rows.

    A quote that is invented makes a change unclear, if ``quoted`` is there."""
    keys = ["entity_id", "metric", "period"]
    usable = F.lit(True) if "quoted" not in extractions.columns else ~F.col("quoted").isin("invented", "missing")
    one = extractions.groupBy("entity_id", "filing_no", "metric", "period").agg(
        F.min_by(F.struct("low", "high", usable.alias("sure")), F.struct("accession", "quote")).alias("g"))
    order = extractions.select("entity_id", "filing_no").distinct()
    w = Window.partitionBy("entity_id").orderBy("filing_no")
    order = order.withColumn("next_no", F.lead("filing_no").over(w)).withColumn("prev_no", F.lag("filing_no").over(w))
    placed = one.join(order, ["entity_id", "filing_no"])
    new = placed.filter("prev_no IS NOT NULL").select(*keys, "filing_no", F.col("g").alias("new"))
    old = placed.filter("next_no IS NOT NULL").select(*keys, F.col("next_no").alias("filing_no"), F.col("g").alias("old"))
    met = new.join(old, [*keys, "filing_no"], "full")
    change = F.when(F.col("new.sure") & F.col("old.sure"), compared(F.col("old.low"), F.col("old.high"), F.col("new.low"), F.col("new.high"))).otherwise("unclear")
    status = F.when(F.col("new").isNull(), "withdrawn").when(F.col("old").isNull(), "new").otherwise(change)
    middle = lambda s: (F.coalesce(f"{s}.low", f"{s}.high") + F.coalesce(f"{s}.high", f"{s}.low")) / 2
    pct = F.try_divide(middle("new") - middle("old"), F.abs(middle("old"))) * 100
    return met.select("entity_id", "filing_no", "metric", "period", status.alias("status"), F.col("old.low").alias("old_low"), F.col("old.high").alias("old_high"),
                      F.col("new.low").alias("low"), F.col("new.high").alias("high"), pct.alias("middle_change_pct"))
