"""Insiders who buy at the same time, from ownership filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The parts of an ownership document that are read, with the source's names.
FORM4 = """
issuer STRUCT<issuerCik: BIGINT, issuerTradingSymbol: STRING>,
reportingOwner ARRAY<STRUCT<
  reportingOwnerId: STRUCT<rptOwnerCik: BIGINT, rptOwnerName: STRING>,
  reportingOwnerRelationship: STRUCT<isDirector: STRING, isOfficer: STRING, isTenPercentOwner: STRING>>>,
nonDerivativeTable STRUCT<nonDerivativeTransaction: ARRAY<STRUCT<
  transactionDate: STRUCT<value: DATE>,
  transactionCoding: STRUCT<transactionCode: STRING>,
  transactionAmounts: STRUCT<
    transactionShares: STRUCT<value: DOUBLE>,
    transactionPricePerShare: STRUCT<value: DOUBLE>,
    transactionAcquiredDisposedCode: STRUCT<value: STRING>>>>>
"""


def form4_explode(docs: DataFrame) -> DataFrame:
    """One row per transaction and owner; a document that can't be read gives none. docs: accession,
    xml. The same filing delivered twice counts once; of different texts, the one with the least hash.
    The texts are read where they lie: only what is in them is exchanged."""
    read = docs.select("accession", F.xxhash64("xml").alias("mark"), F.from_xml("xml", FORM4, {"mode": "PERMISSIVE"}).alias("d"))
    read = read.groupBy("accession").agg(F.min_by("d", "mark").alias("d"))
    owners = read.select("accession", "d", F.explode("d.reportingOwner").alias("o"))
    rows = owners.select("accession", "d.issuer", "o", F.posexplode("d.nonDerivativeTable.nonDerivativeTransaction").alias("line", "t"))
    yes = lambda c: F.coalesce(F.lower(F.trim(c)).isin("1", "true"), F.lit(False))
    who = "o.reportingOwnerRelationship"
    return rows.select(
        "accession", "line", F.col("issuer.issuerCik").alias("entity_id"), F.col("o.reportingOwnerId.rptOwnerCik").alias("owner"), F.trim("o.reportingOwnerId.rptOwnerName").alias("owner_name"),
        yes(F.col(f"{who}.isDirector")).alias("is_director"), yes(F.col(f"{who}.isOfficer")).alias("is_officer"),
        F.col("t.transactionDate.value").alias("day"), F.col("t.transactionCoding.transactionCode").alias("code"),
        F.col("t.transactionAmounts.transactionShares.value").alias("shares"), F.col("t.transactionAmounts.transactionPricePerShare.value").alias("price"),
        F.col("t.transactionAmounts.transactionAcquiredDisposedCode.value").alias("acquired"))


def insider_buys(trades: DataFrame) -> DataFrame:
    """Purchases in the market: code P, acquired, with a day and shares."""
    return trades.filter("code = 'P' AND acquired = 'A' AND shares > 0 AND day IS NOT NULL AND entity_id IS NOT NULL AND owner IS NOT NULL")


def insider_activity(buys: DataFrame, days: int = 30) -> DataFrame:
    """entity_id, day, insiders: how many different insiders have bought in the ``days`` up to a day; a
    row for each day on which that changes.

    An insider's purchases are one row a day, and their windows run together into stretches. A stretch
    is +1 on its first day and -1 on the day after its last; an entity's changes are added up per day
    and summed along its days, so however many filings there are, a sweep sees one row a day."""
    mine = Window.partitionBy("entity_id", "owner").orderBy("day")
    daily = buys.select("entity_id", "owner", "day").distinct()
    before, after = F.datediff("day", F.lag("day").over(mine)), F.datediff(F.lead("day").over(mine), "day")
    edges = daily.withColumn("begins", F.coalesce(before >= days, F.lit(True))).withColumn("ends", F.coalesce(after >= days, F.lit(True)))
    events = edges.select("entity_id", F.explode(F.filter(F.array(
        F.when(F.col("begins"), F.struct("day", F.lit(1).alias("n"))), F.when(F.col("ends"), F.struct(F.date_add("day", days).alias("day"), F.lit(-1).alias("n")))), lambda x: x.isNotNull())).alias("e"))
    change = events.groupBy("entity_id", F.col("e.day").alias("day")).agg(F.sum("e.n").alias("n")).filter("n <> 0")
    return change.select("entity_id", "day", F.sum("n").over(Window.partitionBy("entity_id").orderBy("day")).alias("insiders"))


def insider_clusters(buys: DataFrame, days: int = 30, least: int = 3) -> DataFrame:
    """Per entity the most insiders that bought within any ``days``, the first day on which they had,
    what all bought in the ``days`` up to then (value), and whether they are a cluster (``least``)."""
    peak = insider_activity(buys, days).groupBy("entity_id").agg(F.max_by(F.struct("insiders", "day"), F.struct("insiders", (-F.unix_date("day")).alias("k"))).alias("p")).select("entity_id", "p.*")
    spent = buys.groupBy("entity_id", "day").agg(F.sum(F.col("shares") * F.coalesce("price", F.lit(0.0))).alias("value"))
    inside = spent.withColumnRenamed("day", "bought").join(peak, "entity_id").filter((F.col("bought") <= F.col("day")) & (F.datediff("day", "bought") < days))
    return inside.groupBy("entity_id", "insiders", F.col("day").alias("peak_day")).agg(F.sum("value").alias("value")).withColumn("cluster", F.col("insiders") >= least)


def insider_flags(asks: DataFrame, buys: DataFrame, days: int = 30, least: int = 3) -> DataFrame:
    """``asks`` (entity_id, day) with how many insiders had bought in the ``days`` up to the day, and
    whether they are a cluster."""
    changes = insider_activity(buys, days).withColumn("at", F.unix_date("day"))
    marked = asks.select("entity_id", "day").distinct().withColumn("at", F.unix_date("day")).withColumn("insiders", F.lit(None).cast("bigint")).withColumn("ask", F.lit(1))
    both = changes.select("entity_id", "day", "at", "insiders", F.lit(0).alias("ask")).unionByName(marked)
    w = Window.partitionBy("entity_id").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("insiders", F.coalesce(F.last("insiders", ignorenulls=True).over(w), F.lit(0))).filter("ask = 1").select("entity_id", "day", "insiders")
    return asks.join(known, ["entity_id", "day"], "left").withColumn("cluster", F.coalesce(F.col("insiders") >= least, F.lit(False)))
