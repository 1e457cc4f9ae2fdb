"""Readers for landed files. Every schema is fixed; nothing is inferred.

Documents of one company (5-20 MB) are one row each; they are exploded right after parsing, and
the rows that leave a reader are narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.series import NESTED_FACTS


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Ticker file: one object of numbered entries; ``pos`` is the number."""
    entry = "map<string,struct<cik_str:bigint,ticker:string,title:string>>"
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", entry)).alias("k", "e"))
    return doc.select(F.col("e.cik_str").alias("cik"), "e.ticker", "e.title", F.col("k").cast("int").alias("pos"))


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    """Company fact documents as (entity_id, payload) for ``facts_explode``."""
    doc = f"struct<cik:bigint,entityName:string,facts:{NESTED_FACTS}>"
    return spark.read.text(path, wholetext=True).select(F.from_json("value", doc).alias("d")).select(
        F.col("d.cik").alias("entity_id"), F.col("d.facts").alias("payload")
    )


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Submission documents with parallel filing arrays, for ``filings_explode``."""
    arrays = ",".join(f"{c}:array<string>" for c in ("accessionNumber", "form", "filingDate", "primaryDocument", "items"))
    doc = f"struct<cik:string,name:string,sic:string,sicDescription:string,filings:struct<recent:struct<{arrays}>>>"
    r = "d.filings.recent"
    return spark.read.text(path, wholetext=True).select(F.from_json("value", doc).alias("d")).select(
        F.col("d.cik").cast("bigint").alias("entity_id"), "d.name", "d.sic", F.col("d.sicDescription").alias("sic_description"),
        F.col(f"{r}.accessionNumber").alias("accession_number"), F.col(f"{r}.form").alias("form"), F.col(f"{r}.filingDate").alias("filing_date"),
        F.col(f"{r}.primaryDocument").alias("primary_document"), F.col(f"{r}.items").alias("items"),
    )


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Quote snapshots, one JSON object a line, for ``quote_normalize``."""
    fields = {
        "symbol": "string", "regularMarketPrice": "double", "regularMarketChangePercent": "double", "marketCap": "double",
        "averageDailyVolume3Month": "double", "fiftyTwoWeekHigh": "double", "fiftyDayAverage": "double", "targetMeanPrice": "double",
        "quoteType": "string", "market": "string", "currency": "string",
    }
    names = ["symbol", "price", "change_pct", "market_cap", "avg_volume", "high52", "avg50", "target", "quote_type", "market", "currency"]
    raw = spark.read.schema(", ".join(f"{k} {t}" for k, t in fields.items())).json(path)
    return raw.select(*[F.col(a).alias(b) for a, b in zip(fields, names)])


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Chart responses, one a line, for ``bars_clean``."""
    raw = spark.read.schema("symbol string, quotes array<struct<date:timestamp,close:double>>").json(path)
    return raw.select("symbol", F.explode("quotes").alias("b")).select("symbol", F.col("b.date").alias("ts"), "b.close")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """News feeds, one file per company named after its ticker, for ``news_parse``."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("entity_id"), F.lit(0).alias("feed_id"), F.col("value").alias("xml"))


def read_estimates(spark: SparkSession, path: str) -> DataFrame:
    """Street estimates, one response a line, for ``eps_growth``."""
    trend = "array<struct<period:string,revenueEstimate:struct<avg:double>,earningsEstimate:struct<avg:double>>>"
    raw = spark.read.schema(f"symbol string, earningsTrend struct<trend:{trend}>").json(path)
    return raw.select(F.col("symbol").alias("entity_id"), F.explode("earningsTrend.trend").alias("t")).select(
        "entity_id", "t.period", F.col("t.revenueEstimate.avg").alias("revenue"), F.col("t.earningsEstimate.avg").alias("eps")
    )


def read_form4(spark: SparkSession, path: str) -> DataFrame:
    """Ownership filings, one XML document a file named after its accession, for ``form4_explode``."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("accession"), F.col("value").alias("xml"))
