"""Universe, filings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus import params as P
from talus.functions import text as T


def universe_dedup(entries: DataFrame, pattern: str = P.TICKER_PATTERN) -> DataFrame:
    """Well-formed tickers, the first per registrant in file order. A map-side-combinable
    aggregate, so a registrant with very many lines costs nothing extra."""
    return (
        entries.filter(F.col("ticker").rlike(pattern))
        .groupBy("cik")
        .agg(F.min_by(F.struct("ticker", "title"), "pos").alias("b"))
        .select("cik", "b.ticker", "b.title")
    )


def filings_explode(submissions: DataFrame) -> DataFrame:
    """Parallel arrays to one row per filing; item codes split on commas, blanks dropped."""
    z = F.arrays_zip("accession_number", "form", "filing_date", "primary_document", "items")
    return submissions.select("entity_id", F.posexplode(z).alias("pos", "f")).select(
        "entity_id",
        F.col("f.accession_number").alias("accession"),
        F.coalesce("f.form", F.lit("")).alias("form"),
        F.col("f.filing_date").cast("date").alias("filed_at"),
        F.coalesce("f.primary_document", F.lit("")).alias("primary_document"),
        item_codes(F.col("f.items")).alias("items"),
        "pos",
    )


def item_codes(items):
    return F.filter(F.split(F.coalesce(items, F.lit("")), ","), lambda x: x != "")


def domestic_filer(filings: DataFrame) -> DataFrame:
    """Files 10-K or 10-Q and neither 20-F nor 6-K."""
    form = F.col("form")
    return filings.groupBy("entity_id").agg(
        (F.bool_or(form.isin("10-K", "10-Q")) & ~F.bool_or(form.isin("20-F", "6-K"))).alias("is_domestic")
    )


FILING = ("accession", "form", "filed_at", "primary_document", "items")


def latest_filing(filings: DataFrame, form: str, since=None) -> DataFrame:
    """Newest filing of a form per entity, on or after ``since`` when given."""
    f = filings.filter(F.col("form") == form)
    if since is not None:
        f = f.filter(F.col("filed_at") >= F.lit(since))
    return f.groupBy("entity_id").agg(F.min_by(F.struct(*FILING), "pos").alias("f")).select("entity_id", "f.*")


def filings_since(filings: DataFrame, form: str, since) -> DataFrame:
    return filings.filter((F.col("form") == form) & (F.col("filed_at") >= F.lit(since)))


def recent_8k_topn(filings: DataFrame, as_of, days: int = 45, n: int = 2) -> DataFrame:
    """At most ``n`` newest 8-Ks per entity inside the window. The rank limit is applied
    before the exchange as well (WindowGroupLimit), so a prolific filer does not travel."""
    w = Window.partitionBy("entity_id").orderBy("pos")
    recent = filings_since(filings, "8-K", F.date_sub(F.lit(as_of).cast("date"), days))
    return recent.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def periodic_report_pick(filings: DataFrame) -> DataFrame:
    """Latest 10-Q when filed strictly after the latest 10-K, else the 10-K, else the 10-Q."""
    newest = lambda form: F.min_by(F.struct(*FILING), F.when(F.col("form") == form, F.col("pos")))
    both = filings.filter(F.col("form").isin("10-K", "10-Q")).groupBy("entity_id").agg(
        newest("10-Q").alias("q"), newest("10-K").alias("k")
    )
    pick = F.when(F.col("k").isNull() | (F.col("q.filed_at") > F.col("k.filed_at")), F.coalesce("q", "k")).otherwise(F.col("k"))
    return both.select("entity_id", pick.alias("f")).select("entity_id", "f.*")


def bundle_documents(filings: DataFrame, as_of) -> DataFrame:
    """Accessions that an entity's bundle rests on: its few recent 8-Ks and the periodic report."""
    cols = ["entity_id", "accession"]
    return recent_8k_topn(filings, as_of).select(*cols).unionByName(periodic_report_pick(filings).select(*cols))


def corporate_actions(filings: DataFrame) -> DataFrame:
    """Per entity the newest bankruptcy 8-K (item 1.03) and the newest delisting form."""
    bankrupt = (F.col("form") == "8-K") & F.array_contains(item_codes(F.col("items")), "1.03")
    return filings.groupBy("entity_id").agg(
        F.max(F.when(bankrupt, F.col("filed_at"))).alias("bankrupt_at"),
        F.max(F.when(F.col("form").isin("25", "25-NSE"), F.col("filed_at"))).alias("delisted_at"),
    )


def corporate_action_scan(asks: DataFrame, filings: DataFrame) -> DataFrame:
    """What happened to ``entity_id`` on or after ``since``. Filings shrink to one row per
    entity first, so asks and filings are never paired up."""
    return asks.join(corporate_actions(filings), "entity_id", "left").select(
        *asks.columns,
        F.when(F.col("bankrupt_at") >= F.col("since"), "bankruptcy")
        .when(F.col("delisted_at") >= F.col("since"), "delisted")
        .alias("action"),
    )


def exhibit_pick(files: DataFrame, primaries: DataFrame, key: str = "doc_id") -> DataFrame:
    """First listed file that looks like a press-release exhibit, else the primary document."""
    name = F.col("name")
    good = name.rlike(f"(?i){P.EXHIBIT_PATTERN}") & name.rlike(r"(?i)\.html?$") & ~name.rlike("(?i)index")
    exhibit = files.filter(good).groupBy(key).agg(F.min_by("name", "pos").alias("exhibit"))
    return primaries.join(exhibit, key, "left").select(
        key,
        F.coalesce("exhibit", F.when(F.col("primary_document") != "", F.col("primary_document"))).alias("file"),
        F.when(F.col("exhibit").isNotNull(), "press-release").otherwise("primary").alias("kind"),
    )


def press_release_text(pages: DataFrame, limit: int = 30_000) -> DataFrame:
    """Readable text of an exhibit, capped, with the flag that says so."""
    return pages.withColumn("t", T.text_cap(T.html_to_text("html"), limit)).select("*", "t.text", "t.truncated").drop("t", "html")


def section_text(docs: DataFrame, limit: int = 60_000, **options) -> DataFrame:
    """Discussion section of a periodic report, capped. ``truncated`` also when no heading was
    found and the head of the document stands in."""
    s = docs.withColumn("s", T.section_extract("text", **options))
    return s.select(
        *[c for c in docs.columns if c != "text"],
        F.substring("s.text", 1, limit).alias("text"),
        ((F.length("s.text") > limit) | ~F.col("s.found")).alias("truncated"),
        "s.found",
        "s.start",
    )
