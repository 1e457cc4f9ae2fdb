"""Run memory: feedback, cooldown, hashes, ledgers and what changed between two looks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.columns import js_round
from talus.operators import asof
from talus.operators.economics import ECONOMIC_COLUMNS
from talus.params import DEFAULTS, MemoryParams

NEWS = "news"


# --- feedback --------------------------------------------------------------------------


def feedback_ledger(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Old taps plus new ones in receipt order. Repeats are kept: each tap counts."""
    return old.unionByName(fresh).orderBy("ts", "update_id")


def last_vote(feedback: DataFrame) -> DataFrame:
    """Newest vote per ticker; mutes are not votes. ``first_seen`` keeps the order in which
    tickers first appeared."""
    return (
        feedback.filter(F.col("run_date") != NEWS).groupBy("ticker")
        .agg(F.max_by(F.struct("run_date", "up", "ts"), F.struct("ts", "update_id")).alias("v"), F.min("update_id").alias("first_seen"))
        .select("ticker", "v.run_date", "v.up", "v.ts", "first_seen")
    )


def news_muted(feedback: DataFrame) -> DataFrame:
    return feedback.filter(F.col("run_date") == NEWS).select("ticker").distinct()


def _recent(as_of, days: int) -> Column:
    return F.abs(F.datediff(F.lit(as_of).cast("date"), F.col("ts").cast("date"))) < days


def news_targets(feedback: DataFrame, as_of, p: MemoryParams = DEFAULTS.memory) -> DataFrame:
    """Upvoted, not muted, fresh; the first few in the order they appeared."""
    votes = last_vote(feedback).filter(F.col("up") & _recent(as_of, p.watchlist_days))
    return votes.join(news_muted(feedback), "ticker", "left_anti").orderBy("first_seen").limit(p.news_max_companies)


def watchlist(feedback: DataFrame, candidates: DataFrame, predictions: DataFrame, hashes: DataFrame, as_of,
              p: MemoryParams = DEFAULTS.memory) -> DataFrame:
    """Upvoted names that are not candidates today, the first few; of these the ones whose
    filings changed since their last prediction."""
    votes = last_vote(feedback).filter(F.col("up") & _recent(as_of, p.watchlist_days))
    few = votes.join(candidates.select("ticker"), "ticker", "left_anti").orderBy("first_seen").limit(p.watchlist_max)
    prior = latest_prediction(predictions).select("ticker", F.col("hash").alias("prior_hash"))
    return few.join(prior, "ticker").join(hashes.select("ticker", "hash"), "ticker").filter("hash <> prior_hash").select(
        "ticker", "prior_hash", "hash"
    )


def latest_prediction(predictions: DataFrame) -> DataFrame:
    cols = [c for c in predictions.columns if c != "ticker"]
    return predictions.groupBy("ticker").agg(F.max_by(F.struct(*cols), "run_date").alias("p")).select("ticker", "p.*")


def cooldown_filter(entries: DataFrame, state: DataFrame, run_date, days: int = DEFAULTS.screen.cooldown_days) -> DataFrame:
    """Drops names digested less than ``days`` ago whose filings have not changed."""
    s = state.select("ticker", F.col("hash").alias("_h"), "last_digest_date")
    fresh = F.abs(F.datediff(F.lit(run_date).cast("date"), "last_digest_date")) < days
    stale = F.coalesce((F.col("_h") == F.col("hash")) & fresh, F.lit(False))
    return entries.join(s, "ticker", "left").filter(~stale).select(*entries.columns)


def downvote_suppress(entries: DataFrame, feedback: DataFrame, predictions: DataFrame, run_date,
                      p: MemoryParams = DEFAULTS.memory) -> DataFrame:
    """Drops names whose last vote is a recent downvote and whose filings are those of the
    prediction voted on."""
    down = last_vote(feedback).filter(~F.col("up") & _recent(run_date, p.downvote_suppress_days)).select("ticker", "run_date")
    preds = predictions.select("ticker", F.col("run_date").cast("string").alias("run_date"), "hash")
    same = down.join(preds, ["ticker", "run_date"]).select("ticker", "hash").distinct()
    return entries.join(same, ["ticker", "hash"], "left_anti")


# --- hashes ----------------------------------------------------------------------------


def facts_fingerprint(series: DataFrame, instants: DataFrame, annual: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """Digest of an entity's normalised facts: quarters, instants, years and the chosen tags; what is
    collected is bounded by the periods kept. Independent of row order."""
    line = lambda df, kind: df.select(
        "entity_id", F.concat_ws("|", F.lit(kind), "concept", F.col("p_end").cast("string"), F.col("val").cast("decimal(38,4)").cast("string"), "accn").alias("line")
    )
    rows = line(series, "q").unionByName(line(instants, "i"))
    if annual is not None:
        rows = rows.unionByName(line(annual, "a"))
    if tags is not None:
        rows = rows.unionByName(tags.select("entity_id", F.concat_ws("|", F.lit("t"), "concept", "tag").alias("line")))
    return rows.groupBy("entity_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("facts"))


def bundle_hash(documents: DataFrame, fingerprint: DataFrame, version: str, extra: DataFrame | None = None) -> DataFrame:
    """24 hex digits over ticker, accessions, facts and version. Prices and dates stay out, so
    a name without a new filing keeps its hash. Documents per entity are few by construction."""
    acc = documents.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("accession")), ",").alias("acc"))
    j = fingerprint.join(acc, "entity_id", "left")
    note = F.lit("")
    if extra is not None:
        j, note = j.join(extra.select("entity_id", "extra"), "entity_id", "left"), F.coalesce("extra", F.lit(""))
    text = F.concat_ws("|", F.col("entity_id").cast("string"), F.coalesce("acc", F.lit("")), "facts", F.lit(f"v{version}"), note)
    return j.select("entity_id", F.substring(F.sha2(text, 256), 1, 24).alias("hash"))


def incremental_new(hashes: DataFrame, done: DataFrame) -> DataFrame:
    """Entities whose hash has no stored result."""
    return hashes.join(done.select("hash").distinct(), "hash", "left_anti").select(*hashes.columns)


# --- two looks -------------------------------------------------------------------------


def look_diff(prior: DataFrame, current: DataFrame) -> DataFrame:
    """What changed between two snapshots of an entity as rows (entity_id, change, delta).

    Both sides: entity_id, accessions, as_of_quarter, price, revenue_ttm, gross_pct, op_pct,
    net_debt, shares. Levels report moves of at least 0.5 % in percent, margins moves of at
    least 10 basis points; price always; 'none' when nothing changed.
    """
    p = prior.select("entity_id", *[F.col(c).alias(f"p_{c}") for c in prior.columns if c != "entity_id"])
    j = current.join(p, "entity_id")
    new = "size(array_except(accessions, p_accessions))"
    rel = lambda c: f"try_divide({c} - p_{c}, abs(p_{c}))"
    pct = lambda x: f"CAST(floor(({x}) * 1000D + 0.5D) AS DOUBLE) / 10D"
    bp = lambda c: f"floor(({c} - p_{c}) * 100D + 0.5D)"
    row = lambda cond, name, x: f"CASE WHEN {cond} THEN struct('{name}' AS change, CAST({x} AS DOUBLE) AS delta) END"
    rows = [
        row(f"{new} > 0", "new_filings", new),
        row("p_as_of_quarter <> as_of_quarter", "quarter_rolled", "datediff(as_of_quarter, p_as_of_quarter)"),
        row("p_price <> 0 AND price <> 0", "price", pct("(price - p_price) / nullif(p_price, 0D)")),
        row(f"abs({rel('revenue_ttm')}) >= 0.005D", "revenue_ttm", pct(rel("revenue_ttm"))),
        row(f"abs({bp('gross_pct')}) >= 10", "gross_margin_bp", bp("gross_pct")),
        row(f"abs({bp('op_pct')}) >= 10", "operating_margin_bp", bp("op_pct")),
        row(f"abs({rel('net_debt')}) >= 0.005D", "net_debt", pct(rel("net_debt"))),
        row(f"abs({rel('shares')}) >= 0.005D", "shares", pct(rel("shares"))),
    ]
    changes = j.selectExpr("entity_id", f"array_compact(array({', '.join(rows)})) AS ch")
    return changes.selectExpr(
        "entity_id", "inline(CASE WHEN size(ch) > 0 THEN ch ELSE array(struct('none' AS change, CAST(NULL AS DOUBLE) AS delta)) END)"
    )


def ticker_history(predictions: DataFrame, grades: DataFrame, n: int = 3) -> DataFrame:
    """Last ``n`` predictions per ticker with their graded counts."""
    w = Window.partitionBy("ticker").orderBy(F.col("run_date").desc())
    recent = predictions.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    counts = grades.groupBy("ticker", "run_date").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("fired", "survived", "uncheckable")]
    )
    return recent.join(counts, ["ticker", "run_date"], "left")


def prior_seen(entries: DataFrame, predictions: DataFrame, feedback: DataFrame) -> DataFrame:
    """For (ticker, run_date): the previous prediction strictly before it and the last vote."""
    days = predictions.select("ticker", F.col("run_date").alias("at")).distinct().withColumn("seen", F.col("at"))
    out = asof.before(entries.select("ticker", "run_date"), days, ["ticker"], "run_date", "at", "seen", "seen_date")
    votes = last_vote(feedback).select("ticker", F.col("up").alias("seen_up"))
    return out.join(votes, "ticker", "left")


# --- ledgers ---------------------------------------------------------------------------


def ledger_upsert(old: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("ticker", "run_date")) -> DataFrame:
    """Fresh rows replace old ones with the same key; running it twice changes nothing."""
    return old.join(fresh.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(fresh)


def keyed_upsert(existing: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or replace by key, newest wins. A combinable aggregate rather than a window, so
    a key written very often is reduced before it travels."""
    cols = [c for c in existing.columns if c not in keys]
    return (
        existing.unionByName(updates).groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("r")).select(*keys, "r.*")
        .select(*existing.columns)
    )


def capped_log(log: DataFrame, fresh: DataFrame, order: str, keep: int) -> DataFrame:
    """The newest ``keep`` old entries plus the fresh ones (a top-k, no global sort)."""
    return log.orderBy(F.col(order).desc()).limit(keep).unionByName(fresh)


def objections_latest(arguments: DataFrame, n: int = 3) -> DataFrame:
    """Last ``n`` reader objections per ticker."""
    w = Window.partitionBy("ticker").orderBy(F.col("created_at").desc(), F.col("arg_id").desc())
    return arguments.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def argument_context(tickers: DataFrame, predictions: DataFrame, performance: DataFrame, arguments: DataFrame, switches: DataFrame | None = None,
                     p: MemoryParams = DEFAULTS.memory) -> DataFrame:
    """What a reply about a ticker needs: latest prediction with its thesis and kill-switches
    (``switches``: ticker, run_date, label, falsifier), performance and economics, recent objections
    (at most three are collected) and the last exchange, cut to the lengths of the parameters."""
    latest = latest_prediction(predictions)
    pred = latest.select("ticker", F.col("run_date").alias("pred_date"), "classification", "thesis", "fair", "ref_price")
    last = lambda c, n: F.max(F.when(F.col("rn") == 1, F.substring(c, 1, n)))
    recent = objections_latest(arguments).groupBy("ticker").agg(
        F.count("*").alias("n_objections"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "note"))), lambda x: x["note"]), " | ").alias("notes"),
        last("user_text", p.last_text_chars).alias("last_text"), last("ai_reply", p.last_reply_chars).alias("last_reply"),
    )
    out = (
        tickers.select("ticker").distinct().join(pred, "ticker", "left").join(performance, "ticker", "left").join(recent, "ticker", "left")
        .withColumn("n_objections", F.coalesce("n_objections", F.lit(0).cast("bigint")))
    )
    if switches is None:
        return out
    # One line per scenario of one prediction: six.
    told = switches.join(latest.select("ticker", "run_date"), ["ticker", "run_date"]).groupBy("ticker").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "label", "falsifier"))), " | ").alias("kill_switches")
    )
    return out.join(told, "ticker", "left")


def performance_snapshot(metrics: DataFrame, economics: DataFrame, captured_at) -> DataFrame:
    """Durable record of an analysed entity."""
    eco = economics.select("entity_id", *ECONOMIC_COLUMNS)
    return metrics.select(
        "entity_id", "as_of_quarter", "span_years", "revenue_cagr_pct", "share_cagr_pct", "fcf_positive_quarters", "fcf_quarters", "gross_delta_bp", "op_delta_bp",
        "revenue_ttm", "ebitda_ttm", "ebit_ttm", "net_income_ttm", "fcf_ttm",
    ).join(eco, "entity_id", "left").withColumn("captured_at", F.lit(captured_at).cast("date"))


def price_vs_anchor(prices: DataFrame, anchors: DataFrame) -> DataFrame:
    """Live price against the blended anchor, whole percent."""
    return prices.join(anchors, "entity_id").filter("anchor > 0").select(
        "entity_id", "price", "anchor", js_round((F.col("price") / F.col("anchor") - 1) * 100).alias("vs_anchor_pct")
    )
