"""The two runs, composed from operators over whole tables.

nightly: screen the market, build the fundamentals of every candidate at once, gate, lay out the
digest, and append predictions, cooldown, performance and look snapshots. weekly: fill in the outcomes of past predictions and measure the bias that the next
nightly run corrects. A company that cannot be computed yields nulls and reasons, never an
exception.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators import economics as E
from talus.operators import filings as FO
from talus.operators import gate as G
from talus.operators import memory as R
from talus.operators import metrics as M
from talus.operators import multiples as X
from talus.operators import prices as Q
from talus.operators import scenarios as S
from talus.operators import scoring as K
from talus.operators import screen as SC
from talus.operators import series as SE
from talus.operators import sessions as CA
from talus.params import DEFAULTS, Params

Keep = Callable[[DataFrame, str], DataFrame]


def _as_is(df: DataFrame, name: str) -> DataFrame:
    return df


@dataclass
class Fundamentals:
    """Series of every entity. ``keep`` decides where the plan is cut; on a cluster pass
    ``sources.gold.materialize`` so the series are computed once and read by every branch."""

    quarterly: DataFrame
    instants: DataFrame
    tags: DataFrame

    @classmethod
    def from_facts(cls, facts: DataFrame, p: Params = DEFAULTS, keep: Keep = _as_is) -> "Fundamentals":
        chosen = SE.choose_tags(facts, SE.concept_dim(facts.sparkSession))
        return cls(*SE.split_points(keep(SE.series_points(chosen, p.series), "series_points")))

    @property
    def entities(self) -> DataFrame:
        return self.tags.select("entity_id").distinct()

    def metrics(self) -> DataFrame:
        return M.metrics_wide(self.quarterly, self.instants)

    def sanity(self, metrics: DataFrame, p: Params = DEFAULTS) -> DataFrame:
        flags = M.sanity_flags(self.entities, self.tags, self.quarterly, self.instants, metrics, p.sanity)
        return M.sanity_confidence(self.entities, flags)

    def bands(self, metrics: DataFrame, closes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
        ttm = X.ttm_series(M.quarter_grid(self.quarterly))
        balances = X.dated_balances(ttm, self.instants, self.quarterly, p.multiples)
        ratios = X.historical_multiples(ttm, balances, closes, metrics.select("entity_id", "net_debt", "shares"), p.multiples)
        return X.multiple_bands(ratios, p.multiples)


def screen(universe: DataFrame, quotes: DataFrame, bars: DataFrame, sectors: DataFrame, as_of, p: Params = DEFAULTS) -> DataFrame:
    """Today's candidates."""
    hit = SC.drop_triggers(quotes, Q.month_return(bars, as_of), FO.universe_dedup(universe), p.screen)
    return SC.severity_topk(SC.sector_exclude(hit, sectors, p.screen), p.screen)


def bundle(f: Fundamentals, closes: DataFrame, estimates: DataFrame, p: Params = DEFAULTS, keep: Keep = _as_is) -> DataFrame:
    """Metrics, price, economics and confidence of each entity, one row."""
    metrics = keep(f.metrics(), "metrics")
    base = metrics.join(X.last_close(closes), "entity_id", "left").join(E.eps_growth(estimates), "entity_id", "left")
    eco = E.economic_view(base, p.economics).withColumn("has_economics", F.lit(True))
    return eco.join(f.sanity(metrics, p).select("entity_id", "confidence"), "entity_id", "left")


def gated(bundles: DataFrame, verdicts: DataFrame, scenarios: DataFrame, targets: DataFrame, calibration: tuple[DataFrame, DataFrame],
          guard: DataFrame, p: Params = DEFAULTS, violations: DataFrame | None = None) -> DataFrame:
    """Every analysed entity with its fair value, reasons and pass flag. The fair value is that of the
    ensemble; ``violations`` (entity_id, sample, ...) names the samples that break a scenario rule."""
    priced = S.implied_price(S.merged_scenarios(scenarios, verdicts, violations), bundles)
    anchor = S.weighted_anchor(priced.filter("horizon = '1'")).select("entity_id", F.col("anchor").alias("fair"))
    v = verdicts.selectExpr("entity_id", "cause AS classification", "insufficient", "moat", "thesis", "status = 'ok' AS has_verdict")
    fair = G.calibrated_fair(v.join(anchor, "entity_id", "left"), *calibration, p.calibration)
    rows = fair.join(bundles, "entity_id", "left").join(targets.select("entity_id", "street_target"), "entity_id", "left")
    return G.digest_gate(rows.withColumn("has_economics", F.coalesce("has_economics", F.lit(False))), guard, p.gate)


def look_snapshot(bundles: DataFrame, documents: DataFrame) -> DataFrame:
    """What a later look at an entity is compared with (input of ``memory.look_diff``). The documents
    of a bundle are few by construction."""
    acc = documents.groupBy("entity_id").agg(F.sort_array(F.collect_set("accession")).alias("accessions"))
    cols = ["as_of_quarter", "price", "revenue_ttm", "gross_pct", "op_pct", "net_debt", "shares"]
    none = F.array().cast("array<string>")
    return bundles.select("entity_id", *cols).join(acc, "entity_id", "left").select("entity_id", F.coalesce("accessions", none).alias("accessions"), *cols)


def without_day(table: DataFrame, column: str, run_date) -> DataFrame:
    """A day that is run again replaces its rows."""
    return table.filter(~F.coalesce(F.col(column) == F.lit(run_date).cast("date"), F.lit(False)))


def nightly(run_date, rows: DataFrame, bundles: DataFrame, merged: DataFrame, ranking: DataFrame, documents: DataFrame, hashes: DataFrame,
            predictions: DataFrame, cooldown: DataFrame, feedback: DataFrame, p: Params = DEFAULTS) -> dict[str, DataFrame]:
    """From gated rows to what a night leaves behind: digest, predictions with the new ones appended,
    cooldown, performance records and look snapshots. Running a day again replaces it.

    rows: output of ``gated``. merged: the ensemble's priced scenarios. ranking: entity_id, rank. hashes: entity_id, hash.
    predictions: ticker, run_date, hash, ...; cooldown: ticker, last_digest_date, hash. A ticker is an entity_id.
    """
    day = F.lit(run_date).cast("date")
    old = without_day(predictions, "run_date", run_date)
    # Entries are those that neither cooldown nor a downvote holds back.
    entries = rows.join(hashes, "entity_id", "left").withColumn("ticker", F.col("entity_id"))
    entries = remembered(entries, without_day(cooldown, "last_digest_date", run_date), feedback, old, run_date, p)
    before = old.filter(F.col("run_date") < day).groupBy(F.col("ticker").alias("entity_id")).agg(F.max("run_date").alias("seen_date"))
    votes = R.last_vote(feedback).select(F.col("ticker").alias("entity_id"), F.col("up").alias("seen_up"))
    digest = G.digest_table(entries.drop("ticker", "hash"), ranking, merged, before.join(votes, "entity_id", "left"), p.gate)
    told = digest.join(entries.select("entity_id", "classification", "hash"), "entity_id")
    fresh = told.select(
        F.col("entity_id").alias("ticker"), day.alias("run_date"), "rank", "classification", "thesis", "hash", F.col("price").alias("ref_price"), "fair", "fair_adjusted",
        "undervaluation_pct", F.col("bear_1y").alias("bear"), F.col("base_1y").alias("base"), F.col("bull_1y").alias("bull"), F.lit(False).alias("graded"),
        F.lit(None).cast("string").alias("note"),
    )
    updates = fresh.select("ticker", F.col("run_date").alias("last_digest_date"), "hash")
    kept = without_day(cooldown, "last_digest_date", run_date).select("ticker", "last_digest_date", "hash")
    return {
        "digest": digest,
        "predictions": old.unionByName(fresh, allowMissingColumns=True),
        "cooldown": R.keyed_upsert(kept, updates, ["ticker"], "last_digest_date"),
        "performance": R.performance_snapshot(bundles, bundles, run_date),
        "snapshots": look_snapshot(bundles, documents).withColumn("run_date", day),
    }


def weekly(predictions: DataFrame, bars: DataFrame, benchmark, filings: DataFrame, grades: DataFrame, as_of, keep: Keep = _as_is,
           universe: DataFrame | None = None):
    """Outcomes of every prediction, then what the next nightly run reads: overall and
    per-class bias, the fast guard, class drift; and, given the universe, whose kill-switches
    are due for grading."""
    asks = predictions.selectExpr("ticker", "run_date", "ticker AS entity_id", "run_date AS since")
    actions = FO.corporate_action_scan(asks, filings).select("ticker", "run_date", "action")
    ledger = keep(K.scored(predictions, bars, benchmark, actions, as_of), "ledger_scored")
    due = {} if universe is None else {"due": K.grading_due(ledger, universe, as_of).select("ticker", "run_date")}
    return due | {
        "ledger": ledger,
        "calibration": (K.calibration_overall(ledger), K.calibration_by_class(ledger)),
        "guard": G.fast_guard(K.falsifier_rollup(grades)),
        "class_drift": K.class_drift(ledger),
    }


def remembered(entries: DataFrame, cooldown: DataFrame, feedback: DataFrame, predictions: DataFrame, run_date, p: Params = DEFAULTS) -> DataFrame:
    """Entries that neither cooldown nor a downvote holds back."""
    kept = R.cooldown_filter(entries, cooldown, run_date, p.screen.cooldown_days)
    return R.downvote_suppress(kept, feedback, predictions, run_date, p.memory)


def on_session(run_date, run: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The night's tables, or none on a day without trading: nothing is read then, and nothing changes."""
    day = run_date if isinstance(run_date, date) else date.fromisoformat(run_date)
    return run() if CA.is_session(day) else {}
