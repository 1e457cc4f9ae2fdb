"""Restated, cumulative filing facts to clean quarterly, annual and instant series.

Input ``facts``: entity_id, taxonomy, tag, unit, p_start, p_end, val, accn, form, filed, pos
(``pos`` = position in the file; it decides every tie). Period identity is the pair of dates.

Skew: raw facts are first reduced by a map-side-combinable aggregate on the full period key, so
what reaches the entity windows is at most one row per entity, tag and period, however many
filings repeat it. Those windows all start with ``entity_id``; one hash exchange serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus import params as P
from talus.params import DEFAULTS, SeriesParams

# The order of chosen facts within a task.
PLACED = ("entity_id", "cid", "tid", "unit", "p_start", "p_end")
_Q, _I, _T = range(3)  # quarter, instant, tag

FACT_STRUCT = (
    "struct<start:date,end:date,val:double,accn:string,form:string,filed:date>"
)
NESTED_FACTS = f"map<string,map<string,struct<units:map<string,array<{FACT_STRUCT}>>>>>"


def literal_rows(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A few constant rows as a local relation (no Python worker, no job)."""
    values = ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, float)) else f"'{v}'" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS v({', '.join(names.split())})")


def concept_dim(spark: SparkSession) -> DataFrame:
    """Concept dictionary as rows; its size is fixed by the code, so it is safe to broadcast.
    ``tid`` numbers the tags: hundreds for the concept, units for the place in its chain."""
    rows = [
        (cid * 100 + rank, name, taxonomy, unit, kind, tag)
        for cid, (name, taxonomy, unit, kind, tags) in enumerate(P.CONCEPTS)
        for rank, tag in enumerate(tags)
    ]
    return literal_rows(spark, "tid concept taxonomy pref_unit kind tag", rows)


def facts_explode(payloads: DataFrame, id_col: str = "entity_id", json_col: str = "payload") -> DataFrame:
    """Nested taxonomy -> tag -> unit -> facts documents (JSON text or already parsed) to long
    rows, keeping the position inside its unit and the unit's own place (``unit_no``)."""
    is_text = payloads.schema[json_col].dataType.simpleString() == "string"
    parsed = payloads.select(id_col, (F.from_json(json_col, NESTED_FACTS) if is_text else F.col(json_col)).alias("m"))
    by_taxonomy = parsed.select(id_col, F.explode("m").alias("taxonomy", "tags"))
    by_tag = by_taxonomy.select(id_col, "taxonomy", F.explode("tags").alias("tag", "body"))
    by_unit = by_tag.select(id_col, "taxonomy", "tag", F.posexplode("body.units").alias("unit_no", "unit", "facts"))
    return by_unit.select(id_col, "taxonomy", "tag", "unit", "unit_no", F.posexplode("facts").alias("pos", "f")).select(
        id_col,
        "taxonomy",
        "tag",
        "unit",
        "unit_no",
        F.col("f.start").alias("p_start"),
        F.col("f.end").alias("p_end"),
        F.col("f.val").alias("val"),
        F.col("f.accn").alias("accn"),
        F.col("f.form").alias("form"),
        F.col("f.filed").alias("filed"),
        "pos",
    )


def _names(rows: DataFrame, aggregates: tuple[Column, ...]) -> list[str]:
    return rows.agg(*aggregates).columns if aggregates else []


def latest_filed(facts: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """One row per key: the latest filed wins, ties keep the first seen. ``first_pos`` is where
    the key first appeared. ``more`` are further aggregates."""
    best = F.max(F.struct("filed", (-F.col("pos")).alias("p"), "val", "accn"))
    return (
        facts.groupBy(*keys)
        .agg(best.alias("b"), F.min("pos").alias("first_pos"), *more)
        .select(*keys, F.col("b.val").alias("val"), F.col("b.accn").alias("accn"), F.col("b.filed").alias("filed"),
                (-F.col("b.p")).alias("pos"), "first_pos", *_names(facts, more))
    )


def period_dedup(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Latest filed fact per (keys, start, end); rows without a start are dropped."""
    return latest_filed(facts.filter(F.col("p_start").isNotNull()), [*keys, "p_start", "p_end"])


def instant_dedup(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Latest filed fact per (keys, end)."""
    return latest_filed(facts, [*keys, "p_end"])


def period_classify(periods: DataFrame, p: SeriesParams = DEFAULTS.series) -> DataFrame:
    """Adds ``days`` and ``kind``: quarter, annual or null."""
    d = F.datediff("p_end", "p_start")
    return periods.withColumn("days", d).withColumn(
        "period_kind",
        F.when(d.between(*p.quarter_days), "quarter").when(d.between(*p.annual_days), "annual"),
    )


def choose_tags(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Facts of the chosen tag per (entity, concept), already reduced to one row per period.

    The tag whose newest end is strictly later wins, ties go to the earlier tag of the chain;
    within a tag the preferred unit is used, else the first one in the file: by ``unit_no`` where
    the facts carry it, then by position. A tag has exactly one unit.

    Facts shrink to one row per period before they move; those rows are dealt out by entity once, and
    sorted once by concept, tag, unit and period: the choice of unit and tag and the windows of
    ``series_points`` after it use that order. ``cid`` and ``tid`` are the numbers of concept and tag;
    ``last`` marks one row of each entity and concept.
    """
    # Facts travel and sort under small numbers; the dictionary's names join them at the end. Units are
    # told apart by their first place; where facts have no ``unit_no``, the position alone tells.
    mapped = facts.join(F.broadcast(concepts.select("taxonomy", "tag", "tid")), ["taxonomy", "tag"])
    places = [F.min("unit_no").alias("unit_no")] if "unit_no" in facts.columns else []
    rows = latest_filed(mapped, ["entity_id", "tid", "unit", "p_start", "p_end"], *places).repartition("entity_id")
    rows = rows.join(F.broadcast(concepts.select("tid", "pref_unit")), "tid").withColumn("other", F.col("unit") != F.col("pref_unit")).drop("pref_unit")
    rows = rows.withColumn("cid", F.expr("tid div 100")).sortWithinPartitions(*PLACED)
    # The least place of a unit's rows is the unit's place, and the newest end of a tag's rows the tag's.
    at = F.struct("other", *["unit_no" for _ in places], "first_pos", "unit")
    by_tag, by_concept = (Window.partitionBy("entity_id", *keys) for keys in (["cid", "tid"], ["cid"]))
    rows = rows.withColumn("first_unit", F.min(at).over(by_tag)["unit"]).filter("unit = first_unit").drop("first_unit", "other", "unit_no")
    rows = rows.withColumn("best", F.max(F.struct("p_end", (-F.col("tid")).alias("no"), "p_start")).over(by_concept))
    rows = rows.withColumn("last", F.expr("p_end <=> best.p_end AND p_start <=> best.p_start")).filter("-tid = best.no").drop("best")
    return rows.join(F.broadcast(concepts.select("tid", "concept", "kind", "tag")), "tid")


def tag_choice(chosen: DataFrame) -> DataFrame:
    """(entity, concept) -> tag, unit and newest end, from the output of ``choose_tags``."""
    return chosen.groupBy("entity_id", "concept", "tag", "unit").agg(F.max("p_end").alias("newest"))


def quarter_candidates(chosen: DataFrame, p: SeriesParams = DEFAULTS.series) -> DataFrame:
    """Every quarter a duration fact can stand for, in one pass over the facts.

    A fact of quarter length stands for itself ('direct'). A cumulative fact whose predecessor
    (same start, next earlier end) lies one quarter back also stands for the difference
    ('ytd-diff'); the fourth quarter is the year minus nine months by the same rule. ``ord``
    ranks rivals for one end: of two direct facts the later in the file, of two differences
    the start that appeared first.
    """
    by_start = Window.partitionBy("entity_id", "concept", "p_start")
    lo, hi = p.quarter_days
    sized = (
        chosen.filter(F.expr(
            f"kind = 'duration' AND datediff(p_end, p_start) BETWEEN {lo} AND {p.annual_days[1]}"
        ))
        .select(
            "*",
            F.min("first_pos").over(by_start).alias("group_pos"),
            F.lag(F.struct("p_end", "val")).over(by_start.orderBy("p_end")).alias("prev"),
        )
    )
    own, after = _spans(p)
    direct = f"""CASE WHEN {own} THEN struct('direct' AS derived, -first_pos AS ord, p_start, val) END"""
    step = f"""CASE WHEN {after} THEN struct('ytd-diff' AS derived, group_pos AS ord, date_add(prev.p_end, 1) AS p_start, val - prev.val AS val) END"""
    return sized.select(
        "entity_id", "concept", "p_end", "accn", F.inline(F.array_compact(F.array(F.expr(direct), F.expr(step))))
    )


def _spans(p: SeriesParams) -> tuple[str, str]:
    """Whether a fact is a quarter itself, and whether it ends one after ``prev``."""
    lo, hi = p.quarter_days
    return f"datediff(p_end, p_start) BETWEEN {lo} AND {hi}", f"datediff(p_end, prev.p_end) BETWEEN {lo} AND {hi}"


def _resolve(chosen: DataFrame, p: SeriesParams) -> DataFrame:
    # 'direct' sorts before 'ytd-diff'.
    pick = Window.partitionBy("entity_id", "concept", "p_end").orderBy("derived", "ord")
    return (
        quarter_candidates(chosen, p).withColumn("k", F.row_number().over(pick)).filter("k = 1")
        .select("entity_id", "concept", "p_start", "p_end", "val", "accn", "derived")
    )


def ytd_diff(chosen: DataFrame, p: SeriesParams = DEFAULTS.series) -> DataFrame:
    """Differences that fill a quarter no direct fact covers."""
    return _resolve(chosen, p).filter("derived = 'ytd-diff'")


def quarterly_series(chosen: DataFrame, p: SeriesParams = DEFAULTS.series) -> DataFrame:
    """Direct quarters, else differences; newest ``keep_quarters`` per concept.

    Adds ``rn`` (1 = newest) and ``idx`` (1 = oldest kept): every lag downstream counts
    positions, not months.
    """
    newest = Window.partitionBy("entity_id", "concept").orderBy(F.col("p_end").desc())
    return (
        _resolve(chosen, p)
        .withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= p.keep_quarters)
        .withColumn("n", F.count("*").over(Window.partitionBy("entity_id", "concept")))
        .withColumn("idx", (F.col("n") - F.col("rn") + 1).cast("int"))
        .drop("n")
    )


def annual_series(chosen: DataFrame, p: SeriesParams = DEFAULTS.series) -> DataFrame:
    """Fiscal-year facts, newest ``keep_annual``; not deduplicated by end."""
    w = Window.partitionBy("entity_id", "concept").orderBy(F.col("p_end").desc(), F.col("first_pos").desc())
    return (
        period_classify(chosen.filter("kind = 'duration'"), p)
        .filter("period_kind = 'annual'")
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= p.keep_annual)
        .select("entity_id", "concept", "p_start", "p_end", "val", "accn", "rn")
    )


def instant_series(chosen: DataFrame, p: SeriesParams = DEFAULTS.series) -> DataFrame:
    """Point-in-time values, one per end, newest ``keep_quarters``."""
    per_end = Window.partitionBy("entity_id", "concept", "p_end").orderBy(F.col("filed").desc(), "pos")
    newest = Window.partitionBy("entity_id", "concept").orderBy(F.col("p_end").desc())
    return (
        chosen.filter("kind = 'instant'")
        .withColumn("k", F.row_number().over(per_end))
        .filter("k = 1")
        .withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= p.keep_quarters)
        .select("entity_id", "concept", "p_end", "val", "accn", "rn")
    )


def series_points(chosen: DataFrame, p: SeriesParams = DEFAULTS.series) -> DataFrame:
    """The rows of ``quarterly_series`` (part q), ``instant_series`` (part i) and ``tag_choice`` (part t)
    as one table, so that a plan with many branches can be cut by writing it once.

    All three come from one pass over the facts of ``choose_tags``: their order there, then the points
    of a series from the newest, serve every window. Rows stay narrow, names are joined to the result."""
    lo, hi = p.quarter_days[0], p.annual_days[1]
    use = f"CASE WHEN kind = 'instant' THEN {_I} WHEN kind = 'duration' AND datediff(p_end, p_start) BETWEEN {lo} AND {hi} THEN {_Q} END"
    # A concept has one tag and one unit left.
    start = Window.partitionBy(*PLACED[:-1]).orderBy("p_end")
    whole = start.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = chosen.withColumn("use", F.expr(use)).drop("kind", "concept", "tag").select(
        "*", F.lag("p_end").over(start).alias("prev_end"), F.lag("val").over(start).alias("prev_val"),
        F.min(F.when(F.col("use") == _Q, F.col("first_pos"))).over(whole).alias("group_pos"))
    own, after = (x.replace("prev.p_end", "prev_end") for x in _spans(p))
    # The facts of a start come by length, so only the first one of use can have one too short before it.
    after += f" AND datediff(prev_end, p_start) >= {lo}"
    fields = {"part": "int", "p_start": "date", "p_end": "date", "val": "double", "accn": "string", "rival": "bigint", "ord": "bigint"}

    def point(**given: object) -> str:
        return "struct(" + ", ".join(f"cast({given.get(name, 'null')} AS {kind}) AS {name}" for name, kind in fields.items()) + ")"

    # ``rival`` and ``ord`` rank the points of one end, as the separate series do: direct quarters before
    # differences, instants by the day of filing.
    fact = {"p_end": "p_end", "accn": "accn"}
    instant = point(part=_I, **fact, val="val", rival=f"coalesce(-unix_date(filed), {2**31})", ord="pos")
    direct = point(part=_Q, **fact, p_start="p_start", val="val", rival=0, ord="-first_pos")
    step = point(part=_Q, **fact, p_start="date_add(prev_end, 1)", val="val - prev_val", rival=1, ord="group_pos")
    found = f"""array(CASE WHEN use = {_I} THEN {instant} WHEN use = {_Q} AND {own} THEN {direct} END, CASE WHEN use = {_Q} AND {after} THEN {step} END,
        CASE WHEN last THEN {point(part=_T)} END)"""
    points = rows.select("entity_id", "tid", F.inline(F.expr(found))).filter("part IS NOT NULL")
    series = Window.partitionBy("entity_id", "tid", "part")
    newest = F.col("p_end").desc()
    first = points.withColumn("_before", F.lag(F.struct("p_end")).over(series.orderBy(newest, "rival", "ord"))).filter("_before IS NULL OR NOT _before.p_end <=> p_end")
    line = series.orderBy(newest)
    n = F.count("*").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = first.withColumn("rn", F.row_number().over(line)).withColumn("n", n).filter(F.col("rn") <= p.keep_quarters)
    return kept.join(F.broadcast(concept_dim(chosen.sparkSession).select("tid", "concept", F.col("tag").alias("_tag"))), "tid").select(
        "entity_id", "concept", "p_start", "p_end", "val", "accn", F.expr(f"CASE WHEN part = {_Q} THEN CASE WHEN rival = 0 THEN 'direct' ELSE 'ytd-diff' END END AS derived"),
        F.expr(f"CASE WHEN part <> {_T} THEN rn END AS rn"), F.expr(f"CASE WHEN part = {_Q} THEN cast(least(n, {p.keep_quarters}) - rn + 1 AS int) END AS idx"),
        F.expr(f"CASE part WHEN {_Q} THEN 'q' WHEN {_I} THEN 'i' ELSE 't' END AS part"), F.expr(f"CASE WHEN part = {_T} THEN _tag END AS tag"))


def split_points(points: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(quarterly, instants, tags) of such a table."""
    q = points.filter("part = 'q'").select("entity_id", "concept", "p_start", "p_end", "val", "accn", "derived", "rn", "idx")
    i = points.filter("part = 'i'").select("entity_id", "concept", "p_end", "val", "accn", "rn")
    return q, i, points.filter("part = 't'").select("entity_id", "concept", "tag")


def as_facts(df: DataFrame, entity: str, concept: str, kind: str) -> DataFrame:
    """Label raw rows of a single tag so the series operators accept them."""
    return latest_filed(
        df.select(
            F.lit(entity).alias("entity_id"), F.lit(concept).alias("concept"), F.lit(kind).alias("kind"),
            F.lit(concept).alias("tag"), F.lit("USD").alias("unit"),
            "p_start", "p_end", "val", "accn", "filed", "pos",
        ),
        ["entity_id", "concept", "kind", "tag", "unit", "p_start", "p_end"],
    ).withColumn("newest", F.lit(None).cast("date"))
