"""Series operators over filing facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.checks.chains import facts_sql
from talus.checks.registry import Tables, query
from talus.checks.roles import with_roles
from talus.operators import series as S


def chosen(t: Tables, concepts: tuple[str, ...] | None = None):
    """``concepts``: those that the result is made of, else all."""
    dim = S.concept_dim(t.spark)
    return S.choose_tags(t("fx_facts"), dim.filter(F.col("concept").isin(*concepts)) if concepts else dim)


_fact = lambda start, val, tax, tag, unit, pos, unit_no=0: (
    f"SELECT entity_id, '{tax}' AS taxonomy, '{tag}' AS tag, '{unit}' AS unit, {unit_no} AS unit_no, {start} AS p_start, qend AS p_end, "
    f"cast({val} as double) AS val, concat(cast(entity_id as string), '-', cast(qn as string)) AS accn, '10-Q' AS form, "
    f"qend + 40 AS filed, {pos} AS pos FROM cells_y"
)


@query(
    "facts_explode",
    with_roles(
        " UNION ALL ".join([
            _fact("qstart", "rev", "us-gaap", "Revenues", "USD", 0),
            _fact("ystart", "rev_ytd", "us-gaap", "Revenues", "USD", 1),
            _fact("null", "price_c", "us-gaap", "Assets", "USD", 0),
            _fact("null", "tax_c", "us-gaap", "Assets", "EUR", 0, 1),
            _fact("null", "ws", "dei", "EntityCommonStockSharesOutstanding", "shares", 0),
        ]),
        "cells_y",
    ),
)
def _(t):
    return S.facts_explode(t("fx_payloads"))


@query("tag_fallback", facts_sql("SELECT entity_id, concept, tag, unit, newest FROM picks"))
def _(t):
    return S.tag_choice(chosen(t))


@query("tag_fallback_nested", with_roles(
    """SELECT entity_id, 'revenue' AS concept, 'Revenues' AS tag, CASE WHEN entity_id % 2 = 0 THEN 'EUR' ELSE 'CAD' END AS unit, max(qend) AS newest
    FROM cells_y GROUP BY entity_id""", "cells_y"))
def _(t):
    """From nested documents with several units, none of them preferred: the first one counts."""
    value = lambda c: f"""concat('[{{"start":"', cast(qstart AS string), '","end":"', cast(qend AS string), '","val":', cast({c} AS string), ',"accn":"a","form":"10-Q","filed":"', cast(qend AS string), '"}}]')"""
    first, second = ("CASE WHEN entity_id % 2 = 0 THEN '{}' ELSE '{}' END".format(*x) for x in (("EUR", "CAD"), ("CAD", "EUR")))
    payloads = t("cells_y").selectExpr("entity_id", f"""concat('{{"us-gaap":{{"Revenues":{{"units":{{"', {first}, '":', {value('rev')}, ',"', {second}, '":', {value('rev_ytd')}, '}}}}}}}}') AS payload""")
    return S.tag_choice(S.choose_tags(S.facts_explode(payloads), S.concept_dim(t.spark)))


@query(
    "instant_dedup",
    with_roles(
        """SELECT entity_id, tag, unit, p_end, val, accn, filed FROM (SELECT *, row_number() OVER
        (PARTITION BY entity_id, tag, unit, p_end ORDER BY filed DESC, pos) AS k FROM fx_facts WHERE p_start IS NULL) WHERE k = 1""",
        "fx_facts",
    ),
)
def _(t):
    facts = t("fx_facts").filter("p_start IS NULL")
    return S.instant_dedup(facts, ["entity_id", "tag", "unit"]).drop("first_pos", "pos")


_PD = """SELECT entity_id, tag, unit, p_start, p_end, val, accn, filed, p_end - p_start AS days FROM (SELECT *, row_number() OVER
    (PARTITION BY entity_id, tag, unit, p_start, p_end ORDER BY filed DESC, pos) AS k FROM fx_facts WHERE p_start IS NOT NULL) WHERE k = 1"""


@query("period_dedup", with_roles(f"SELECT * EXCLUDE (days) FROM ({_PD})", "fx_facts"))
def _(t):
    return S.period_dedup(t("fx_facts"), ["entity_id", "tag", "unit"]).drop("first_pos", "pos")


@query(
    "period_classify",
    with_roles(
        f"""SELECT entity_id, tag, unit, p_start, p_end, cast(days as integer) AS days, CASE WHEN days BETWEEN 80 AND 100 THEN 'quarter'
        WHEN days BETWEEN 350 AND 380 THEN 'annual' END AS period_kind FROM ({_PD})""",
        "fx_facts",
    ),
)
def _(t):
    p = S.period_classify(S.period_dedup(t("fx_facts"), ["entity_id", "tag", "unit"]))
    return p.select("entity_id", "tag", "unit", "p_start", "p_end", "days", "period_kind")


@query("ytd_diff", facts_sql("SELECT entity_id, concept, p_start, p_end, val, accn FROM diffs"))
def _(t):
    return S.ytd_diff(chosen(t)).drop("derived")


@query(
    "quarterly_series",
    facts_sql("SELECT entity_id, concept, p_start, p_end, val, accn, derived, cast(rn as integer) AS rn, cast(idx as integer) AS idx FROM sq"),
)
def _(t):
    return S.quarterly_series(chosen(t))


@query("annual_series", facts_sql("SELECT * EXCLUDE (rn), cast(rn as integer) AS rn FROM sa"))
def _(t):
    return S.annual_series(chosen(t))


@query("instant_series", facts_sql("SELECT * EXCLUDE (rn), cast(rn as integer) AS rn FROM si"))
def _(t):
    return S.instant_series(chosen(t))
