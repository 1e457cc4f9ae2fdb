"""Small fixtures written as literals."""

from __future__ import annotations

from datetime import date

from talus.operators import series as S


def d(x: str | None) -> date | None:
    return date.fromisoformat(x) if x else None


def facts(spark, rows, concept="revenue", kind="duration"):
    """rows: (start, end, val[, filed])."""
    data = [(d(r[0]), d(r[1]), float(r[2]), f"a{i}", d(r[3] if len(r) > 3 else "2026-01-01"), i) for i, r in enumerate(rows)]
    raw = spark.createDataFrame(data, "p_start date, p_end date, val double, accn string, filed date, pos int")
    return S.as_facts(raw, "T", concept, kind)


def quarters(spark, concepts: dict[str, list[tuple[str, float]]], entity="T"):
    """Ready quarterly rows per concept."""
    out = []
    for c, pts in concepts.items():
        pts = sorted(pts)
        for i, (end, val) in enumerate(pts):
            out.append((entity, c, d(end), d(end), float(val), "acc", "direct", len(pts) - i, i + 1))
    return spark.createDataFrame(
        out, "entity_id string, concept string, p_start date, p_end date, val double, accn string, derived string, rn int, idx int"
    )


def instants(spark, concepts: dict[str, list[tuple[str, float]]], entity="T"):
    out = []
    for c, pts in concepts.items():
        pts = sorted(pts)
        out += [(entity, c, d(end), float(val), "acc", len(pts) - i) for i, (end, val) in enumerate(pts)]
    return spark.createDataFrame(out, "entity_id string, concept string, p_end date, val double, accn string, rn int")


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()
