"""The helpers of ``columns`` as SQL text, for operators with very many expressions: parsing
one string is far cheaper than building the same tree call by call."""

from __future__ import annotations


def jr(x: str, dp: int = 0) -> str:
    """Half toward +infinity."""
    s = f"{10**dp}D"
    return f"(CAST(floor(({x}) * {s} + 0.5D) AS DOUBLE) / {s})"


def pct(frm: str, to: str) -> str:
    return jr(f"try_divide(({to}) - ({frm}), abs({frm})) * 100", 1)


def years(a: str, b: str) -> str:
    return f"(datediff({b}, {a}) / 365.25D)"


def cagr(frm: str, to: str, yrs: str) -> str:
    """Growth per year in percent; null unless the start and the span are positive."""
    return f"CASE WHEN {frm} > 0 AND {yrs} > 0 THEN {jr(f'(pow(({to}) / ({frm}), 1D / ({yrs})) - 1) * 100', 1)} END"
