"""Spelling differences between the two SQL engines, so a role table is written once."""

from __future__ import annotations


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def days(self, a: str, b: str) -> str:
        """b - a in days."""
        return f"datediff({b}, {a})" if self.spark else f"date_diff('day', {a}, {b})"

    def add(self, d: str, n: str) -> str:
        return f"date_add({d}, cast({n} as int))" if self.spark else f"({d} + cast({n} as integer))"

    def arr(self, *xs: str) -> str:
        return f"array({', '.join(xs)})" if self.spark else f"[{', '.join(xs)}]"

    def max_by(self, x: str, *keys: str) -> str:
        ks = ", ".join(keys)
        return f"max_by({x}, struct({ks}))" if self.spark else f"max_by({x}, row({ks}))"

    def min_by(self, x: str, *keys: str) -> str:
        ks = ", ".join(keys)
        return f"min_by({x}, struct({ks}))" if self.spark else f"min_by({x}, row({ks}))"

    def rows(self, src: str, keep: list[str], cols: list[str], rows: list[tuple[str, ...]]) -> str:
        """One output row per input row and entry of ``rows`` (a lateral expansion, no join)."""
        k = ", ".join(keep)
        if self.spark:
            items = ", ".join(
                "struct(" + ", ".join(f"{e} as {c}" for c, e in zip(cols, r)) + ")" for r in rows
            )
            return f"SELECT {k}, inline(array({items})) FROM {src}"
        items = ", ".join("{" + ", ".join(f"'{c}': {e}" for c, e in zip(cols, r)) + "}" for r in rows)
        return f"SELECT {k}, u.* FROM (SELECT {k}, unnest([{items}]) AS u FROM {src}) s"

    def parts(self, src: str, keep: list[str], text: str, mark: str, value: str, pos: str) -> str:
        """One row per part of ``text`` between marks, with its place from 0."""
        k = ", ".join(keep)
        if self.spark:
            literal = "".join(f"\\\\{c}" if c in ".*+?()[]|$^" else c for c in mark)
            return f"SELECT {k}, pos AS {pos}, col AS {value} FROM {src} LATERAL VIEW posexplode(split({text}, '{literal}')) v AS pos, col"
        return f"SELECT {k}, cast(u - 1 as int) AS {pos}, w[u] AS {value} FROM (SELECT {k}, string_split({text}, '{mark}') AS w FROM {src}) s, unnest(range(1, len(w) + 1)) AS t(u)"

    def ratio(self, a: str, b: str) -> str:
        """a / b of doubles, infinite or NaN over zero in both engines."""
        if not self.spark:
            return f"{a} / {b}"
        over_zero = f"CASE WHEN {a} = 0 OR isnan({a}) THEN double('NaN') WHEN {a} > 0 THEN double('Infinity') WHEN {a} < 0 THEN double('-Infinity') END"
        return f"CASE WHEN {b} = 0 THEN {over_zero} ELSE try_divide({a}, {b}) END"

    def cents(self, x: str) -> str:
        return f"cast(floor({x} * 100 + 0.5) as bigint)"

    def secs(self, ts: str) -> str:
        """Whole seconds since 1970."""
        return f"unix_seconds(cast({ts} as timestamp))" if self.spark else f"cast(floor(epoch({ts})) as bigint)"


SPARK, DUCK = Dialect(True), Dialect(False)
