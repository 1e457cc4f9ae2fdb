"""DuckDB twins of the operators that SQL can express: plain searches through all pairs."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11 = f"""
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT AS rank,
         s.id AS negative_id, positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id
  WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT * FROM n WHERE rank <= 5
"""


def _op13(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds, each an assignment over all pairs and the floors of the means."""
    near = """SELECT x.p, x.vec_id, min(struct_pack(d := list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.c) + list_inner_product(b.c, b.c), j := b.j)) AS best
  FROM x JOIN b{i} AS b ON x.p = b.p GROUP BY x.p, x.vec_id"""
    steps = [f"""
r AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE {_FINITE}),
x AS MATERIALIZED (SELECT p::INT AS p, vec_id, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM r, range({parts}) AS t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, v AS c FROM x QUALIFY j < {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT p, j, list(c ORDER BY z) AS c FROM (
    SELECT a.p, a.best.j AS j, z, floor(sum(x.v[z]) / count(*)) AS c FROM a{i} AS a JOIN x ON a.p = x.p AND a.vec_id = x.vec_id, range(1, 1 + len(x.v)) AS t(z) GROUP BY ALL) GROUP BY p, j)""")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.c, b.c) AS c FROM b{i} AS b LEFT JOIN m{i} AS m ON b.p = m.p AND b.j = m.j)")
    last = rounds
    steps.append(f"k AS (SELECT vec_id, string_agg(printf('%02x', best.j::INT), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{last} GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b{last})")
    return f"WITH {', '.join(steps)} SELECT k.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN r ON k.vec_id = r.vec_id, h"


OP13 = _op13()
