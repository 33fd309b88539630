"""SQL of the queries of this package that SQL can express, for DuckDB."""

from __future__ import annotations

FILTERS = "ABCDE"


def _filter_audit() -> str:
    """Every order is walked document by document; nothing is shared with the operator's sums."""
    failed = ", ".join(f"f{x}" for x in FILTERS)
    return f"""
    WITH RECURSIVE measured AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '') AS words
      FROM documents),
    tested AS (
      SELECT doc_id, part, len(words) < 50 AS fA, 100 * len(list_distinct(words)) < 65 * len(words) AS fB,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS fC,
             regexp_matches(t, '[#$%&*|]') AS fD, doc_id > min(doc_id) OVER (PARTITION BY t) AS fE
      FROM measured),
    marked AS (
      SELECT t.*, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
      FROM tested t LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l
        USING (doc_id)),
    kinds AS (
      SELECT part, {failed}, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
      FROM marked GROUP BY part, {failed}),
    orders(o) AS (
      SELECT '' UNION ALL
      SELECT o || x FROM orders, (VALUES {", ".join(f"('{x}')" for x in FILTERS)}) v(x) WHERE NOT contains(o, x)),
    steps AS (
      SELECT o AS filter_order, CAST(s AS INTEGER) AS step, substr(o, s, 1) AS filter, substr(o, 1, s - 1) AS earlier
      FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
    walked AS (
      SELECT k.part, s.filter_order, s.step, s.filter, k.n, k.good, k.toxic,
             {" OR ".join(f"(s.filter = '{x}' AND k.f{x})" for x in FILTERS)} AS fails,
             {" OR ".join(f"(contains(s.earlier, '{x}') AND k.f{x})" for x in FILTERS)} AS gone,
             {" + ".join(f"CAST(k.f{x} AS INT)" for x in FILTERS)} AS n_failed
      FROM kinds k, steps s),
    summed AS (
      SELECT part, filter_order, step, filter,
             CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
             CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
             CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
             CAST(sum(CASE WHEN fails AND n_failed = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
             CAST(sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
             CAST(sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM walked GROUP BY ALL)
    SELECT s.* EXCLUDE (filter), t.shapley FROM summed s JOIN (
      SELECT part, filter, CAST(sum(removed) AS BIGINT) AS shapley FROM summed GROUP BY ALL) t USING (part, filter)"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every part against every entry, round by round."""
    text = f"""
    WITH kept AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cut AS MATERIALIZED (
      SELECT vec_id, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x
      FROM kept, range({parts}) r(p)),
    book0 AS MATERIALIZED (
      SELECT p, e, x AS c FROM cut JOIN (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id))"""
    for k in range(rounds + 1):
        text += f""",
    near{k} AS MATERIALIZED (
      SELECT vec_id, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (
        SELECT vec_id, a.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM cut a JOIN book{k} b ON a.p = b.p) GROUP BY vec_id, p)"""
        if k < rounds:
            text += f""",
    mean{k} AS MATERIALIZED (
      SELECT p, e, list(m ORDER BY i) AS c FROM (
        SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
          SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n
          FROM near{k}, range(1, 4097) r(i) WHERE i <= len(x) GROUP BY p, best.e, i)) GROUP BY p, e),
    book{k + 1} AS MATERIALIZED (
      SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))"""
    return text + f""",
    coded AS (
      SELECT vec_id, string_agg(lower(printf('%02x', CAST(best.e AS INTEGER))), '' ORDER BY p) AS code,
             CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id),
    named AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (vec_id), named"""


FILTER_AUDIT = _filter_audit()
VECTOR_CODES = _vector_codes()
