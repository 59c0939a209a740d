"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .mixing import DEFAULT, DIMENSIONS, OTHER, SETTLED, Mix
from .queries import URL_RULES


def _url_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return f"""
WITH rules(verdict, rh, rp) AS (VALUES {rules}),
a AS (SELECT page_id, row_number() OVER () AS n, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
b AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT b.n, max({{'len': length(rh || rp), 'rule': rh || rp, 'verdict': verdict}}) AS best FROM b JOIN rules
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY b.n)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN regexp_matches(host, '\\bspam-|\\bcheap-pills\\b|\\bcasino-|\\bfree-bets\\b|\\badult-|\\bads-track\\b') THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN c USING (n)"""


def mixing_sql(docs: str = "documents", mix: Mix = DEFAULT, columns: str = "") -> str:
    """The sample of mixing.mix_sources as SQL: the rounds are unrolled."""
    has = {d: mix.shares(d) for d in DIMENSIONS}
    of = lambda e, d: f"CASE WHEN {e} IN ({', '.join(repr(k) for k in has[d] if k != OTHER)}) THEN {e} ELSE '{OTHER}' END"
    topic = "CASE WHEN contains(t, ' | ') THEN 'table' WHEN length(t) < 600 THEN 'short' WHEN length(t) >= 6000 THEN 'long' ELSE 'prose' END"
    parts = [
        f"d AS (SELECT *, coalesce(text, '') AS t FROM {docs})",
        f"e AS MATERIALIZED (SELECT * EXCLUDE (t), {of('source', 'source')} AS _source, {of('lang', 'lang')} AS _lang, {of(f'({topic})', 'topic')} AS _topic, "
        "CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(replace(t, ' ', ''), chr(10), '')) + 1 END AS _tokens FROM d)",
        "k AS MATERIALIZED (SELECT _source, _lang, _topic, sum(_tokens)::BIGINT AS tokens FROM e GROUP BY ALL HAVING sum(_tokens) > 0)",
        "w0 AS MATERIALIZED (SELECT *, tokens::DOUBLE / (SELECT sum(tokens) FROM k) AS w FROM k)",
    ]
    for d in DIMENSIONS:
        rows = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in has[d].items())
        mine = f"v = '{OTHER}'" if has[d][OTHER] == 0 else "false"
        parts += [
            f"h_{d} AS MATERIALIZED (SELECT _{d} AS v, sum(w) AS h, any_value(g) AS g FROM w0 JOIN (VALUES {rows}) AS x(v, g) ON v = _{d} GROUP BY _{d})",
            f"r_{d}_0 AS (SELECT *, CASE WHEN {mine} THEN h END AS val FROM h_{d})",
        ]
        left = "greatest(1 - sum(coalesce(val, 0)) OVER (), 0) / nullif(sum(CASE WHEN val IS NULL THEN g ELSE 0 END) OVER (), 0)"
        for i in range(SETTLED):
            parts.append(f"r_{d}_{i + 1} AS (SELECT v, h, g, CASE WHEN val IS NOT NULL THEN val WHEN g * s > {mix.boost} * h THEN {mix.boost} * h END AS val FROM (SELECT *, {left} AS s FROM r_{d}_{i}))")
        parts.append(f"g_{d} AS MATERIALIZED (SELECT v, e / sum(e) OVER () AS g FROM (SELECT v, coalesce(val, g * s, h) AS e FROM (SELECT *, {left} AS s FROM r_{d}_{SETTLED})))")
    last, n = "w0", 0
    for _ in range(mix.rounds):
        for d in DIMENSIONS:
            n += 1
            parts.append(
                f"w{n} AS MATERIALIZED (SELECT _source, _lang, _topic, tokens, w * coalesce(g / nullif(sum(w) OVER (PARTITION BY _{d}), 0), 0) AS w FROM {last} JOIN g_{d} ON v = _{d})"
            )
            last = f"w{n}"
    parts.append(f"r AS (SELECT *, w / tokens AS ratio, sum(tokens) OVER () AS total FROM {last})")
    if mix.budget is None:
        parts.append("p AS MATERIALIZED (SELECT _source, _lang, _topic, coalesce(ratio / nullif(max(ratio) OVER (), 0), 0) AS p FROM r)")
    else:
        parts += [
            f"f AS (SELECT *, ({mix.budget} * total - coalesce(sum(tokens) OVER (ORDER BY ratio DESC, _source, _lang, _topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) "
            "/ sum(w) OVER (ORDER BY ratio DESC, _source, _lang, _topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM r)",
            "p AS MATERIALIZED (SELECT _source, _lang, _topic, CASE WHEN ratio > 0 THEN least(1.0::DOUBLE, coalesce(max(CASE WHEN f * ratio <= 1 THEN f END) OVER (), 'inf'::DOUBLE) * ratio) ELSE 0 END AS p FROM f)",
        ]
    chosen = columns or "doc_id, _source AS source_cell, _lang AS lang_cell, _topic AS topic_cell, _tokens::BIGINT AS tokens, round(p, 6) AS p"
    draw = f"('0x' || substr(md5(concat('{mix.seed}:', doc_id::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    return "WITH " + ",\n".join(parts) + f"\nSELECT {chosen} FROM e LEFT JOIN p USING (_source, _lang, _topic) WHERE {draw} < coalesce(p, 1.0)"


ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing_sql(),
    "op7_url_filter": _url_sql(),
}
