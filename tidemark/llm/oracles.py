"""DuckDB SQL for the results of the operators that SQL can express."""

from __future__ import annotations

from tidemark.llm.quality_rules import ALPHA, DELTA, RULES, chains, policies

OP2 = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c FROM documents),
r AS (SELECT doc_id, c, first_value(doc_id) OVER (PARTITION BY c ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY c) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(c) AS text_sha256 FROM r
"""


def _op1() -> str:
    def cell(v: int | None) -> str:
        return "NULL::BIGINT" if v is None else str(v)

    tests = ", ".join(f"({c}, {j}, {', '.join(cell(cuts.get(r.name)) for r in RULES)})" for c, j, cuts in policies())
    cuts = ", ".join(f"cut_{r.name}" for r in RULES)
    rejects = " OR ".join(f"coalesce(({r.left}) {'>' if r.above else '<'} ({r.right}) * cut_{r.name}, false)" for r in RULES)
    policy = "concat_ws(', ', " + ", ".join(f"'{r.name} {'>' if r.above else '<'} ' || cut_{r.name}" for r in RULES) + ")"
    best = f"max_by({{'chain': chain, 'level': j, {', '.join(f'{chr(39)}cut_{r.name}{chr(39)}: cut_{r.name}' for r in RULES)}}}, {{'b': b, 'k': -k, 'c': -chain, 'j': -j}})"

    return rf"""
WITH d AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, unnest([0, 1, 2]) AS v(j) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
s AS (
  SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l ON d.doc_id = l.doc_id LEFT JOIN cov ON d.doc_id = cov.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
g AS (SELECT f.*, q FROM f JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id) q ON f.doc_id = q.doc_id WHERE q IS NOT NULL AND NOT base_failed),
c AS (SELECT * FROM (VALUES {tests}) AS v(chain, j, {cuts})),
k AS (
  SELECT stratum, chain, j, {cuts}, count(*) FILTER (WHERE q = 1) AS n, count(*) FILTER (WHERE q = 1 AND ({rejects})) AS k, count(*) FILTER (WHERE q = 0 AND ({rejects})) AS b
  FROM g, c GROUP BY stratum, chain, j, {cuts} HAVING n > 0),
p AS (
  SELECT *, CASE WHEN k >= n * {ALPHA} THEN 1.0 ELSE (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))) FROM unnest(range(0, k + 1)) AS u(i)) END AS p
  FROM k),
o AS (SELECT *, max(p) OVER (PARTITION BY stratum, chain ORDER BY j) * (SELECT count(*) FROM (SELECT DISTINCT stratum FROM k)) * {len(chains())} <= {DELTA} AS proved FROM p),
x AS (SELECT stratum AS s, unnest({best}) FROM o WHERE proved GROUP BY stratum)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejects}) AS kept, f.stratum,
  CASE WHEN chain IS NOT NULL THEN {policy} END AS policy
FROM f LEFT JOIN x ON f.stratum IS NOT DISTINCT FROM x.s
"""


_TURN = "'<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)"
_SPANS = """array_to_string(list_filter(list_transform(range(1, len({r}) + 1), lambda i: CASE WHEN {r}[i].role = 'assistant' THEN
  (coalesce(list_sum(list_transform({r}[1:i - 1], lambda x: length({t}))), 0) + 5 + length({r}[i].role))::BIGINT || '-' || list_sum(list_transform({r}[1:i], lambda x: length({t})))::BIGINT END), lambda y: y IS NOT NULL), ',')"""
OP4 = f"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT DISTINCT * FROM conversations) WHERE conv_id IS NOT NULL),
p AS (
  SELECT pair_id, coalesce(list({{'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (WHERE c), []) AS a,
    coalesce(list({{'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (WHERE NOT c), []) AS b FROM t GROUP BY pair_id),
n AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i].role = b[i].role AND a[i].text = b[i].text), false), 0) - 1, least(len(a), len(b))) AS n FROM p),
r AS (SELECT pair_id, n, a, b, a[n + 1:] AS ra, b[n + 1:] AS rb FROM n),
s AS (
  SELECT pair_id, n::BIGINT AS n_common, array_to_string(list_transform(a[1:n], lambda x: {_TURN}), '') AS prompt,
    CASE WHEN len(a) > 0 THEN array_to_string(list_transform(ra, lambda x: {_TURN}), '') END AS chosen, CASE WHEN len(a) > 0 THEN {_SPANS.format(r='ra', t=_TURN)} END AS chosen_spans,
    CASE WHEN len(b) > 0 THEN array_to_string(list_transform(rb, lambda x: {_TURN}), '') END AS rejected, CASE WHEN len(b) > 0 THEN {_SPANS.format(r='rb', t=_TURN)} END AS rejected_spans
  FROM r)
SELECT *, coalesce(chosen_spans <> '' AND rejected_spans <> '', false) AS usable FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1(), "op2_exact_dedup": OP2, "op4_preference_format": OP4}
