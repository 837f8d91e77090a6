"""DuckDB SQL of the corpus operators that SQL can express."""

from __future__ import annotations

from riverbend.llm.linededup import LEADING, LIKENESS, LONG, LONG_DOCS, MIN_DOCS, ROUNDS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[0-9a-z\x{80}-\x{10FFFF}]+')"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS n, sha1(payload) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, n::bigint AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d.h, ((i // 4) * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f ON d.h = f.h
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id::varchar AS item_id, {_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, p AS ip, array_to_string(ws[p:p + 9], ' ') AS g FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) u(p) WHERE len(ws) > 0),
o AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM w), unnest(range(1, greatest(len(ws) - n + 2, 1))) u(p)),
h AS (SELECT doc_id, item_id, o.n, p, ip FROM o JOIN w ON o.g = w.g AND o.n = w.n),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(range(p, p + n)) u(q) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id),
runs AS (SELECT doc_id, item_id, n, p, p - row_number() OVER (PARTITION BY doc_id, item_id, p - ip ORDER BY p) AS run, p - ip AS diagonal FROM h),
longest AS (SELECT doc_id, max(size) AS longest FROM (SELECT doc_id, count(*) + max(n) - 1 AS size FROM runs GROUP BY doc_id, item_id, diagonal, run) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::bigint AS longest_match
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id LEFT JOIN longest ON d.doc_id = longest.doc_id
"""



def _line_dedup() -> str:
    """Every round of the template tree: totals, counts by position, constants, the position of a split, what fits, and the groups of the rest."""
    rounds = []
    for r in range(ROUNDS):
        rounds.append(f"""
s{r} AS (SELECT grp, sum(n) AS total, max(need) AS need FROM l{r} GROUP BY grp HAVING sum(n) >= max(need)),
a{r} AS (SELECT l.grp, pos, t[pos] AS token, sum(n) AS n, any_value(s.total) AS total, any_value(s.need) AS need FROM l{r} l JOIN s{r} s ON l.grp = s.grp, unnest(range(1, len(t) + 1)) u(pos) GROUP BY l.grp, pos, t[pos]),
m{r} AS (SELECT * FROM a{r} WHERE n >= need AND n < total AND NOT regexp_matches(token, '[0-9]')),
p{r} AS (SELECT grp, pos FROM (SELECT grp, pos, sum(n) AS held, count(*) AS ways FROM m{r} GROUP BY grp, pos) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY held DESC, ways DESC, pos) = 1),
f{r} AS (SELECT l.grp, l.ln, any_value(l.t) AS t, any_value(l.n) AS n, any_value(l.need) AS need, count(c.token) >= {LIKENESS}::double * any_value(len(l.t)) AS fits
  FROM (SELECT l.*, pos FROM l{r} l JOIN s{r} s ON l.grp = s.grp, unnest(range(1, len(t) + 1)) u(pos)) l LEFT JOIN a{r} c ON l.grp = c.grp AND l.pos = c.pos AND l.t[l.pos] = c.token AND c.n * 2 > c.total GROUP BY l.grp, l.ln),
l{r + 1} AS (SELECT CASE WHEN g.some THEN f.grp || '/rest' ELSE f.grp || '/' || p.pos || '/' || coalesce(a.token, '<*>') END AS grp, ln, t, f.n, f.need
  FROM f{r} f JOIN (SELECT grp, bool_or(fits) AS some FROM f{r} GROUP BY grp) g ON f.grp = g.grp LEFT JOIN p{r} p ON f.grp = p.grp LEFT JOIN m{r} a ON a.grp = p.grp AND a.pos = p.pos AND a.token = f.t[p.pos]
  WHERE NOT fits AND (g.some OR p.pos IS NOT NULL)),""")
    fits = " UNION ALL ".join(f"SELECT ln, need, '{r} ' || grp AS template FROM f{r} WHERE fits" for r in range(ROUNDS))
    return rf"""
WITH src AS (SELECT doc_id, text, coalesce('id ' || doc_id, 'row ' || row_number() OVER ()) AS doc FROM documents),
l AS (SELECT doc, ln, regexp_extract_all(ln, '[^\x20\x09-\x0D]+') AS t FROM (SELECT doc, unnest(string_split(text, chr(10))) AS ln FROM src WHERE text IS NOT NULL) WHERE regexp_matches(ln, '[^\x20\x09-\x0D]')),
k AS (SELECT DISTINCT doc, ln, t, CASE WHEN len(t) > {LONG} THEN {LONG_DOCS} ELSE {MIN_DOCS} END AS need, (len(t), list_transform(t[1:{LEADING}], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END))::varchar AS leaf FROM l),
kinds AS (SELECT leaf, ln, any_value(t) AS t, any_value(need) AS need, count(*) AS n FROM k GROUP BY leaf, ln),
l0 AS (SELECT leaf AS grp, ln, t, n, need FROM kinds WHERE leaf IN (SELECT leaf FROM kinds GROUP BY leaf HAVING sum(n) >= max(need) AND count(*) > 1)),{"".join(rounds)}
fit AS ({fits}),
gone AS (SELECT template FROM (SELECT DISTINCT template, need, doc FROM k JOIN (SELECT ln, template FROM fit) f ON k.ln = f.ln) GROUP BY template, need HAVING count(*) >= need),
bad AS (SELECT ln FROM kinds WHERE n >= need UNION SELECT ln FROM fit JOIN gone ON fit.template = gone.template),
lines AS (SELECT doc, p, ln FROM (SELECT doc, string_split(text, chr(10)) AS ls FROM src WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) u(p), LATERAL (SELECT ls[p] AS ln)),
kept AS (SELECT doc, count(*) FILTER (regexp_matches(lines.ln, '[^\x20\x09-\x0D]')) AS n_lines, count(bad.ln) AS n_dropped, string_agg(CASE WHEN bad.ln IS NULL THEN lines.ln END, chr(10) ORDER BY p) AS left_text FROM lines LEFT JOIN bad ON lines.ln = bad.ln GROUP BY doc)
SELECT d.doc_id, coalesce(n_lines, 0)::bigint AS n_lines, coalesce(n_dropped, 0)::bigint AS n_dropped, CASE WHEN text IS NOT NULL THEN sha256(coalesce(left_text, '')) END AS text_sha256
FROM src d LEFT JOIN kept ON d.doc = kept.doc
"""


LINE_DEDUP = _line_dedup()

URL_RULES = f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_LOWER.format("regexp_extract(coalesce(rest, ''), '^[^/?#]*')")} AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
k AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(rule_host, rule_path, verdict)),
f AS (SELECT page_id, host, path, rule_host || rule_path AS rule, verdict FROM h JOIN k ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled FROM f GROUP BY page_id)
SELECT h.page_id, host, path, rule, ruled FROM h LEFT JOIN best ON h.page_id = best.page_id
"""

# Targets: a source is full when its cap is under its share of what is left; such sources are taken out, the fullest first, until none is.
MIX_TARGETS = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
s AS (SELECT source, sum(size)::bigint AS n, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::double AS w FROM d GROUP BY source),
rounds(step, full_) AS (
  SELECT 0, []::varchar[]
  UNION ALL
  SELECT step + 1, (SELECT list(coalesce('s' || source, 'null')) FROM s WHERE list_contains(r.full_, coalesce('s' || source, 'null'))
      OR w * ((SELECT 1.5 * sum(n) FROM s) - coalesce((SELECT sum(2.0 * n) FROM s x WHERE list_contains(r.full_, coalesce('s' || x.source, 'null'))), 0)) / (SELECT sum(w) FROM s x WHERE NOT list_contains(r.full_, coalesce('s' || x.source, 'null'))) > 2.0 * n)
  FROM rounds r WHERE step < (SELECT count(*) FROM s)),
last AS (SELECT coalesce(full_, []) AS full_ FROM rounds ORDER BY step DESC LIMIT 1),
t AS (SELECT source, n, CASE WHEN list_contains(full_, coalesce('s' || source, 'null')) THEN 2.0 * n
    ELSE w * ((SELECT 1.5 * sum(n) FROM s) - coalesce((SELECT sum(2.0 * n) FROM s x WHERE list_contains(full_, coalesce('s' || x.source, 'null'))), 0)) / (SELECT sum(w) FROM s x WHERE NOT list_contains(full_, coalesce('s' || x.source, 'null'))) END AS target FROM s, last)
SELECT doc_id, size, t.n AS source_size, round(target::double, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

ORACLE_SQL = {"url_rules": URL_RULES, "mix_targets": MIX_TARGETS, "op6_warc": WARC, "op9_line_dedup": LINE_DEDUP, "op10_decontaminate": DECONTAMINATE}
