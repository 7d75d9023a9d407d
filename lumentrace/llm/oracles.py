"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from lumentrace.llm import url_filters as U

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, {_WORDS} AS ws FROM d),
one AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
win AS (SELECT rid, i, ws[i:i + 7] AS k FROM one),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
hit AS (SELECT rid, count(DISTINCT p) AS r FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.rid, d.doc_id, d.source, len(ws) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(dl.n, 0) AS n_dup_lines, coalesce(hit.r, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN hit USING (rid) LEFT JOIN dl USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
p AS (SELECT avg(f / n) AS mu, var_pop(f / n) AS v FROM h),
s AS (SELECT mu, CASE WHEN v > mu * (1 - mu) / 1e6 THEN greatest(mu * (1 - mu) / v - 1, 1.0) ELSE 1e6 END AS k FROM p),
bad AS (SELECT source, (f + mu * k) / (n + k) > 0.5 AS bad FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM b JOIN bad ON b.source IS NOT DISTINCT FROM bad.source
"""

_OP8 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') AS er, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>' || er || '<|text|>' || et || '<|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _op3() -> str:
    fits = []
    for verdict, rule in U.RULES:
        host, path = rule.split("/", 1)
        fits.append(f"('{host}', '/{path}', '{rule}', '{verdict}')")
    steps = [
        f"""s{i} AS (SELECT host, kind, CAST(sum(score) AS HUGEINT) AS score FROM (
  SELECT host, kind, score * {100 - U.DAMPING_PERCENT} // 100 AS score FROM s0
  UNION ALL SELECT f.dst, f.kind, s.score * w // total * {U.DAMPING_PERCENT} // 100
  FROM s{i - 1} s JOIN flow f ON s.host = f.src AND s.kind = f.kind) GROUP BY host, kind)"""
        for i in range(1, U.ROUNDS + 1)
    ]
    return rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, html,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(rhost, rpath, rule, v) AS (VALUES {', '.join(fits)}),
fit AS (SELECT rid, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS ruled FROM p JOIN r
  ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY rid),
m AS (SELECT p.*, rule, ruled FROM p LEFT JOIN fit USING (rid)),
hosts AS (SELECT DISTINCT host FROM p),
linked AS (SELECT host AS src, translate(regexp_extract(link, '^(?:[^/]*:)?//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM (SELECT host, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{U.LINK.replace("'", "''")}', 1))) AS link FROM p)),
up AS (SELECT host, substr(host, instr(host, '.') + 1) AS parent FROM hosts WHERE host LIKE '%.%'),
family AS (SELECT host, parent FROM up WHERE parent LIKE '%.%'),
edges AS (SELECT src, dst, count(*) AS w FROM (SELECT * FROM linked UNION ALL SELECT host, parent FROM family UNION ALL SELECT parent, host FROM family)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
flow AS (SELECT src, dst, 0 AS kind, w, CAST(sum(w) OVER (PARTITION BY src) AS HUGEINT) AS total FROM edges
  UNION ALL SELECT dst, src, 1, w, CAST(sum(w) OVER (PARTITION BY dst) AS HUGEINT) FROM edges),
seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM m WHERE host <> '' GROUP BY host),
s0 AS (SELECT * FROM (SELECT host, 0 AS kind, CAST(a AS HUGEINT) * {U.UNIT} AS score FROM seeds
  UNION ALL SELECT host, 1, CAST(b AS HUGEINT) * {U.UNIT} FROM seeds) WHERE score > 0),
{", ".join(steps)},
sc AS (SELECT host, coalesce(sum(score) FILTER (kind = 0), 0) AS t, coalesce(sum(score) FILTER (kind = 1), 0) AS d FROM s{U.ROUNDS} GROUP BY host),
n AS (SELECT greatest(coalesce(sum(a), 0), 1) AS a, greatest(coalesce(sum(b), 0), 1) AS b FROM seeds)
SELECT page_id, m.host, path, rule,
  coalesce(ruled, CASE WHEN 100 * coalesce(d, 0) * n.a > {U.THRESHOLD_PERCENT} * coalesce(t, 0) * n.b THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(CAST(coalesce(t, 0) AS HUGEINT) AS VARCHAR) AS trust, CAST(CAST(coalesce(d, 0) AS HUGEINT) AS VARCHAR) AS distrust
FROM m CROSS JOIN n LEFT JOIN sc ON sc.host = m.host
"""


_OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
reps AS (SELECT list_sort(g) AS g, min(doc_id) AS rep, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY ALL),
x AS (SELECT rep, n, unnest(g) AS k FROM reps),
x2 AS (SELECT rep, n, k, count(*) OVER (PARTITION BY k) AS df FROM x),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY df, k) AS p FROM x2),
prefix AS (SELECT rep, n, k FROM ranked WHERE p <= n - CAST(ceil(n * 90 / 100.0) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.rep AS u, b.rep AS v FROM prefix a JOIN prefix b ON a.k = b.k AND a.rep < b.rep AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
links AS (SELECT u, v FROM cand JOIN reps a ON a.rep = u JOIN reps b ON b.rep = v,
  LATERAL (SELECT len(list_intersect(a.g, b.g)) AS i) WHERE 100 * i >= 90 * (a.n + b.n - i)),
reach(a, b) AS (SELECT rep, rep FROM reps UNION SELECT r.a, CASE WHEN l.u = r.b THEN l.v ELSE l.u END FROM reach r JOIN links l ON l.u = r.b OR l.v = r.b),
comp AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(comp.c, s.doc_id) AS component_id
FROM s LEFT JOIN reps ON reps.g = list_sort(s.g) LEFT JOIN comp ON comp.rep = reps.rep
"""

_OP11 = r"""
WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM documents, t),
g AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a,
    CASE WHEN len(w) > 0 THEN 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) END AS p FROM d),
e AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM g),
x AS (SELECT rid, n, unnest(range(n)) AS i, unnest(w) AS word FROM e),
k AS (SELECT rid, n, i, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS g FROM x WHERE n >= 24),
k16 AS (SELECT rid, n, i, hash(g) AS k FROM k WHERE len(g) = 16),
lag AS (SELECT DISTINCT u.rid, v.i - u.i AS q FROM k16 u JOIN k16 v ON u.rid = v.rid AND u.k = v.k AND v.i > u.i AND 3 * (v.i - u.i) <= u.n),
eq AS (SELECT lag.rid, q, u.i FROM lag JOIN x u ON u.rid = lag.rid JOIN x v ON v.rid = u.rid AND v.i = u.i + q AND v.word = u.word),
isle AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS g FROM eq),
long AS (SELECT rid, q, min(i) AS s, count(*) + q AS len FROM isle GROUP BY rid, q, g),
run AS (SELECT rid, s, len, min(q) AS q FROM long WHERE len >= 24 AND len >= 3 * q GROUP BY rid, s, len),
facts AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    arg_min({'s': s, 'len': len, 'q': q}, {'e': -CAST(len AS DOUBLE) / q, 's': s, 'q': q}) AS b FROM run GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM run),
short AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.i) AS c FROM x ANTI JOIN gone ON x.rid = gone.rid AND x.i = gone.i GROUP BY x.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.len AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
  CAST(1000 * b.len // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM e LEFT JOIN facts USING (rid) LEFT JOIN short USING (rid)
"""

_OP12 = r"""
WITH p AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
x AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k))),
f AS (SELECT lang, CAST(k AS INT) AS k, phrase, string_split(phrase, ' ') AS w, CAST(count(*) AS HUGEINT) AS a FROM x GROUP BY lang, k, phrase HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
cut AS (SELECT lang, phrase, k, w, a, unnest(range(1, k)) AS c FROM f WHERE k > 1),
s AS (SELECT cut.lang, cut.phrase, cut.a, h.a AS l, t.a AS r, n, c, 1000 * cut.a * n // (h.a * t.a) AS score FROM cut
  JOIN f h ON h.lang = cut.lang AND h.phrase = array_to_string(cut.w[1:c], ' ') JOIN f t ON t.lang = cut.lang AND t.phrase = array_to_string(cut.w[c + 1:], ' ')
  JOIN n ON n.lang = cut.lang),
best AS (SELECT lang, phrase, a, n, arg_min({'l': l, 'r': r, 'score': score}, {'score': score, 'c': c}) AS b FROM s GROUP BY lang, phrase, a, n),
inside AS (SELECT lang, array_to_string(w[o:o + m - 1], ' ') AS phrase, a FROM (SELECT lang, w, a, k, m, unnest(range(1, k - m + 2)) AS o FROM f, range(2, 5) t(m) WHERE m < k)),
alone AS (SELECT lang, phrase, a, n, b FROM best ANTI JOIN (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY lang, phrase) i
  ON i.lang = best.lang AND i.phrase = best.phrase AND 100 * most >= 100 * best.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank FROM alone)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(b.l AS BIGINT) AS l, CAST(b.r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(b.score AS BIGINT) AS score
FROM r WHERE rank <= 2000
"""

_OP13 = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT rid, vec_id, label, e, sqrt(list_dot_product(e, e)) AS m FROM v WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.m * b.m) >= 0.93),
reach(a, b) AS (SELECT rid, rid FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT reach.a AS rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.b GROUP BY reach.a),
n AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""

ORACLES = {
    "op3_url_filters": _op3(), "op8_chat": _OP8, "op9_ngram_join": _OP9, "op10_quality": _OP10, "op11_periodic_runs": _OP11, "op12_phrases": _OP12,
    "op13_vector_dedup": _OP13,
}
