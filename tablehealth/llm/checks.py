"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

import math

from tablehealth.llm import license_scan, quality_rules

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
grams AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
met AS (SELECT grams.doc_id, i, grams.k, item_id FROM grams JOIN win ON grams.g = win.g AND grams.k = win.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
"""


def _pairs(words: str) -> str:
    return f"list_distinct([{words}[j] || ' ' || {words}[j + 1] for j in range(1, len({words}))])"


def licences(least: float = 0.8) -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    texts = [(name, text) for name, group in license_scan.TEMPLATES.items() for text in group]
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(text)}, {list(license_scan.REQUIRED.get(name, ()))}::VARCHAR[])" for i, (name, text) in enumerate(texts))
    return f"""
WITH t AS (SELECT t, licence, w, {_pairs('w')} AS b, must FROM (SELECT t, licence, regexp_extract_all(lower(text), '{license_scan.WORD}') AS w, must FROM (VALUES {values}) v(t, licence, text, must))),
k AS (SELECT t, p, row_number() OVER (PARTITION BY t ORDER BY length(p) DESC, p) AS rank, n FROM (SELECT t, unnest(b) AS p, len(b) AS n FROM t)),
a AS (SELECT t.t, k.p, o, len(w) AS width FROM (SELECT t, w, unnest(range(0, len(w) - 1)) AS o FROM t) t
  JOIN k ON k.t = t.t AND k.p = w[o + 1] || ' ' || w[o + 2] WHERE rank <= n - ceil(n * {least / (2 - least)!r} - 1e-9) + 1),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '{license_scan.WORD}') AS w FROM documents),
h AS (SELECT r, i, w[i + 1] || ' ' || w[i + 2] AS p FROM (SELECT r, w, unnest(range(0, len(w) - 1)) AS i FROM d)),
c AS (SELECT DISTINCT r, t, greatest(0, i - o) AS s, width FROM h JOIN a ON a.p = h.p),
x AS (SELECT r, doc_id, t, s, {_pairs('w')} AS b FROM (SELECT c.r, doc_id, t, s, w[s + 1 : s + width] AS w FROM c JOIN d ON d.r = c.r)),
m AS (SELECT r, doc_id, x.t, licence, 2.0 * len(list_intersect(x.b, t.b)) / (len(x.b) + len(t.b)) AS dice FROM x JOIN t ON t.t = x.t
  WHERE len(list_intersect(must, x.b)) = len(list_intersect(must, t.b)))
SELECT doc_id, count(DISTINCT t) AS n_templates, array_to_string(list_sort(list_distinct(list(licence))), ',') AS licences, CAST(round(max(dice) * 1000) AS BIGINT) AS best_permille
FROM m WHERE dice >= {least} GROUP BY r, doc_id
"""


def quality(reach: float = 3.0, min_group: int = 200) -> str:
    rates = quality_rules.RATES
    values = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, base_failed, '{name}' AS rate, CAST(floor({up} * 1000000 / greatest({down}, 1)) AS BIGINT) AS v, {up} AS up, {down} AS down, {first} AS first, {width} AS width, {share} AS share FROM base"
        for name, up, down, first, width, share in rates)
    growth = f"{math.log(quality_rules.GROWTH)!r}"
    decile = lambda x, share: f"{x}[CAST(ceil(len({x}) * {share}) AS BIGINT)]"
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '{quality_rules.SYMBOLS}')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(w) < {quality_rules.MIN_WORDS} OR 100 * coalesce(r.n, 0) > {quality_rules.MAX_REPEAT_PERCENT} * len(w) AS base_failed
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id),
v AS (SELECT *, CASE WHEN v <= first THEN 0 ELSE CAST(ceil(ln(CAST(v AS DOUBLE) / first) / {growth} - 1e-9) AS INTEGER) END AS b FROM ({values})),
good AS (SELECT * FROM v WHERE NOT base_failed),
own AS (SELECT lang, source, rate, any_value(width) AS width, count(*) AS n, list_sort(list(b)) AS s FROM good GROUP BY lang, source, rate),
lng AS (SELECT lang, rate, count(*) AS n, list_sort(list(b)) AS s FROM good GROUP BY ALL),
al AS (SELECT rate, list_sort(list(b)) AS s FROM good GROUP BY ALL),
pick AS (SELECT o.lang, o.source, o.rate, o.width, CASE WHEN o.n >= {min_group} THEN o.s WHEN l.n >= {min_group} THEN l.s ELSE a.s END AS s
  FROM own o JOIN lng l ON l.lang IS NOT DISTINCT FROM o.lang AND l.rate = o.rate JOIN al a ON a.rate = o.rate),
fence AS (SELECT lang, source, rate, low - {reach} * greatest(middle - low, width) AS lower, high + {reach} * greatest(high - middle, width) AS upper
  FROM (SELECT lang, source, rate, width, {decile('s', 0.1)} AS low, {decile('s', 0.5)} AS middle, {decile('s', 0.9)} AS high FROM pick)),
broken AS (SELECT doc_id, rate, NOT share AND b < lower AS under,
    CASE WHEN share THEN up - allowed > {quality_rules.SIGMAS} * sqrt(allowed) ELSE b > upper END AS over
  FROM (SELECT v.*, f.lower, f.upper, v.down * (v.first / 1e6) * pow({quality_rules.GROWTH}, f.upper) AS allowed
    FROM v JOIN fence f ON f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source AND f.rate = v.rate)),
failed AS (SELECT doc_id, string_agg(CASE WHEN under THEN 'low_' ELSE 'high_' END || rate, ',' ORDER BY list_position({[name for name, *_ in rates]}, rate)) AS failed FROM broken WHERE under OR over GROUP BY doc_id)
SELECT base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept,
  CASE WHEN base_failed THEN '' ELSE coalesce(failed, '') END AS failed
FROM base LEFT JOIN failed ON failed.doc_id = base.doc_id
"""


_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
total AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS said FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(said * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


#: crc32 of a text of ASCII characters: each byte, then eight steps.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(CAST(conv_id AS VARCHAR), '')])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

TRIE = f"""
WITH t AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i, k, chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 WHERE i <= h UNION ALL SELECT c.conv_id, i, k, chars FROM c JOIN t ON t.conv_id = c.conv_id WHERE i > h),
p AS (SELECT c.conv_id, coalesce(ks, []) AS ks, coalesce(ns, []) AS ns FROM c LEFT JOIN (SELECT conv_id, list(k ORDER BY i) AS ks, list(chars ORDER BY i) AS ns FROM r GROUP BY conv_id) r ON r.conv_id = c.conv_id),
n AS (SELECT conv_id, d, array_to_string(ks[1:d], '') AS key, coalesce(ns[d], 0) AS chars, d = len(ks) AS ended FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM p)),
g AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends FROM n GROUP BY key, d),
k AS (SELECT substr(key, 1, 32 * (d - 1)) AS key, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL),
w AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k ON k.key = g.key),
a AS (SELECT substr(key, 1, 32 * i) AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM w) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, a.n_leaves, a.saved AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN a ON a.key = w.key LEFT JOIN g u ON w.d > 0 AND u.key = substr(w.key, 1, 32 * (w.d - 1))
"""
