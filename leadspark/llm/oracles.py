"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

from .mixing import BLOCK_WORDS
from .quality_rules import COMMON, LEAST_WORDS, MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE
from .url_filter import RULES

_LOW = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = "regexp_extract_all({t}, '[^ \\t\\n\\x0B\\f\\r]+')"

DECONTAMINATE = f"""
WITH w AS (SELECT doc_id, {_ALNUM.format(t="text")} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM.format(t="text")} AS ws FROM benchmark),
windows AS (SELECT item, least(13, len(ws)) AS n, array_to_string(ws[k : k + least(13, len(ws)) - 1], ' ') AS g FROM (SELECT item, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS k FROM i WHERE len(ws) > 0)),
places AS (SELECT doc_id, k, n, array_to_string(ws[k : k + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)),
hits AS (SELECT DISTINCT doc_id, k, n, item FROM places JOIN windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, lower(sha256(coalesce(names, ''))) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_COMMON = "[" + ", ".join(f"'{w}'" for w in COMMON) + "]"

QUALITY = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
wins AS (SELECT doc_id, k, array_to_string(w[k : k + 4], chr(1)) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
again AS (SELECT doc_id, k FROM wins JOIN (SELECT doc_id, g FROM wins GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM again) GROUP BY doc_id),
m AS (SELECT doc_id, lang, w, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, '') AS j, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')) AS lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
c AS (SELECT *, length(j) AS word_chars, length(j) - length(regexp_replace(j, '[A-Z]', '', 'g')) AS up, length(j) - length(regexp_replace(j, '[0-9]', '', 'g')) AS dig, strlen(j) - length(j) AS beyond,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM m),
class_bins AS (SELECT doc_id, lang, n_words, 0 AS kind, unnest([0, 1, 2, 3, 4]) AS bin, unnest([up, dig, beyond, n_symbols, greatest(0, word_chars - up - dig - beyond - n_symbols)]) AS x FROM c),
seen AS (SELECT doc_id, list_position({_COMMON}, word) AS bin, count(*) AS x FROM (SELECT doc_id, unnest(w) AS word FROM c) WHERE word IN ({", ".join(f"'{w}'" for w in COMMON)}) GROUP BY ALL),
word_bins AS (SELECT c.doc_id, lang, n_words, 1 AS kind, b.bin, coalesce(seen.x, 0) AS x FROM c, (SELECT unnest(range(1, {len(COMMON) + 1})) AS bin) b LEFT JOIN seen ON seen.doc_id = c.doc_id AND seen.bin = b.bin
  UNION ALL SELECT c.doc_id, lang, n_words, 1, 0, n_words - coalesce((SELECT sum(x) FROM seen WHERE seen.doc_id = c.doc_id), 0) FROM c),
bins AS (SELECT doc_id, lang, kind, bin, CAST(x AS DOUBLE) AS x FROM class_bins UNION ALL SELECT doc_id, lang, kind, bin, CAST(x AS DOUBLE) FROM word_bins),
refs AS (SELECT lang, kind, bin, sum(x) AS y FROM bins GROUP BY ALL),
shares AS (SELECT doc_id, b.kind, x / nullif(sum(x) OVER (PARTITION BY doc_id, b.kind), 0) AS p, y / nullif(sum(y) OVER (PARTITION BY doc_id, b.kind), 0) AS q FROM bins b JOIN refs USING (lang, kind, bin)),
far AS (SELECT doc_id, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END))) AS js FROM shares WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY ALL),
judged AS (SELECT doc_id, coalesce(max(js) FILTER (WHERE kind = 0), 0) > {MOST_CLASS_DISTANCE} OR coalesce(max(js) FILTER (WHERE kind = 1), 0) > {MOST_WORD_DISTANCE} AS off FROM far GROUP BY doc_id)
SELECT c.doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words >= {LEAST_WORDS} AND coalesce(off, false)) AS kept
FROM c LEFT JOIN judged USING (doc_id)
"""

_REST = "substr({u}, strpos({u}, '://') + 3)"
_HOST = "CASE WHEN strpos({u}, '://') > 0 THEN translate(regexp_extract(" + _REST + ", '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN strpos({u}, '://') > 0 THEN regexp_extract(" + _REST + ", '^[^/?#]*([^?#]*)', 1) ELSE '' END"
_NODE = (
    "regexp_replace(" + _HOST + ", '^(?:www|m)\\.|:(?:80|443)$', '', 'g') || ' ' || regexp_replace(" + _PATH + ", '/$', '') || ' ' || "
    "array_to_string(list_sort(list_filter(string_split(regexp_extract(" + _REST + ", '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_\\w+|ref|fbclid|gclid)(?:=|$)'))), '&')"
)
_FIT = (
    "list_max(list_filter(["
    + ", ".join(f"CASE WHEN ({{h}} = '{h}' OR ends_with({{h}}, '.{h}')) AND starts_with({{p}}, '{p}') THEN {{{{'size': {len(h + p)}, 'rule': '{h + p}', 'action': '{a}'}}}} END" for a, h, p in RULES)
    + "], lambda x: x IS NOT NULL))"
)

URLS = f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, coalesce({_HOST.format(u="url")}, '') AS host, coalesce({_PATH.format(u="url")}, '') AS path, CASE WHEN strpos(url, '://') > 0 THEN {_NODE.format(u="url")} END AS node FROM pages),
f AS (SELECT *, {_FIT.format(h="host", p="path").replace("{{", "{").replace("}}", "}")} AS fit FROM p),
tags AS (SELECT url, node, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM p WHERE url IS NOT NULL),
jumps AS (SELECT DISTINCT node AS a, replace(target, '&amp;', '&') AS target FROM (
  SELECT node, regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS target FROM tags WHERE regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?canonical')
  UNION ALL SELECT node, regexp_extract(tag, '(?i)url\\s*=\\s*["'']?([^"''\\s>]+)', 1) FROM tags WHERE regexp_matches(tag, '(?i)http-equiv\\s*=\\s*["'']?refresh')) WHERE strpos(target, '://') > 0 AND node IS NOT NULL),
t AS (SELECT a, {_NODE.format(u="target")} AS b, {_HOST.format(u="target")} AS th, {_PATH.format(u="target")} AS tp FROM jumps),
e AS (SELECT a, b FROM t UNION SELECT b, a FROM t),
reach(n, m) AS (SELECT a, a FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON reach.m = e.a),
classes AS (SELECT n, min(m) AS class FROM reach GROUP BY n),
told AS (SELECT node, fit.action AS action FROM f WHERE node IS NOT NULL AND fit IS NOT NULL
  UNION ALL SELECT b, ({_FIT.format(h="th", p="tp").replace("{{", "{").replace("}}", "}")}).action FROM t),
verdicts AS (SELECT coalesce(class, node) AS class, bool_or(action = 'allow') AS allowed FROM told LEFT JOIN classes ON n = node WHERE action IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, fit.rule AS rule, CASE WHEN fit IS NOT NULL THEN fit.action WHEN allowed IS NULL OR allowed THEN 'allow' ELSE 'block' END AS verdict,
  fit IS NULL AND allowed IS NOT NULL AS aliased
FROM f LEFT JOIN classes ON n = node LEFT JOIN verdicts ON verdicts.class = coalesce(classes.class, node)
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=_LOW.format(t="text"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.size + y.size - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(n, m) AS (SELECT a, a FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON reach.m = e.a),
c AS (SELECT n, min(m) AS class FROM reach GROUP BY n)
SELECT w.doc_id, coalesce(n.size, 0) AS n_shingles, coalesce(class, w.doc_id) AS component_id, coalesce(class, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.n = w.doc_id
"""

# bytes stand as two hexadecimal digits each
PASSAGES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
n AS (SELECT doc_id, hx, length(hx) // 2 AS n FROM d),
wins AS (SELECT doc_id, s, hash(substr(hx, 2 * s + 1, 200)) AS g FROM (SELECT doc_id, hx, unnest(range(0, n - 99)) AS s FROM n WHERE n >= 100)),
firsts AS (SELECT g, min(doc_id * 1000000000 + s) AS f FROM wins GROUP BY g),
late AS (SELECT doc_id, s FROM wins JOIN firsts USING (g) WHERE doc_id * 1000000000 + s > f),
steps AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM late),
marked AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s - p > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS span FROM steps),
spans AS (SELECT doc_id, span, min(s) AS a, max(s) + 100 AS b FROM marked GROUP BY ALL),
gaps AS (SELECT doc_id, span, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY span), 0) AS x, a AS y FROM spans
  UNION ALL SELECT doc_id, max(span) + 1, max(b), n FROM spans JOIN n USING (doc_id) GROUP BY doc_id, n),
kept AS (SELECT doc_id, string_agg(substr(hx, 2 * x + 1, 2 * (y - x)), '' ORDER BY span) AS k FROM gaps JOIN n USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT n.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, lower(sha256(unhex(coalesce(k, hx)))) AS kept_sha256
FROM n LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

CUTS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM s),
c AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""

_B = BLOCK_WORDS

MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format(t="coalesce(text, '')")}) AS BIGINT) AS size, sha256('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
laid AS (SELECT doc_id, source, size, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, row_number() OVER () AS row FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, place) - 1 AS k, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
x AS (SELECT *, total - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft, sum(weight) OVER (ORDER BY k DESC) AS wby FROM o),
r AS (SELECT CAST(lft AS BIGINT) AS lft, CAST(wby AS BIGINT) AS wby FROM x WHERE NOT 3 * source_size < lft * weight / wby ORDER BY k LIMIT 1),
t AS (SELECT place, source, source_size, total, CASE WHEN 3 * source_size < r.lft * weight / r.wby THEN CAST(3 * source_size AS DOUBLE) ELSE r.lft * weight / r.wby END AS target FROM o, r),
q AS (SELECT *, CAST(floor(target / greatest(total, 1) * 2147483648) AS BIGINT) AS share FROM t),
l AS (SELECT *, CAST(sum(share) OVER (ORDER BY place) AS BIGINT) AS high, CAST(sum(share) OVER () AS BIGINT) AS shares FROM q),
points AS (SELECT ((slot % 2147483648) * 1327217885 % 2147483648 * (SELECT any_value(shares) FROM l)) >> 31 AS point FROM (SELECT unnest(range(CAST(ceil((SELECT any_value(total) FROM l) / {_B}.0) AS BIGINT))) AS slot)),
n AS (SELECT place, count(*) AS slots FROM points JOIN l ON point >= high - share AND point < high GROUP BY place),
runs AS (SELECT row, size, pos + p * source_size AS a, coalesce(slots, 0) * {_B} AS stop FROM laid JOIN q ON laid.source IS NOT DISTINCT FROM q.source LEFT JOIN n USING (place), (SELECT unnest([0, 1, 2]) AS p)),
took AS (SELECT row, CAST(sum(greatest(0, least(a + size, stop) - a)) AS BIGINT) AS taken FROM runs GROUP BY row)
SELECT doc_id, size, source_size, target, taken FROM laid JOIN took USING (row) JOIN q ON laid.source IS NOT DISTINCT FROM q.source
"""

DIVERGENCE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS row FROM documents),
e AS (SELECT lang, source, row, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM e GROUP BY ALL HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM e SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
h AS (SELECT g.*, coalesce(v.v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n FROM g LEFT JOIN v USING (lang)),
dense AS (SELECT h.lang, h.source, term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (h.n + 2 * h.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (kept.n + 2) // (v.n + 2 * v.v) AS q
  FROM h JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms) WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 10
"""
