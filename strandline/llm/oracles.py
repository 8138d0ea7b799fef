"""DuckDB SQL of the queries that SQL can express."""

from .vocabulary import LIMIT, SOFT, STRICT

OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS MATERIALIZED (SELECT doc_id, j, n, substr(h, 400 * j + 1, 498) AS s FROM (SELECT doc_id, h, length(h) // 2 AS n, unnest(range(0, (length(h) // 2 + 199) // 200)) AS j FROM d)),
w AS MATERIALIZED (SELECT doc_id, 200 * j + o AS p, substr(s, 2 * o + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(200, n - 49 - 200 * j))) AS o FROM piece)),
m AS MATERIALIZED (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
hit AS (SELECT doc_id, p FROM w JOIN m USING (s) WHERE doc_id > least),
mark AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM mark),
span AS (SELECT doc_id, min(p) AS lo, max(p) + 50 AS hi FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM span
        UNION ALL SELECT doc_id, max(hi), NULL FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS k
         FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, CASE WHEN n IS NULL THEN h ELSE '' END))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP4 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n
      FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT doc_id, i, n, w,
        CASE WHEN i + 7 <= n THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) END AS g8,
        CASE WHEN i + 4 <= n THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS g5
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, g8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g8) > 1 AS r8, g5 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g5) > 1 AS r5 FROM g),
v AS (SELECT *, coalesce(bool_or(r8) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), false) AS c8,
             coalesce(bool_or(r5) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), false) AS c5 FROM c),
s AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars, count(*) FILTER (c8) AS n_repeat_words, count(*) FILTER (c5) AS n_covered FROM v GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered, 0) AS n_covered,
        coalesce(n_words, 0) < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
      FROM d LEFT JOIN s USING (doc_id) LEFT JOIN lines USING (doc_id)),
q AS (SELECT doc_id, i, g5 FROM c JOIN b USING (doc_id) WHERE r5 AND NOT base_failed),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS far FROM q x JOIN q y ON x.doc_id = y.doc_id AND x.g5 = y.g5 AND x.i < y.i),
longest AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, count(*) + 4 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, far ORDER BY i) AS k FROM pair) GROUP BY doc_id, far, k) GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_covered <= 0.4 * n_words AND coalesce(longest, 0) <= 0.25 * n_words AS kept
FROM b LEFT JOIN longest USING (doc_id)
"""

OP5 = rf"""
WITH p AS (SELECT page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
        CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS ruled
         FROM (SELECT DISTINCT page_id, host, path FROM h) h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY page_id),
term(term, weight) AS (VALUES {", ".join(f"('{x}', NULL::DOUBLE)" for x in STRICT)}, {", ".join(f"('{x}', {w}::DOUBLE)" for x, w in SOFT.items())}),
found AS (SELECT page_id, CAST(count(*) FILTER (weight IS NULL) AS INTEGER) AS strict_hits, coalesce(sum(weight), 0) AS soft_weight
          FROM h JOIN term ON contains(u, term) AND regexp_matches(u, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY page_id),
t AS (SELECT page_id, host, path, coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_weight, 0.0::DOUBLE) AS soft_weight FROM h LEFT JOIN found USING (page_id))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN strict_hits > 0 OR soft_weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_weight
FROM t LEFT JOIN best USING (page_id)
"""

OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
        UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) IN (1, 2))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, w.doc_id = c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) USING (doc_id)
"""


def _let(x: str, use: str) -> str:
    return f"list_transform([{x}], lambda h: {use})[1]"


def _hashed(x: str) -> str:
    x = _let(f"CAST({x} AS BIGINT)", "((h & 4294967295) + (h >> 32) * 73244475) & 4294967295")
    for k in (73244475, 739982445, 73244475):
        x = _let(x, f"(xor(h, h >> 16) * {k}) & 4294967295")
    return _let(x, "xor(h, h >> 16)")


def _permuted(table: str, name: str, x: str, n: str, key: str, rounds: int = 12) -> str:
    """Tables of swap-or-not rounds from table to name, which adds a column name."""
    out, at = [f"{name}0 AS MATERIALIZED (SELECT *, CAST({x} AS BIGINT) AS {name} FROM {table})"], f"{name}0"
    for r in range(rounds):
        shift = f"({_hashed(f'{key} * 4096 + {2 * r}')} * 1073741824 + {_hashed(f'{key} * 4096 + {2 * r + 1}')}) % {n}"
        out.append(f"{name}{r}y AS MATERIALIZED (SELECT *, ({shift} + {n} - {name}) % {n} AS y FROM {at})")
        bit = _hashed(f"(greatest({name}, y) * 4096 + {key} * 64 + {r})")
        at = f"{name}{r}z"
        out.append(f"{at} AS MATERIALIZED (SELECT * EXCLUDE (y, {name}), CASE WHEN {bit} % 2 = 1 THEN y ELSE {name} END AS {name} FROM {name}{r}y)")
    return ",\n".join([*out, f"{name} AS (SELECT * FROM {at})"])


OP3 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        doc_id % 2147483647 * 48271 % 2147483647 % greatest(1, least(65536, (SELECT count(*) FROM documents) // 4096)) AS bucket FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS number FROM d GROUP BY source),
s1 AS (SELECT *, (number - 1) % 3 + 1 AS weight, source_size * 3 AS most, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(CAST(sum(most) OVER w AS BIGINT), 0))::DOUBLE / CAST((CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER w AS BIGINT), 0)) AS DOUBLE) AS lv
       FROM s1 WINDOW w AS (ORDER BY most::DOUBLE / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, arg_min(lv, most::DOUBLE / weight) FILTER (most >= lv * weight) OVER () AS level FROM s2),
s4 AS (SELECT *, least(most::DOUBLE, level * weight) AS target, greatest(1, least(64, source_size // 512)) AS width FROM s3),
s5 AS (SELECT *, CAST(ceil(source_size / width) AS BIGINT) AS n FROM s4),
s AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target * n / source_size) AS BIGINT) ELSE 0 END AS slots FROM s5),
j AS (SELECT number, n, unnest(range(slots)) AS j FROM s WHERE slots > 0),
{_permuted("j", "drawn", "j % n", "n", "number")},
times AS (SELECT number, drawn AS b, count(*) AS times FROM drawn GROUP BY 1, 2),
p AS (SELECT d.*, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY bucket, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM d),
q AS (SELECT p.doc_id, p.size, p.start, s.number, s.source_size, s.target, s.width FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source),
b AS (SELECT *, unnest(range(start // width, (start + size - 1) // width + 1)) AS b FROM q WHERE size > 0),
t AS (SELECT number, start, CAST(sum((least(start + size, (b + 1) * width) - greatest(start, b * width)) * times) AS BIGINT) AS taken FROM b JOIN times USING (number, b) GROUP BY 1, 2)
SELECT q.doc_id, q.size, q.source_size, q.target, CASE WHEN size > 0 THEN coalesce(t.taken, 0) ELSE 0 END AS taken FROM q LEFT JOIN t USING (number, start)
"""

_RECORD = "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode({0})) || chr(13) || chr(10) || chr(13) || chr(10) || {0} || chr(13) || chr(10) || chr(13) || chr(10)"
OP8 = f"""
WITH p AS (SELECT page_id, page_id // 1024 AS file, url, coalesce(html, '') AS h, CASE WHEN page_id % 97 = 13 THEN '~' || substr(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS bad FROM pages),
r AS (SELECT page_id, file, {_RECORD.format('h')} AS rec, {_RECORD.format('bad')} AS other FROM p),
o AS (SELECT *, coalesce(CAST(sum(octet_length(encode(rec))) OVER (PARTITION BY file ORDER BY page_id, sha256(rec) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset" FROM r)
SELECT file, "offset", page_id, sha256(rec) AS expected, CASE WHEN page_id % 211 <> 5 THEN sha256(other) END AS found,
       CASE WHEN page_id % 211 = 5 THEN 'missing' ELSE 'altered' END AS kind
FROM o WHERE page_id % 211 = 5 OR page_id % 97 = 13
"""

_EACH = "SELECT doc_id, {k} AS k, unnest(string_split_regex(t, '{r}')) AS gap, unnest(regexp_extract_all(t, '{r}')) AS hit, unnest(range(len(regexp_extract_all(t, '{r}')) + 1)) AS i FROM d"
_KINDS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
PERSONAL_BASE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS ({" UNION ALL ".join(_EACH.format(k=k, r=r) for k, r in enumerate(_KINDS))}),
f AS (SELECT doc_id, k, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS digits,
        CAST(coalesce(sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(gap) AS a FROM e),
g AS (SELECT *, a + length(hit) AS z FROM f WHERE hit IS NOT NULL AND CASE k WHEN 0 THEN true
        WHEN 1 THEN len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0
        WHEN 2 THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 - CASE WHEN c > '4' THEN 9 ELSE 0 END END)) % 10 = 0
        ELSE length(digits) BETWEEN 8 AND 15 END)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
       sha256(coalesce(string_agg(['email', 'ip', 'card', 'phone'][k + 1] || ':' || a || ':' || z, ',' ORDER BY k, a) FILTER (k IS NOT NULL), '')) AS base_sha256
FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
"""
