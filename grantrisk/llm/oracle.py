"""DuckDB SQL of the subpackage's queries that SQL can express."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_SPACE = r"[\x09-\x0D\x20]+"

OP8 = f"""
WITH p0 AS (
  SELECT row_number() OVER () AS page, page_id, html,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{UPPER.lower()}') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
p AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.*(:[0-9]*)?$', '') AS name FROM p0),
dl AS (SELECT DISTINCT doc_id, trim(regexp_replace(x, '{_SPACE}', ' ', 'g')) AS line
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)),
ll AS (SELECT line, avg(quality) AS rate FROM dl JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND length(line) >= 20 GROUP BY line),
pp AS (SELECT page, trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)),
              '&amp;', '&'), '{_SPACE}', ' ', 'g')) AS line
       FROM (SELECT page, unnest(regexp_split_to_array(html, '<[^>]*>')) AS x FROM p)),
pg AS (SELECT page, sum(length(line)) AS a, sum(CASE WHEN rate IS NOT NULL THEN length(line) END) AS seen, sum(length(line) * rate) AS g
       FROM pp LEFT JOIN ll USING (line) WHERE length(line) >= 20 GROUP BY page),
o AS (SELECT p.*, CASE WHEN seen * 2 >= a THEN g * 2 >= seen END AS good, string_split(name, '.') AS l FROM p LEFT JOIN pg USING (page)),
h0 AS (SELECT name AS host, any_value(l) AS l, count(good)::DOUBLE AS n, coalesce(sum(good::INT), 0)::DOUBLE AS k FROM o GROUP BY name),
h1 AS (SELECT *, array_to_string(l[-2:], '.') AS two,
              regexp_matches(host, '^([0-9]+[.]){{3}}[0-9]+$') OR starts_with(host, '[') AS address FROM h0),
h2 AS (SELECT *, two IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'com.br', 'co.jp', 'co.nz', 'co.za', 'com.cn') AS known FROM h1),
h AS (SELECT host, n, k, CASE WHEN address THEN host WHEN known THEN two ELSE l[-1] END AS suffix,
             CASE WHEN address THEN host WHEN known THEN array_to_string(l[-3:], '.') ELSE two END AS domain FROM h2),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
g AS (SELECT 1 AS lv, n, k FROM s UNION ALL SELECT 2, n, k FROM d UNION ALL SELECT 3, n, k FROM h),
m AS (SELECT lv, sum(n) AS n, sum(k) AS k, sum(n * n) AS nn, sum(k * k / n) AS kkn, count(*) AS m FROM g WHERE n > 0 GROUP BY lv),
q AS (SELECT lv, (k / n) * (1 - k / n) AS noise,
             CASE WHEN m > 1 THEN (kkn - k * k / n - (m - 1) * (k / n) * (1 - k / n)) / (n - nn / n) END AS spread FROM m),
w AS (SELECT lv, CASE WHEN spread > 0 THEN least(greatest(noise / spread - 1, 2.0), 1000.0) ELSE 1000.0 END AS w FROM q),
c AS (SELECT (SELECT (sum(k) + 1) / (sum(n) + 2) FROM s) AS p0, coalesce((SELECT w FROM w WHERE lv = 1), 1000.0) AS s1,
             coalesce((SELECT w FROM w WHERE lv = 2), 1000.0) AS s2, coalesce((SELECT w FROM w WHERE lv = 3), 1000.0) AS s3),
r0 AS (SELECT host, h.n, h.k, s3, p0, (d.k + s2 * ((s.k + s1 * p0) / (s.n + s1))) / (d.n + s2) AS dm
       FROM h JOIN d USING (domain) JOIN s ON s.suffix = d.suffix, c),
r AS (SELECT host, p0, k + s3 * dm AS a, n - k + s3 * (1 - dm) AS b FROM r0),
u AS (SELECT host, least(a / (a + b) + 1.645 * sqrt(a * b / (a + b + 1)) / (a + b),
                         1 / (1 + exp(-1.645 * sqrt(1 / a + 1 / b) - ln(a / b)))) AS upper, p0 / 3 / (p0 / 3 + 1 - p0) AS least FROM r),
f(ord, verdict, rule, rh, rp) AS (VALUES (1, 'allow', 'org/', 'org', '/'), (2, 'block', 'example.org/es/', 'example.org', '/es/'),
  (3, 'block', 'example.org/en/1', 'example.org', '/en/1'), (4, 'allow', 'com/fr/', 'com', '/fr/'), (5, 'block', 'com/de/', 'com', '/de/')),
fit AS (SELECT host, path, arg_min(struct_pack(rule, verdict), (-length(rule), ord)) AS x
        FROM (SELECT DISTINCT host, path FROM o) JOIN f
          ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, o.host, o.path, x.rule AS rule,
       coalesce(x.verdict, CASE WHEN upper < least THEN 'block' ELSE 'allow' END) AS verdict
FROM o JOIN u ON u.host = o.name LEFT JOIN fit ON fit.host = o.host AND fit.path = o.path
"""

OP4 = f"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
r AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.first AS gone FROM l LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::DOUBLE AS letters,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS solid,
         (('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / coalesce(greatest(CASE WHEN solid > 0 THEN letters / solid END, 0.05), 0.05) AS key FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, sum(cap) OVER o AS caps, sum(w) OVER o AS ws, sum(source_size) OVER () AS total, sum(w) OVER () AS weights
       FROM s1 WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
grow AS (SELECT a.source, (SELECT coalesce(sum(b.cap), 0) FROM s2 b WHERE b.cap / b.w <= a.cap / a.w) AS held,
                (SELECT coalesce(sum(b.w), 0) FROM s2 b WHERE b.cap / b.w > a.cap / a.w) AS free, a.cap / a.w AS t, a.total FROM s2 a),
level AS (SELECT max(l) AS level FROM (
            SELECT total::DOUBLE / weights AS l FROM s2
            UNION ALL SELECT (total - held) / free FROM grow WHERE free > 0 AND t <= (total - held) / free)),
t AS (SELECT source, source_size, least(cap, level * w) AS target FROM s1, level),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
             sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

ORACLE: dict[str, str] = {"op4_line_dedup": OP4, "op8_url_filter": OP8, "op10_mixing": OP10}
